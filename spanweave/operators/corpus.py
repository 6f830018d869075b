"""Corpus shaping: deduplication, contamination, budgets, quotas, packing, splits, mixing.

Order matters where a loop would take rows as they come, so every such operator takes an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.offsets import bound, scanned
from spanweave.sources.staged import exists
from spanweave.functions.values import hash_digit


def first_per(rows: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each group; grouping aggregates before the shuffle, so a group of copies moves as one row a task."""
    kept = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order), *(F.col(c).alias(f"_{c}") for c in rows.columns))
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, c in enumerate(by)]
    best = rows.groupBy(*keys).agg(F.min(kept).alias("b"))
    return best.select(*(F.col(f"b._{c}").alias(c) for c in rows.columns))


def deduplicated(docs: DataFrame, text: str = "text", order: str = "doc_id", within: list[str] | None = None) -> DataFrame:
    """The first document of each text, case ignored, by its md5; ``within`` limits copies to a group."""
    return first_per(docs, [*(within or []), F.md5(F.lower(F.col(text)).cast("binary"))], [order])


def without_texts(docs: DataFrame, held: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose exact text is not among the held-out ones; repeated documents stay, null texts too.

    Joined by a hash and compared in full.
    """
    known = held.select(F.xxhash64(text).alias("__hash"), F.col(text).alias("__held")).distinct()
    return docs.join(known, (F.xxhash64(docs[text]) == known["__hash"]) & (docs[text] == known["__held"]), "left_anti")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` is called so (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_BLANK = r"[ \t\n\x0B\f\r]+"
#: Passages without an inner word go to the tasks as literals, at most so many bytes in one pass.
PASSAGE_BYTES = 1 << 20


def containing(docs: DataFrame, passages: DataFrame, doc_key: str = "doc_id", key: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_key, key`` of every document that contains a passage as it stands. ``doc_key`` is unique; empty passages are in none.

    A passage of three words or more has words inside it that any text with it has as whole words. The longest of
    them is its anchor: an equi-join on anchors leaves few candidates, which are then compared as they stand. Only
    passages of one or two words have no anchor; they are looked for in blocks of checked size, a scan for each.
    """
    given = passages.where(F.length(text) > 0).select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.split(F.col(text), _BLANK).alias("w"))
    inner = F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_sort(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    given = given.select("__k", "__t", F.try_element_at(longest, F.lit(1))["w"].alias("anchor"))
    words = docs.select(F.col(doc_key).alias("__d"), F.explode(F.array_distinct(F.split(F.col(text), _BLANK))).alias("anchor"))
    pairs = words.join(given.where("anchor IS NOT NULL"), "anchor").select("__d", "__k", "__t")
    held = docs.select(F.col(doc_key).alias("__d"), F.col(text).alias("__text"))
    found = pairs.join(held, "__d").where(F.contains("__text", F.col("__t"))).select(F.col("__d").alias(doc_key), F.col("__k").alias(key))
    short = given.where("anchor IS NULL")
    size = short.agg(F.sum(F.octet_length("__t"))).first()[0] or 0
    blocks = -(-2 * size // PASSAGE_BYTES)
    for k in range(blocks):
        some = short.where(F.pmod(F.xxhash64("__t"), F.lit(blocks)) == k).agg(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__t").alias("t"))).alias("p"))
        near = docs.select(F.col(doc_key).alias("__d"), F.col(text).alias("__text")).withColumn("p", some.scalar())
        near = near.select("__d", F.explode(F.filter("p", lambda p: F.contains(F.col("__text"), p["t"]))).alias("hit"))
        found = found.unionByName(near.select(F.col("__d").alias(doc_key), F.col("hit.k").alias(key)))
    return found


def budgeted(docs: DataFrame, size: str, order: str, group: str, cap: int | dict[str, int], budget: int) -> DataFrame:
    """Rows that a reader admits who stops a group at ``cap`` and everything at ``budget``.

    ``cap`` is one for all groups, or one for each that has any.

    Two running sums: a row passes if earlier rows of its group stay below the cap, and then if earlier rows that
    passed stay below the budget.
    """
    own, whole = fresh(docs, "own", "all")
    most = F.lit(cap)
    if isinstance(cap, dict):
        most = F.coalesce(*(F.when(F.col(group) == k, F.lit(v)) for k, v in cap.items()), F.lit(2**63 - 1))
    capped = prefix(docs, size, order, own, [group]).where(F.col(own) < most).drop(own)
    return prefix(capped, size, order, whole).where(F.col(whole) < budget).drop(whole)


#: Rows of a range that one task orders, and of one whose rows hold whole documents; ranges at most.
RANGE_ROWS, RANGE_DOCS, RANGES = 500_000, 20_000, 2_048


def _below(bounds: list, value: Column) -> Column:
    """How many of the sorted ``bounds`` are below a value, by two short scans: of every n-th of them, then of the n after it."""
    n = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[k : k + n] for k in range(0, len(bounds), n)]
    if not groups:
        return F.lit(0)
    count = lambda items: F.size(F.filter(items, lambda b: b < value))
    firsts = F.array(*(F.lit(g[0]) for g in groups))
    held = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    return bound(count(firsts), lambda k: F.when(k > 0, (k - 1) * n + count(F.get(held, k - 1))).otherwise(0))


def prefix(rows: DataFrame, value: str | Column, order: str, name: str, by: list[str] | None = None, how: str = "sum", most: int | None = None) -> DataFrame:
    """``rows`` and ``name``: the sum (or ``max``) of ``value`` over all rows before them in ``order``, within ``by`` or over all.

    No task orders a whole group: rows are dealt by ranges of ``order`` (a number) at its approximate quantiles, so
    neither an outlier nor a hot group fills one task; totals of ranges are few and give each its start. Rows of
    equal ``order`` are in one range and follow each other in no set order. Null orders come first. Sums begin at 0,
    maxima at null. ``most`` rows are in a range (``RANGE_ROWS``), fewer where rows are long.
    """
    by = by or []
    at, own, base, part = fresh(rows.withColumn(name, F.lit(0)), "at", "own", "base", "part")
    count = rows.count()
    parts = min(RANGES, max(1, -(-count // (most or RANGE_ROWS))))
    place = F.lit(0)
    if parts > 1:
        steps = [k / parts for k in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx(order, steps, 100 * parts)).first()[0] or []))
        place = _below(bounds, F.col(order))
    dealt = rows.withColumn(own, value if isinstance(value, Column) else F.col(value)).withColumn(part, F.when(F.col(order).isNull(), 0).otherwise(place).cast("int"))
    fold = F.sum if how == "sum" else F.max
    inside = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(name, fold(own).over(inside))
    if parts > 1:
        totals = dealt.groupBy(*by, part).agg(fold(own).alias(at))
        before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(*(F.col(c).alias(f"{at}_{k}") for k, c in enumerate(by)), F.col(part).alias(at), fold(at).over(before).alias(base))
        same = F.col(part) == F.col(at)
        for k, c in enumerate(by):
            same = same & out[c].eqNullSafe(F.col(f"{at}_{k}"))
        both = F.greatest(name, base) if how == "max" else F.coalesce(name, F.lit(0)) + F.coalesce(base, F.lit(0))
        # Without groups there is a start for each range, so few that they are broadcast; the rows do not move again.
        out = out.join(starts if by else F.broadcast(starts), same).withColumn(name, both)
    elif how == "sum":
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), F.col(name).cast("long") if how == "sum" else F.col(name))


def prefix_sum(rows: DataFrame, size: str, order: str, name: str) -> DataFrame:
    """:func:`prefix` of sums over all rows."""
    return prefix(rows, size, order, name)


def packed(docs: DataFrame, size: str, order: str, domain: str, body: int) -> DataFrame:
    """``seq_id, domain, tokens``: tokens of each domain in sequences of ``body``, documents end to end.

    Each document ends with one separator, which counts. The incomplete last sequence is dropped.
    """
    rows = docs.select(F.col(domain).alias("domain"), F.col(order).alias("order"), (F.col(size) + 1).alias("size"))
    placed = prefix(rows, "size", "order", "at")
    end = F.col("at") + F.col("size")
    seqs = F.sequence(F.floor(F.col("at") / body), F.floor((end - 1) / body))
    pieces = placed.select("domain", "at", end.alias("end"), F.explode(seqs).alias("seq_id"))
    share = F.least(F.col("end"), (F.col("seq_id") + 1) * body) - F.greatest(F.col("at"), F.col("seq_id") * body)
    whole = rows.agg(F.sum("size")).first()[0] or 0
    return pieces.where(F.col("seq_id") < whole // body).groupBy("seq_id", "domain").agg(F.sum(share).alias("tokens"))


def interleaved(rows: DataFrame, source: str, order: str) -> DataFrame:
    """``rows`` with ``turn`` and ``place``: sources take turns in the order of their names."""
    turns = prefix(rows, F.lit(1), order, "turn", [source]).withColumn("turn", (F.col("turn") + 1).cast("int"))
    return turns.withColumn("place", F.struct("turn", source))


def round_robin(rows: DataFrame, group: str, source: str, order: str, quota: int) -> DataFrame:
    """At most ``quota`` rows of each group, its sources taking turns. Ranks are cut at the quota before the shuffle."""
    (own,) = fresh(rows, "turn")
    turn = F.row_number().over(Window.partitionBy(group, source).orderBy(order))
    rows = rows.withColumn(own, turn).where(F.col(own) <= quota)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(own, source))
    return rows.withColumn("rank", rank).where(F.col("rank") <= quota).drop(own)


def capped(rows: DataFrame, groups: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group. Ranks are cut before the shuffle, so a hot group sends ``most`` rows a task."""
    (own,) = fresh(rows, "rank")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn(own, rank).where(F.col(own) <= most).drop(own)


def seeded(seed: str, *keys: str) -> Column:
    """A sort key that shuffles rows alike in every engine: the md5 of a seed and the row's keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def stress_split(key: Column) -> Column:
    """``stress`` for a tenth of all keys, ``main`` for the others, by the key's md5."""
    return F.when(hash_digit(key) == 0, "stress").otherwise("main")


def nested_sets(public: DataFrame, frames: DataFrame, shares: list[int], order: str = "rank") -> DataFrame:
    """``share`` and rows: sets of equal size that replace a share (per cent) of public rows by frames, each within the next.

    Both tables have ``rank`` from 1 in a shuffled order; sets take prefixes, so a larger share keeps the smaller's frames.
    """
    total = public.count()
    out = None
    for share in shares:
        n = total * share // 100
        part = public.where(F.col(order) <= total - n).unionByName(frames.where(F.col(order) <= n)).withColumn("share", F.lit(share))
        out = part if out is None else out.unionByName(part)
    return out


def coverage_matrix(spans: DataFrame, rows: str, labels: list[str]) -> DataFrame:
    """Spans of every row value and label, with a zero where there is none."""
    counts = spans.groupBy(rows).pivot("label", labels).count()
    return counts.na.fill(0, labels)


def gaps(matrix: DataFrame, rows: str, labels: list[str], least: int) -> DataFrame:
    """Cells of a coverage matrix below ``least``."""
    cells = matrix.select(rows, F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in labels))).alias("c"))
    return cells.select(rows, "c.label", "c.n").where(F.col("n") < least)


def pair_coverage(rows: DataFrame, factors: list[str]) -> DataFrame:
    """For each pair of factors: combinations seen, the least count and the upper median of counts.

    Cells are counted by their count, so the ordered window has one row for each distinct count.
    """
    out = None
    for i, a in enumerate(factors):
        for b in factors[i + 1 :]:
            cells = rows.groupBy(a, b).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
            upto = F.sum("c").over(Window.orderBy("n"))
            cells = cells.select("n", "c", upto.alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))
            median = F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("n")))
            part = cells.agg(F.sum("c").alias("cells"), F.min("n").alias("least"), median.alias("median"))
            part = part.select(F.lit(f"{a}*{b}").alias("pair"), "cells", "least", "median")
            out = part if out is None else out.unionByName(part)
    return out


def reassembled(chunks: DataFrame, key: str, number: str, text: str = "text") -> DataFrame:
    """Documents from chunks, joined by line breaks in the order of the chunk number's text form."""
    piece = F.struct(F.col(number).cast("string").alias("k"), F.col(text).alias("t"))
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "\n").alias(text))


def mixed(first: DataFrame, second: DataFrame, on: str, gap: str = "\n\n", moved: tuple[str, ...] = ("spans",)) -> DataFrame:
    """Pairs of documents as one. Both have ``on, text`` and the ``moved`` columns, arrays of structs with ``start, end``
    (spans, look-alikes, language segments); the second's are shifted."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"))
    by = F.length("a.text") + len(gap)

    def together(c: str) -> Column:
        later = F.transform(f"b.{c}", lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))
        return F.concat(f"a.{c}", later).alias(c)

    return both.select(F.col(f"a.{on}").alias(on), F.concat("a.text", F.lit(gap), "b.text").alias("text"), *map(together, moved))


def address_capped(rows: DataFrame, low: int, high: int, late: str = "india") -> DataFrame:
    """Addresses without repeats (case ignored), capped by country; columns ``country, source, pos, lines``.

    The cap is met before a key is noted, so a country that a second source may raise to ``high`` is read in two
    stages: other sources to ``low``, then ``late`` rows whose keys were not admitted.
    """
    key, n, rank_ = fresh(rows, "key", "had", "rank")
    keyed = rows.withColumn(key, F.lower(F.concat_ws(" ", "lines")))
    early = capped(first_per(keyed.where(F.col("source") != late), ["country", key], ["pos"]), ["country"], ["pos"], low)
    later = first_per(keyed.where(F.col("source") == late).join(early.select("country", key), ["country", key], "left_anti"), ["country", key], ["pos"])
    had = early.groupBy("country").agg(F.count("*").alias(n))
    rank = F.row_number().over(Window.partitionBy("country").orderBy("pos"))
    extra = later.withColumn(rank_, rank).where(F.col(rank_) <= high).join(had, "country", "left").where(F.col(rank_) + F.coalesce(n, F.lit(0)) <= high)
    return early.unionByName(extra.select(*early.columns)).drop(key)


def packed_ids(docs: DataFrame, ids: str, order: str, body: int, first: int, sep: int) -> DataFrame:
    """``seq_id, ids``: sequences of ``body`` token ids, documents end to end, between a ``first`` and a ``sep`` id.

    Each document ends with ``sep``. The incomplete last sequence is dropped. Only the pieces of a sequence meet.
    """
    rows = docs.select(F.col(order).alias("order"), F.concat(F.col(ids), F.array(F.lit(sep))).alias("ids")).withColumn("size", F.size("ids"))
    placed = prefix(rows, "size", "order", "at", most=RANGE_DOCS)
    end = F.col("at") + F.col("size")
    pieces = placed.select("at", "size", "ids", F.explode(F.sequence(F.floor(F.col("at") / body), F.floor((end - 1) / body))).alias("seq_id"))
    low = F.greatest(F.col("seq_id") * body - F.col("at"), F.lit(0))
    high = F.least((F.col("seq_id") + 1) * body - F.col("at"), F.col("size"))
    part = F.slice("ids", (low + 1).cast("int"), (high - low).cast("int"))
    whole = rows.agg(F.sum("size")).first()[0] or 0
    kept = pieces.where(F.col("seq_id") < whole // body).select("seq_id", F.struct("at", part.alias("p")).alias("p"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["p"]))
    return kept.groupBy("seq_id").agg(F.concat(F.array(F.lit(first)), joined, F.array(F.lit(sep))).alias("ids"))


def allocated(sources: DataFrame, name: str = "source", cap: str = "cap", available: str = "available", order: str = "pos") -> DataFrame:
    """``name, n``: each source's share; what small sources lack of their caps is spread evenly over those with room.

    Equal shares, round after round, raise every source with room to one common level of additions: the highest whole
    level whose additions do not exceed what is missing. It is found from running sums over the different rooms, in
    ranges; what then remains is less than the sources still open, and the first of them in ``order`` (ties by name)
    get one more each. Nulls count as 0. No task or driver gets a row for each source.
    """
    n, room, c, s, below, less, rank = fresh(sources, "n", "room", "c", "s", "below", "less", "rank")
    limit, there = (F.coalesce(F.col(x).cast("long"), F.lit(0)) for x in (cap, available))
    rows = sources.select(F.col(name).alias("name"), F.col(order).alias("order"), limit.alias("cap"), F.least(limit, there).alias(n), (there - F.least(limit, there)).alias(room))
    short, open_, all_ = rows.agg(F.coalesce(F.sum(F.col("cap") - F.col(n)), F.lit(0)), F.count_if(F.col(room) > 0), F.coalesce(F.sum(room), F.lit(0))).first()
    level, rest = 0, 0
    if short >= all_:
        level = rows.agg(F.coalesce(F.max(room), F.lit(0))).first()[0]
    elif short > 0:
        rooms = rows.where(F.col(room) > 0).groupBy(room).agg(F.count("*").alias(c), F.sum(room).alias(s))
        upto = prefix(prefix(rooms, c, room, below), s, room, less).withColumn(c, F.col(c) + F.col(below)).withColumn(s, F.col(s) + F.col(less))
        full, given = upto.where(F.col(s) + (open_ - F.col(c)) * F.col(room) <= short).agg(F.coalesce(F.max(c), F.lit(0)), F.coalesce(F.max(s), F.lit(0))).first()
        level, rest = divmod(short - given, open_ - full)
    rows = rows.withColumn(n, F.col(n) + F.least(F.col(room), F.lit(level)))
    if rest:
        still = rows.where(F.col(room) > level)
        places = prefix(still.groupBy("order").agg(F.count("*").alias(c)), c, "order", below).where(F.col(below) < rest).select(F.col("order").alias(rank), below)
        tied = F.row_number().over(Window.partitionBy("order").orderBy("name"))
        more = still.join(places, F.col("order").eqNullSafe(F.col(rank))).withColumn(rank, tied + F.col(below)).where(F.col(rank) <= rest)
        rows = rows.select("name", n).unionByName(more.select("name", F.lit(1).cast("long").alias(n))).groupBy("name").agg(F.sum(n).alias(n))
    return rows.select(F.col("name").alias(name), F.col(n).cast("long").alias("n"))


def fragments_packed(rows: DataFrame, group: str, order: str, gap: str = "\n\n") -> DataFrame:
    """``group, text, spans``: the fragments of each group as one text in order, their spans moved by what is before them."""
    one = F.struct(F.col(order).alias("k"), F.col("text").alias("text"), F.col("spans").alias("spans"))
    grouped = rows.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("f"))
    start = F.struct(F.lit(0).alias("at"))
    kind = "array<struct<start:int,end:int,label:string>>"

    def emit(s: Column, f: Column) -> Column:
        return F.transform(f["spans"], lambda x: F.struct((x["start"] + s["at"]).cast("int").alias("start"), (x["end"] + s["at"]).cast("int").alias("end"), x["label"].alias("label")))

    moved = F.flatten(scanned(F.col("f"), start, lambda s, f: F.struct((s["at"] + F.length(f["text"]) + len(gap)).alias("at")), emit, kind))
    return grouped.select(group, F.array_join(F.transform("f", lambda f: f["text"]), gap).alias("text"), moved.alias("spans"))


def with_defaults(rows: DataFrame, table: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """``rows`` with the columns of ``table`` by ``on``, and a default where a row has no entry or the entry is null."""
    (key,) = fresh(rows, "key")
    entries = table.select(F.col(on).alias(key), *(F.col(c).alias(f"{key}_{c}") for c in defaults))
    both = rows.join(entries, rows[on] == entries[key], "left")
    return both.select(*(rows[c] for c in rows.columns), *(F.coalesce(F.col(f"{key}_{c}"), F.lit(v)).alias(c) for c, v in defaults.items()))


def shares(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """``group, kind, n, share``: rows of each kind in every group, and their share of it."""
    counts = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def value_pools(rows: DataFrame, group: str, value: str, path: str | None = None) -> DataFrame:
    """``group, value``: the different values of every group, a row each; with ``path`` written there once and read from then on.

    What stands at ``path`` must be a finished table of these two columns, else a ``ValueError`` says so.
    """
    spark, pools = rows.sparkSession, rows.select(group, value).distinct()
    if path is None:
        return pools
    if not exists(f"{path.rstrip('/')}/_SUCCESS"):
        pools.write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path)
    kinds = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
    if kinds(found) != kinds(pools):
        raise ValueError(f"{path} holds {found.schema.simpleString()}, not the values of {group} and {value}")
    return found


def drawn_by_weight(rows: DataFrame, choices: DataFrame, key: str, name: str, weight: str, seed: str, out: str = "drawn") -> DataFrame:
    """``rows`` with ``out``: one of ``choices`` for each, by whole weights and the md5 of the seed and key.

    The choices are a dimension (markets, sources): their running weights are one array, in the order of their names.
    Choices without a positive weight are never drawn; without any choice ``out`` is null.
    """
    some = choices.where(F.col(weight) > 0).select(F.col(name).alias("name"), F.col(weight).cast("long").alias("weight"))
    upto = F.transform("c", lambda x, i: F.struct(x["name"].alias("name"), F.aggregate(F.slice("c", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["weight"]).alias("upto")))
    table = some.agg(F.array_sort(F.collect_list(F.struct("name", "weight"))).alias("c")).select(upto.alias("c"))
    (held,) = fresh(rows, "held")
    given = rows.withColumn(held, table.scalar())
    total = F.get(F.col(held), F.size(held) - 1)["upto"]
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % total
    return given.withColumn(out, F.get(F.filter(held, lambda x: x["upto"] > place), F.lit(0))["name"]).drop(held)
