"""Evaluation reports over gold, predictions and look-alikes: hits of gold spans, grids, breakdowns, bundles.

Rows are as in ``scoring``: ``doc_id, start, end, label`` and columns to group by. Every report joins once by
document and sums flags at several levels by grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators import intervals as I
from spanweave.operators import scoring as C

KEY = C.KEY
#: Words in a bin of windows.
WORDS = 256


def hits(gold: DataFrame, pred: DataFrame, swaps: dict[str, str] | None = None) -> DataFrame:
    """Gold rows with ``found`` (a prediction of its label overlaps it), ``exact`` (same bounds and label), ``any_``
    (any prediction overlaps) and ``swap`` (not found, but one of its label's counterpart overlaps)."""
    g = gold.withColumn("gid", F.monotonically_increasing_id()) if "gid" not in gold.columns else gold
    both = I.beside(g, pred.select(KEY, "start", "end", "label"), KEY)
    same = F.col("p.label") == F.col("g.label")
    exact = same & (F.col("p.start") == F.col("g.start")) & (F.col("p.end") == F.col("g.end"))
    partner = F.lit(None).cast("string")
    for a, b in (swaps or {}).items():
        partner = F.when(F.col("g.label") == a, F.lit(b)).otherwise(partner)
    true = lambda c: F.coalesce(F.max(c), F.lit(False))
    flags = both.groupBy(*(F.col(f"g.{c}").alias(c) for c in g.columns)).agg(
        true(same).alias("found"), true(exact).alias("exact"), true(F.col("p.label").isNotNull()).alias("any_"), true(F.col("p.label") == partner).alias("swap")
    )
    return flags.withColumn("swap", F.col("swap") & ~F.col("found")).drop("gid")


def _count(flag: str) -> Column:
    return F.count_if(flag).alias(flag)


def gold_report(found: DataFrame, value: str = "value", country: Column | None = None, address: str = "ADDRESS") -> DataFrame:
    """``key, n, found, exact, swap`` from :func:`hits`: by label, and addresses by layout and, where known, country."""
    layout = F.when(F.col(value).contains("\n"), "multi-line").otherwise("single-line")
    parts = [F.col("label"), F.when(F.col("label") == address, F.concat_ws("/", "label", layout))]
    if country is not None:
        parts.append(F.when((F.col("label") == address) & country.isNotNull(), F.concat_ws("/", "label", country)))
    rows = found.withColumn("key", F.explode(F.array_compact(F.array(*parts))))
    return rows.groupBy("key").agg(F.count("*").alias("n"), _count("found"), _count("exact"), _count("swap"))


def grid_recall(found: DataFrame, ctx: str = "ctx", anchor: str = "bracket_anchor") -> DataFrame:
    """``level, key, n, strict, lenient`` from :func:`hits`, anchors left out: by context and label, context, label,
    format, setting (language and mode), mode, and all."""
    rows = found.where(~F.col(ctx).eqNullSafe(F.lit(anchor))).withColumn("setting", F.concat_ws("/", "lang", "mode"))
    names = [ctx, "label", "format", "setting", "mode"]
    sets = [[ctx, "label"], [ctx], ["label"], ["format"], ["setting"], ["mode"], []]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("exact").alias("strict"), F.count_if("found").alias("lenient")
    )
    ids = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s): "/".join("ctx" if c == ctx else c for c in s) or "ALL" for s in sets}
    level = F.coalesce(*(F.when(F.col("g") == k, F.lit(v)) for k, v in ids.items()))
    return grouped.select(level.alias("level"), F.concat_ws("|", *names).alias("key"), "n", "strict", "lenient")


def flagged_by(negs: DataFrame, pred: DataFrame, ctx: str = "ctx") -> DataFrame:
    """``ctx, n, flagged``: look-alikes of each context (``?`` where it is null) and of all (``ALL``), and those that any
    prediction overlaps. Repeated look-alikes count as often as they are there."""
    seen = negs.withColumn("__n__", F.lit(1)).groupBy(*negs.columns).agg(F.sum("__n__").alias("n"))
    hit = I.touched(seen, pred, KEY).withColumn("hit", F.lit(True))
    rows = seen.join(hit, [KEY, "start", "end"], "left").withColumn("ctx", F.explode(F.array(F.coalesce(F.col(ctx), F.lit("?")), F.lit("ALL"))))
    return rows.groupBy("ctx").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("flagged"))


def breakdown(found: DataFrame, pred: DataFrame, name: str = "set", pooled: str = "ALLSETS") -> DataFrame:
    """``set, key, f1, coverage, n``: strict F1 and covered gold of every set and of all pooled, each over all, by
    entity and by language; F1 and coverage are null where there is no gold.

    ``found`` is :func:`hits`; ``pred`` has ``set, lang`` too. Gold of equal bounds and label matches one prediction each.
    """
    keys = [KEY, name, "lang", "label", "start", "end"]
    g = found.groupBy(*keys).agg(F.count("*").alias("g"), F.count_if("any_").alias("cov"))
    p = pred.groupBy(*keys).agg(F.count("*").alias("p"))
    both = g.join(p, keys, "full").na.fill(0, ["g", "cov", "p"]).withColumn("tp", F.least("g", "p"))
    rows = both.groupBy(name, "lang", "label").agg(*(F.sum(c).alias(c) for c in ("g", "p", "tp", "cov")))
    sets = [[*s, *k] for s in ([name], []) for k in ([], ["label"], ["lang"])]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], name, "lang", "label").agg(F.grouping(name).alias("no"), *(F.sum(c).alias(c) for c in ("g", "p", "tp", "cov")))
    key = F.when(F.col("label").isNotNull(), F.concat(F.lit("ent/"), "label")).when(F.col("lang").isNotNull(), F.concat(F.lit("lang/"), "lang")).otherwise("ALL")
    f1 = C.prf(F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp"))["f1"]
    some = F.col("g") > 0
    return grouped.select(F.when(F.col("no") == 1, pooled).otherwise(F.col(name)).alias(name), key.alias("key"), F.when(some, f1).alias("f1"), F.when(some, F.col("cov") / F.col("g")).alias("coverage"), F.col("g").alias("n"))


def best_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``best``: whether a value is the greatest of its group."""
    return rows.withColumn("best", F.coalesce(F.col(value) == F.max(value).over(Window.partitionBy(*by)), F.lit(False)))


def ordered_keys(rows: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with ``rank``, the order of a report: ALL, then by the number of slashes, then by name. One row a key."""
    depth = F.length(key) - F.length(F.replace(F.col(key), F.lit("/"), F.lit("")))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(key) != "ALL", depth, key)))


def top_confusions(counts: DataFrame, levels: list[str], top: int = 4) -> DataFrame:
    """The ``top`` predictions of every level and label of :func:`scoring.confusion`, ties by name."""
    order = Window.partitionBy(*levels, "label").orderBy(F.desc("n"), "predicted")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def entity_f1(gold: DataFrame, pred: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang, precision, recall, f1`` of whole entities decoded from tags: one row for each language, one with a null
    language for all together, and ``macro_f1``, the mean over languages, beside each."""
    counts = C.strict_counts(gold, pred, [lang]).groupBy(lang).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    both = counts.groupingSets([[], [F.col(lang)]], lang).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    scored = both.select(lang, *(v.alias(k) for k, v in C.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))
    return scored.withColumn("macro_f1", F.avg(F.when(F.col(lang).isNotNull(), F.col("f1"))).over(Window.partitionBy()))


def bundle(gold: DataFrame, pred: DataFrame, negs: DataFrame, lang: str = "lang", script: str = "script") -> DataFrame:
    """``part, lang, label, other, n, value``: all parts of a language's evaluation in one table.

    ``strict`` and ``lenient`` F1 (null language: all; null label: all labels), ``script`` recall, exact and by
    overlap (``other``), ``detection`` of gold by any label, ``confusion`` shares and ``negatives`` flagged. Gold
    labelled IGNORE is a zone in which predictions do not count.
    """
    zones = gold.where(F.col("label") == "IGNORE")
    gold, pred = C.without_ignored(gold), C.clear_of(pred, zones)
    sets = [[], [lang], [lang, "label"]]
    out = None

    def add(rows: DataFrame, part: str, label: str | None = None, other: Column | None = None) -> None:
        nonlocal out
        cells = rows.select(
            F.lit(part).alias("part"), F.col(lang).alias("lang"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
            (other if other is not None else F.lit(None)).cast("string").alias("other"), F.col("n").cast("long").alias("n"), F.col("value").cast("double").alias("value"),
        )
        out = cells if out is None else out.unionByName(cells)

    for part, counts in (("strict", C.strict_counts), ("lenient", C.lenient_counts)):
        table = C.levelled(counts(gold, pred, [lang]), sets, [lang, "label"])
        add(table.withColumnsRenamed({"support": "n", "f1": "value"}), part, "label")
    found = hits(gold, pred)
    scripts = found.groupBy(lang, script).agg(F.count("*").alias("n"), F.avg(F.col("exact").cast("int")).alias("strict"), F.avg(F.col("found").cast("int")).alias("lenient"))
    add(scripts.unpivot([lang, script, "n"], ["strict", "lenient"], "how", "value"), "script", script, F.col("how"))
    seen = found.groupingSets([[F.col(lang)], [F.col(lang), F.col("label")]], lang, "label").agg(F.count("*").alias("n"), F.avg(F.col("any_").cast("int")).alias("value"))
    add(seen, "detection", "label")
    add(C.confusion(gold, pred, [lang]).withColumnRenamed("share", "value"), "confusion", "label", F.col("predicted"))
    flagged = C.best_overlap(negs, pred).groupBy(lang, "label").agg(F.count("*").alias("n"), F.avg(F.col("pred_label").isNotNull().cast("int")).alias("value"))
    add(flagged, "negatives", "label")
    return out


def window_scores(spans: DataFrame, windows: DataFrame, scores: DataFrame) -> DataFrame:
    """``doc_id, first, last, label, score, votes``: each candidate span's mean score over the windows that hold both its words.

    Candidates ``doc_id, first, last, label`` in word numbers, windows ``doc_id, win, lo, hi`` (end exclusive), scores
    by candidate and window; a pair that a window cannot score has none there, and a candidate without any is dropped.
    A candidate meets the windows over the bin of words in which it begins.
    """
    word = I.binned(spans.withColumn("__next__", F.col("first") + 1), "first", "__next__", WORDS).alias("s")
    wide = I.binned(windows, "lo", "hi", WORDS).alias("w")
    inside = (F.col("s.doc_id") == F.col("w.doc_id")) & (F.col(f"s.{I.BIN}") == F.col(f"w.{I.BIN}")) & (F.col("w.lo") <= F.col("s.first")) & (F.col("s.last") < F.col("w.hi"))
    held = word.join(wide, inside).select("s.doc_id", "s.first", "s.last", "s.label", "w.win")
    both = held.join(scores, ["doc_id", "first", "last", "label", "win"]).where("score IS NOT NULL")
    return both.groupBy("doc_id", "first", "last", "label").agg(F.avg("score").alias("score"), F.count("*").alias("votes"))
