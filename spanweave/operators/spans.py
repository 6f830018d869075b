"""Span algebra: intervals over one text, as expressions on arrays of spans or as windows over rows of spans."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.offsets import batch_matches, bound, matches, part, scanned, upto
from spanweave.functions.text import SPACE, script_of
from spanweave.labels import IGNORE, NUMERIC, OUTSIDE, PLACE_ONLY
from spanweave.operators import intervals as I


_SPAN = "struct<start:int,end:int,label:string>"

# -- arrays of spans ---------------------------------------------------------------------------------------------


def shifted(spans: Column, by: Column) -> Column:
    """Spans moved by a number of code points."""
    return F.transform(spans, lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))


def resolved(spans: Column) -> Column:
    """Overlaps resolved in favour of the longer span.

    Spans are read by start, longest first, then label. One that overlaps the last kept span replaces it if it is
    longer and is dropped otherwise; so a chain keeps its ends. Element type: ``start, end, label``.
    """
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["label"].alias("label"))))
    ordered = F.transform(keyed, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["back"]).cast("int").alias("end"), s["label"].alias("label")).cast(_SPAN))
    return kept_longer(ordered, _SPAN)


def kept_longer(ordered: Column, kind: str) -> Column:
    """The fold of :func:`resolved` over spans in order; ``kind`` is their type, with ``start`` and ``end``.

    Spans are cut where one begins after all ends before it: only a run of several needs the fold.
    """
    none = F.array().cast(f"array<{kind}>")

    def runs(held: Column, ends: Column) -> Column:
        starts = F.filter(F.transform(held, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())

        def one(begun: Column, a: Column, k: Column) -> Column:
            n = F.coalesce(F.get(begun, k + 1), F.size(held)) - a
            return F.when(n == 1, F.slice(held, a + 1, n)).otherwise(_run_kept(F.slice(held, a + 1, n), kind))

        return bound(starts, lambda begun: F.when(F.size(begun) == F.size(held), held).otherwise(F.flatten(F.transform(begun, lambda a, k: one(begun, a, k)))))

    def cut(held: Column) -> Column:
        return bound(upto(F.transform(held, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda ends: runs(held, ends))

    return bound(F.coalesce(ordered, none), lambda held: F.when(F.size(held) > 0, cut(held)).otherwise(none))


def _run_kept(ordered: Column, kind: str) -> Column:
    """The fold over one run of spans."""
    none = F.lit(None).cast(kind)

    def clear(kept: Column, s: Column) -> Column:
        return kept.isNotNull() & (s.isNull() | (s["start"] >= kept["end"]))

    def step(kept: Column, s: Column) -> Column:
        longer = s["end"] - s["start"] > kept["end"] - kept["start"]
        return F.when(kept.isNull() | clear(kept, s) | longer, s).otherwise(kept)

    # The span kept last goes out when one begins after it; a closing null sends out the last.
    out = bound(F.concat(ordered, F.array(none)), lambda o: scanned(o, none, step, lambda kept, s: F.when(clear(kept, s), kept), kind))
    return F.coalesce(F.filter(out, lambda s: s.isNotNull()), F.array().cast(f"array<{kind}>"))


_SCORED = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType()).add("score", T.DoubleType()))


class _Disjoint:
    """Disjoint intervals in order, in lists of bounded length, so that one more costs a search and a short move."""

    MOST = 2_000

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.heads: list[tuple[int, int]] = []

    def add(self, start: int, end: int) -> bool:
        """Adds an interval unless it overlaps one that is there; the last that begins before its end is the only one to ask."""
        k = max(bisect_left(self.heads, (end, -1)) - 1, 0)
        at = bisect_left(self.blocks[k], (end, -1))
        if at and self.blocks[k][at - 1][1] > start:
            return False
        k = max(bisect_left(self.heads, (start, end)) - 1, 0)
        block = self.blocks[k]
        insort(block, (start, end))
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.heads[k : k + 1] = [block[0], block[half]]
        elif not self.heads:
            self.heads = [block[0]]
        else:
            self.heads[k] = block[0]
        return True


@F.arrow_udf(_SCORED)
def _greedy(column: pa.Array) -> pa.Array:
    flat = column.flatten()
    start, end, label, score = (flat.field(name) for name in ("start", "end", "label", "score"))
    starts, ends = start.to_pylist(), end.to_pylist()
    low = pa.array(pc.fill_null(score, -math.inf)).to_pylist()
    labels = label.to_pylist()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    taken, offsets, at = [], [0], 0
    for size in sizes:
        kept = _Disjoint()
        order = sorted(range(at, at + size), key=lambda k: (-low[k], labels[k] is None, labels[k] or "", starts[k], ends[k]))
        taken += [k for k in order if kept.add(starts[k], ends[k])]
        offsets.append(len(taken))
        at += size
    rows = flat.take(pa.array(taken, pa.int64()))
    fields = [rows.field(name).cast(kind) for name, kind in (("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64()))]
    found = pa.StructArray.from_arrays(fields, ["start", "end", "label", "score"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, mask=column.is_null())


def greedy(spans: Column) -> Column:
    """Non-overlapping spans by falling score; ties by label, start, end. Element type: ``start, end, label, score``.

    The kept spans of a text are disjoint, so a sorted structure answers whether another fits by one search; a fold
    of Spark's own would compare each with all that are kept, or copy them. A null score comes last.
    """
    return _greedy(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"), s["score"].cast("double").alias("score"))))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its label in square brackets; spans are disjoint."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))

    def joined(found: Column) -> Column:
        until = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
        pieces = F.transform(found, lambda s, i: F.concat(part(text, until(i), s["start"]), F.lit("["), s["label"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(text, until(F.size(found)), F.length(text)))

    return bound(ordered, lambda found: F.when(F.size(found) > 0, joined(found)).otherwise(text))


def spliced_text(text: Column, start: Column, end: Column, new: Column) -> Column:
    return F.concat(part(text, F.lit(0), start), new, part(text, end, F.length(text)))


def spliced_spans(spans: Column, start: Column, end: Column, new: Column) -> Column:
    """Spans after :func:`spliced_text`: later ones move, an equal one is resized, a containing one grows, others stay."""
    delta = F.length(new) - (end - start)

    def moved(s: Column) -> Column:
        after, equal = s["start"] >= end, (s["start"] == start) & (s["end"] == end)
        around = (s["end"] > start) & (s["end"] >= end)
        return F.struct(
            F.when(after, s["start"] + delta).otherwise(s["start"]).alias("start"),
            F.when(after, s["end"] + delta).when(equal, start + F.length(new)).when(around, s["end"] + delta).otherwise(s["end"]).alias("end"),
            s["label"].alias("label"),
        )

    return F.transform(spans, moved)


#: Opening and closing brackets in order, list punctuation before a value, and stops after one.
_OPEN, _CLOSE = "([{【「『（［", ")]}】」』）］"
_LEAD, _STOP = "、，,：:;；·・", ".。,，、;；:："


def trimmed(text: Column, start: Column, end: Column, label: Column) -> Column:
    """``start, end`` without glued punctuation, null if nothing remains.

    Leading list punctuation, white space and unmatched opening brackets go; so do trailing white space, unmatched
    closing brackets and, for number-like labels, stops after a digit or closing bracket; last, one pair of
    brackets around the whole. Each loop is a fold over as many steps as the span has characters.
    """
    value = part(text, start, end)
    size = F.length(value)
    opens, closes = F.lit(_OPEN), F.lit(_CLOSE)
    numeric = label.isin(*NUMERIC)

    def at(s: Column, k: Column) -> Column:
        return F.substring(s, k.cast("int"), 1)

    def within(c: Column, chars: Column | str) -> Column:
        return (c != "") & (F.instr(F.lit(chars) if isinstance(chars, str) else chars, c) > 0)

    def blank(c: Column) -> Column:
        return c.rlike(r"^[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]$")

    steps = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))

    def front(s: Column, _: Column) -> Column:
        c = at(s, F.lit(1))
        lone = within(c, opens) & ~s.rlike(f"[{''.join(chr(92) + x for x in _CLOSE)}]")
        return F.when((s != "") & (within(c, _LEAD) | blank(c) | lone), F.substring(s, F.lit(2), F.length(s))).otherwise(s)

    head = F.aggregate(steps, value, front)

    def back(s: Column, _: Column) -> Column:
        n = F.length(s)
        c, before, rest = at(s, n), F.when(n > 1, at(s, n - 1)).otherwise(F.lit("")), F.substring(s, F.lit(1), n - 1)
        partner = F.translate(c, _CLOSE, _OPEN)
        lone = within(c, closes) & (F.instr(rest, partner) == 0)
        stop = numeric & within(c, _STOP) & (before.rlike(r"^\p{Nd}$") | within(before, closes))
        return F.when((s != "") & (blank(c) | lone | stop), rest).otherwise(s)

    body = F.aggregate(steps, head, back)
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    pair = F.translate(at(body, F.length(body)), _CLOSE, _OPEN) == at(body, F.lit(1))
    wrapped = (F.length(body) > 2) & within(at(body, F.lit(1)), opens) & pair & ~inner.rlike(f"[{''.join(chr(92) + x for x in _OPEN + _CLOSE)}]")
    begin = start + size - F.length(head) + wrapped.cast("int")
    stop = start + size - F.length(head) + F.length(body) - wrapped.cast("int")
    return F.when(stop > begin, F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("end")))


# -- rows of spans -----------------------------------------------------------------------------------------------


def overlap_rows(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`resolved` over rows ``key, start, end, label``."""
    grouped = spans.groupBy(key).agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    return grouped.select(key, F.explode(resolved(F.col("spans"))).alias("s")).select(key, "s.start", "s.end", "s.label")


def _joins(text: Column, last: dict[str, Column] | Column, span: dict[str, Column] | Column, gap: dict[str, str] | None, default: str) -> Column:
    """Whether a span goes on with the one before it: one label, and a gap of the label's pattern."""
    between = part(text, last["end"], span["start"])
    fits = between.rlike(default)
    for label, pattern in (gap if gap is not None else {"ADDRESS": r"^[\s,]*$"}).items():
        fits = F.when(span["label"] == label, between.rlike(pattern)).otherwise(fits)
    return F.coalesce((last["label"] == span["label"]) & (span["label"] != IGNORE) & fits, F.lit(False))


def merged_spans(text: Column, spans: Column, gap: dict[str, str] | None = None, default: str = r"^[ \t]*$") -> Column:
    """:func:`merged_adjacent` over the array of a text's own spans: ``start, end, label, parts``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))

    def islands(found: Column) -> Column:
        breaks = F.transform(found, lambda s, i: F.when(~_joins(text, F.get(found, i - 1), s, gap, default), i))

        def cut(starts: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                n = F.coalesce(F.get(starts, k + 1), F.size(found)) - a
                inside = F.slice(found, a + 1, n)
                return F.struct(F.get(found, a)["start"].alias("start"), F.array_max(F.transform(inside, lambda s: s["end"])).alias("end"), F.get(found, a)["label"].alias("label"), n.cast("long").alias("parts"))

            return F.transform(starts, one)

        return bound(F.filter(breaks, lambda i: i.isNotNull()), cut)

    return bound(ordered, islands)


def merged_adjacent(spans: DataFrame, key: str = "doc_id", text: str = "text", gap: dict[str, str] | None = None, default: str = r"^[ \t]*$") -> DataFrame:
    """Neighbouring spans of one label become one where the text between them matches the label's gap pattern.

    Rows ``key, text, start, end, label`` hold disjoint spans; IGNORE never merges. Islands are numbered by a running
    sum of breaks. Adds ``parts``, the number of spans merged. Each row carries its text: where spans are found in the
    text's own row, :func:`merged_spans` needs no shuffle.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    last = {c: F.lag(c).over(order) for c in ("end", "label")}
    joins = _joins(F.col(text), last, {c: F.col(c) for c in ("start", "label")}, gap, default)
    rows = spans.withColumn("break", F.when(joins, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), F.count("*").alias("parts")).drop("island")


#: Words that only join the parts of an address, of all languages.
JOINERS = [
    "号", "號", "街", "路", "道", "巷", "弄", "栋", "棟", "楼", "樓", "层", "層", "室", "座", "邮编", "郵編", "邮政编码",
    "郵遞區號", "号館の", "番地", "丁目", "番", "〒", "の", "郵便番号", "우편번호", "번길", "번지", "동", "호",
    "số", "đường", "phường", "quận", "mã bưu điện", "jalan", "jln", "lorong", "poskod", "kode pos", "blk", "block",
    "zip", "postal code", "postcode", "p.o. box", "street", "road", "unit", "floor", "flr", "level", "no", "no.",
    "ซอย", "ถนน", "แขวง", "เขต", "รหัสไปรษณีย์", "शहर", "पिन", "पिन कोड", "ص.ب", "الرمز البريدي", "شارع",
    "barangay", "brgy", "kalye", "zip code", "trên", "tại", "ở", "and", "in", "at", "에", "이며", "는", "은",
]
MAX_GAP = 25
#: A postcode on its own (fixed formats), and what may stand between the parts of an address beside joiners.
POSTCODE = r"^(?:\p{Nd}{3}-\p{Nd}{4}|\p{Nd}{4,6}|[A-Z]{1,2}\p{Nd}[A-Z\p{Nd}]? ?\p{Nd}[A-Z]{2})$"
FILLER = rf"^[{SPACE}\p{{Nd}},，、.。:：;；#\-–/()（）\[\]'\"「」]*$"


def joiner_pattern() -> str:
    """Longest joiner first, so that none hides a longer one."""
    longest = sorted(JOINERS, key=len, reverse=True)
    return "|".join("".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in w) for w in longest)


def merged_addresses(spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fragments of an address become one span; a postcode left alone becomes IGNORE. Adds ``parts``.

    A fragment joins the address before it if the gap has at most ``MAX_GAP`` characters, no blank line and no spaced
    slash, holds only filler once joiner words are gone, and no span of another label lies across it. One fold over
    the spans of a text.
    """
    grouped = spans.groupBy(key).agg(F.first(text).alias(text), F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("s"))
    kind = "struct<start:int,end:int,parts:bigint>"
    beyond = 2**31 - 1
    end = F.struct(F.lit(beyond).alias("start"), F.lit(beyond).alias("end"), F.lit("ADDRESS").alias("label"))
    said, others = F.col(text), F.filter("s", lambda o: o["label"] != "ADDRESS")

    def joins(p: Column, s: Column) -> Column:
        gap = part(said, p["end"], s["start"])
        filled = F.regexp_replace(gap, f"(?iu){joiner_pattern()}", "").rlike(FILLER)
        across = F.exists(others, lambda o: (o["start"] < s["start"]) & (o["end"] > p["end"]))
        near = (s["start"] < beyond) & (s["start"] >= p["end"]) & (s["start"] - p["end"] <= MAX_GAP)
        return F.coalesce(near & ~gap.contains("\n\n") & ~gap.contains(" / ") & filled & ~across, F.lit(False))

    def step(p: Column, s: Column) -> Column:
        grown = F.struct(p["start"].alias("start"), F.greatest(p["end"], s["end"]).alias("end"), (p["parts"] + 1).alias("parts")).cast(kind)
        return F.when(joins(p, s), grown).otherwise(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(1).alias("parts")).cast(kind))

    items = F.concat(F.filter("s", lambda o: o["label"] == "ADDRESS"), F.array(end))
    found = bound(items, lambda i: scanned(i, F.lit(None).cast(kind), step, lambda p, s: F.when(p.isNotNull() & ~joins(p, s), p), kind))
    lone = lambda p: (p["parts"] == 1) & F.regexp_replace(part(said, p["start"], p["end"]), rf"^[{SPACE}]+|[{SPACE}]+$", "").rlike(POSTCODE)
    whole = F.transform(F.filter(found, lambda p: p.isNotNull()), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(lone(p), IGNORE).otherwise("ADDRESS").alias("label"), p["parts"].alias("parts")))
    rest = F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["label"].alias("label"), F.lit(1).cast("long").alias("parts")))
    return grouped.select(key, F.explode(F.concat(whole, rest)).alias("x")).select(key, "x.start", "x.end", "x.label", "x.parts")


#: An address field named just before a span, on its line (fixed words).
ADDRESS_CUE = r"(?i)(?:address|addr\.?|city|town|state|province|country|county|post ?code|zip|residen[\p{L}\p{M}\p{N}_]*|located at|domicile)[^\p{L}\p{M}\p{N}_]{0,3}\z"
STREET_TAIL = r"^,[^\n.;|()]{1,80}"


def line_before(text: Column, start: Column, window: int = 40) -> Column:
    """The text of the same line before ``start``, at most ``window`` characters."""
    return F.substring_index(part(text, F.greatest(start - window, F.lit(0)), start), "\n", -1)


def bare_places(spans: DataFrame, text: str = "text", raw: str = "raw") -> DataFrame:
    """Adds ``place``: true for an ADDRESS made only of place names without an address field before it."""
    only = F.size(F.array_except(F.col(raw), F.array(*map(F.lit, PLACE_ONLY)))) == 0
    cue = line_before(F.col(text), F.col("start")).rlike(ADDRESS_CUE)
    return spans.withColumn("place", (F.col("label") == "ADDRESS") & only & ~cue)


def street_tails(spans: DataFrame, key: str = "doc_id", text: str = "text", raw: str = "raw") -> DataFrame:
    """IGNORE spans over the unlabelled rest of an address that a street-only span begins, up to the next span."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    rows = spans.withColumn("next", F.coalesce(following, F.length(text)))
    tail = F.regexp_extract(part(F.col(text), F.col("end"), F.length(text)), STREET_TAIL, 0)
    stop = F.col("end") + F.length(tail)
    rows = rows.where((F.col("label") == "ADDRESS") & (F.array_sort(raw) == F.array(F.lit("street_address"))) & (tail != "") & (stop <= F.col("next")))
    return rows.select(key, F.col("end").alias("start"), stop.alias("end"), F.lit(IGNORE).alias("label"))


def violations(spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans that break an invariant: bounds outside the text, white space at an edge, or overlap with an earlier span."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("until", F.max("end").over(before))
    value = part(F.col(text), F.col("start"), F.col("end"))
    why = (
        F.when((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length(text)), "bounds")
        .when(value.rlike(r"^\s|\s$"), "edge")
        .when(F.col("start") < F.col("until"), "overlap")
    )
    return rows.select(key, "start", "end", "label", why.alias("why")).where("why IS NOT NULL")


# -- tokens ------------------------------------------------------------------------------------------------------


TOKEN = r"[^ \t\r\n]+"


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """``key, i, s, e, tok``: matches of ``pattern`` with offsets, numbered from 0; found within the row, without a shuffle."""
    rows = docs.select(key, F.posexplode(batch_matches(F.col(text), pattern)).alias("i", "t"))
    return rows.select(key, "i", F.col("t.start").alias("s"), F.col("t.end").alias("e"), F.col("t.value").alias("tok"))


#: Tokens that are compared with the spans over their stretch only.
_STRETCH = 64


def bio_tags(toks: Column, spans: Column) -> Column:
    """The tag of every token of a text, by the rule of :func:`bio_encoded`; both arrays have ``start, end``, spans a ``label``.

    Tokens are in order. Without spans all are outside; otherwise each stretch of tokens takes the spans over it, and
    each token of the stretch looks through those.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))

    def tag(hit: Column, before: Column) -> Column:
        prefix = F.when(F.coalesce(before == hit, F.lit(False)), F.lit("I-")).otherwise(F.lit("B-"))
        return F.when(hit.isNull() | (hit["label"] == OUTSIDE), F.lit(OUTSIDE)).when(hit["label"] == IGNORE, F.lit(None)).otherwise(F.concat(prefix, hit["label"]))

    def over(found: Column, start: Column, end: Column) -> Column:
        return F.filter(found, lambda s: (s["start"] < end) & (start < s["end"]))

    def tagged_by(toks: Column, found: Column) -> Column:
        none = F.slice(found, F.lit(1), F.lit(0))

        def stretch(part: Column) -> Column:
            near = over(found, F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"])
            return bound(near, lambda some: F.when(F.size(some) > 0, F.transform(part, lambda t: F.get(over(some, t["start"], t["end"]), F.lit(0)))).otherwise(F.transform(part, lambda t: F.get(none, F.lit(0)))))

        stretches = F.sequence(F.lit(0), F.floor((F.size(toks) - 1) / _STRETCH).cast("int"))
        hits = F.flatten(F.transform(stretches, lambda k: bound(F.slice(toks, k * _STRETCH + 1, F.lit(_STRETCH)), stretch)))
        some = bound(hits, lambda h: F.transform(h, lambda hit, i: tag(hit, F.get(h, i - 1))))
        return F.when((F.size(found) > 0) & (F.size(toks) > 0), some).otherwise(F.transform(toks, lambda t: F.lit(OUTSIDE)))

    return bound(toks, lambda held: bound(ordered, lambda found: tagged_by(held, found)))


def bio_encoded(toks: DataFrame, spans: DataFrame, key: str = "doc_id", partial: Column | None = None) -> DataFrame:
    """``key, i, tag``: the tag of every token, null where the loss is masked.

    A token takes the first span that overlaps it; ``B`` unless the token before has the same span. IGNORE spans
    mask, spans labelled ``O`` are outside, and ``partial`` (all, digits, letters) masks outside tokens of a source
    that is annotated only in part.
    """
    left = I.binned(toks, "s", "e", outer=True).alias("t")
    hit = left.join(I.binned(spans).alias("g"), I.meets("t", "g", key, bounds=("s", "e")), "left")
    first = hit.groupBy(F.col(f"t.{key}").alias(key), F.col("t.i").alias("i"), F.col("t.tok").alias("tok")).agg(F.min(F.when(F.col("g.start").isNotNull(), F.struct("g.start", "g.end", "g.label"))).alias("g"))
    before = F.lag("g").over(Window.partitionBy(key).orderBy("i"))
    label = F.col("g.label")
    masked_out = F.lit(False)
    if partial is not None:
        masked_out = (partial == "all") | ((partial == "digits") & F.col("tok").rlike(r"\p{Nd}")) | ((partial == "letters") & F.col("tok").rlike(r"\p{L}"))
    outside = F.when(F.coalesce(masked_out, F.lit(False)), F.lit(None)).otherwise(F.lit(OUTSIDE))
    prefix = F.when(F.coalesce(before == F.col("g"), F.lit(False)) & F.col("g.start").isNotNull(), F.lit("I-")).otherwise(F.lit("B-"))
    tag = F.when(label.isNull(), outside).when(label == OUTSIDE, F.lit(OUTSIDE)).when(label == IGNORE, F.lit(None)).otherwise(F.concat(prefix, label))
    return first.select(key, "i", tag.alias("tag"))


def bio_decoded(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, end, label`` from rows ``key, i, s, e, tag``; null tags and empty tokens are skipped."""
    rows = tagged.where("tag IS NOT NULL AND s < e")
    order = Window.partitionBy(key).orderBy("i")
    label = F.when(F.col("tag") != OUTSIDE, F.substring("tag", 3, 1000))
    rows = rows.withColumn("label", label).withColumn("before", F.lag("label").over(order))
    goes_on = F.col("tag").startswith("I-") & F.coalesce(F.col("before") == F.col("label"), F.lit(False))
    rows = rows.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("label IS NOT NULL").groupBy(key, "island", "label").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("island")


def bio_spans(toks: Column, tags: Column) -> Column:
    """:func:`bio_decoded` of the arrays of a text's own tokens, in order, and their tags: ``start, end, label``, without a shuffle."""
    named = lambda tag: F.when(tag != OUTSIDE, F.substring(tag, 3, 1000))
    rows = F.filter(F.zip_with(toks, tags, lambda t, tag: F.struct(t["start"].alias("start"), t["end"].alias("end"), tag.alias("tag"))), lambda r: r["tag"].isNotNull() & (r["start"] < r["end"]))

    def hit(held: Column, r: Column, i: Column) -> Column:
        goes_on = r["tag"].startswith("I-") & F.coalesce(named(F.get(held, i - 1)["tag"]) == named(r["tag"]), F.lit(False))
        return F.when(r["tag"] != OUTSIDE, F.struct(r["start"].alias("start"), r["end"].alias("end"), named(r["tag"]).alias("label"), goes_on.alias("goes_on")))

    def cut(found: Column) -> Column:
        starts = F.filter(F.transform(found, lambda h, i: F.when(~h["goes_on"], i)), lambda i: i.isNotNull())

        def one(begun: Column, a: Column, k: Column) -> Column:
            inside = F.slice(found, a + 1, F.coalesce(F.get(begun, k + 1), F.size(found)) - a)
            return F.struct(F.get(found, a)["start"].alias("start"), F.array_max(F.transform(inside, lambda h: h["end"])).alias("end"), F.get(found, a)["label"].alias("label"))

        return bound(starts, lambda begun: F.transform(begun, lambda a, k: one(begun, a, k)))

    hits = bound(rows, lambda held: F.filter(F.transform(held, lambda r, i: hit(held, r, i)), lambda h: h.isNotNull()))
    return bound(hits, cut)


def continued_tags(items: Column) -> Column:
    """:func:`continued` of the array of a text's own tokens (``first, tag``), in order: the filled tags, without a shuffle."""
    none = F.lit(None).cast("string")

    def head(state: Column, x: Column) -> Column:
        return F.when(x["first"], none).otherwise(state)

    def filled(state: Column, x: Column) -> Column:
        own = head(state, x)
        return F.when(own.isNull(), x["tag"]).when(own == OUTSIDE, F.lit(OUTSIDE)).otherwise(F.concat(F.lit("I-"), F.substring(own, 3, 1000)))

    return bound(items, lambda held: scanned(held, none, lambda s, x: F.coalesce(head(s, x), x["tag"]), filled, "string"))


def continued(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``key, i, first, tag``: tokens that continue a word take its first token's tag, as inside; null heads stay null.

    A word's head is its first token; while it has no tag, the next token that has one becomes the head.
    """
    order = Window.partitionBy(key).orderBy("i")
    rows = tagged.withColumn("word", F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(key, "word").orderBy("i")
    head = F.first("tag", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", F.row_number().over(within)).withColumn("head", head)
    first_at = F.min(F.when(F.col("tag").isNotNull(), F.col("at"))).over(within.rowsBetween(Window.unboundedPreceding, 0))
    filled = F.when(F.col("head").isNull() | (F.col("at") == first_at), F.col("tag")).when(F.col("head") == OUTSIDE, F.lit(OUTSIDE)).otherwise(F.concat(F.lit("I-"), F.substring("head", 3, 1000)))
    return rows.withColumn("filled", filled).select(key, "i", "filled")


def windows(counts: DataFrame, n: str = "n", body: int = 382, stride: int = 96) -> DataFrame:
    """One row for each window over ``n`` tokens: ``win, lo, hi``; the last window ends at ``n`` and at least one exists."""
    step = max(1, body - stride)
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - body) / F.lit(step))).cast("int")
    rows = counts.withColumn("win", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("lo", F.col("win") * step).withColumn("hi", F.least(F.col("win") * step + body, F.col(n)))


def forced_begin(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """The first tagged token of each window begins a span, even if the span began before the window."""
    order = Window.partitionBy(*keys).orderBy("i")
    first = F.min(F.when(F.col("tag").isNotNull(), F.col("i"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tag = F.when((F.col("i") == first) & F.col("tag").startswith("I-"), F.concat(F.lit("B-"), F.substring("tag", 3, 1000))).otherwise(F.col("tag"))
    return tagged.withColumn("tag", tag)


def voted(votes: DataFrame, keys: list[str], how: str = "max") -> DataFrame:
    """One label for each token seen by several windows: rows ``keys, win, i, lo, hi, tag, p``.

    ``max`` takes the most confident window, ``central`` the one where the token lies deepest, then confidence; the
    earlier window wins ties. ``avg`` takes the label of the greatest mean confidence, ties by label.
    """
    if how == "avg":
        means = votes.groupBy(*keys, "tag").agg(F.avg("p").alias("p"))
        best = means.groupBy(*keys).agg(F.max(F.struct("p", "tag")).alias("b"))
        return best.select(*keys, F.col("b.tag").alias("tag"), F.col("b.p").alias("p"))
    depth = F.least(F.col("i") - F.col("lo"), F.col("hi") - F.col("i"))
    key = F.struct("p", -F.col("win")) if how == "max" else F.struct(depth, "p", -F.col("win"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct("tag", "p"), key).alias("b")).select(*keys, "b.tag", "b.p")


def voted_in_row(votes: Column, how: str = "max") -> Column:
    """:func:`voted` of the array of one token's own votes (``win, lo, hi, i, tag, p``): its ``tag, p``, without a shuffle."""
    if how == "avg":

        def mean(tag: Column) -> Column:
            own = F.filter(votes, lambda v: v["tag"].eqNullSafe(tag))
            total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v["p"])
            return F.struct((total / F.size(own)).alias("p"), tag.alias("tag"))

        best = F.array_max(F.transform(F.array_distinct(F.transform(votes, lambda v: v["tag"])), mean))
    else:
        depth = (lambda v: (F.least(v["i"] - v["lo"], v["hi"] - v["i"]),)) if how == "central" else (lambda v: ())
        best = F.array_max(F.transform(votes, lambda v: F.struct(*depth(v), v["p"].alias("p"), (-v["win"]).alias("win"), v["tag"].alias("tag"))))
    return bound(best, lambda b: F.struct(b["tag"].alias("tag"), b["p"].alias("p")))


def edited_offsets(edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``key, start, end, new`` of disjoint edits with ``new_start, new_end`` after all of them: old offsets plus earlier changes of length."""
    order = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.length("new") - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(delta).over(order), F.lit(0))
    rows = edits.withColumn("new_start", (F.col("start") + before).cast("int"))
    return rows.withColumn("new_end", F.col("new_start") + F.length("new"))


def word_starts(toks: DataFrame, key: str = "doc_id", by_script: bool = False) -> DataFrame:
    """Token rows ``key, i, s, e, tok`` with ``first``: whether the token begins a word.

    After a gap, at punctuation and after it; with ``by_script`` also at every token of a script without spaces and
    where the script changes.
    """
    order = Window.partitionBy(key).orderBy("i")
    rows = toks.withColumn("pe", F.lag("e").over(order)).withColumn("pt", F.lag(F.substring("tok", -1, 1)).over(order))
    return rows.withColumn("first", _begins(F.col("tok"), F.col("s"), F.col("pe"), F.col("pt"), by_script)).drop("pe", "pt")


def _begins(tok: Column, start: Column, end: Column, tail: Column, by_script: bool) -> Column:
    """Whether a token begins a word, after one that ended at ``end`` with the letter ``tail``."""
    head, word = F.substring(tok, 1, 1), r"[\p{L}\p{N}]"
    new = end.isNull() | (start > end) | ~head.rlike(word) | ~tail.rlike(word)
    if by_script:
        new = new | script_of(head).isin("han", "kana", "thai") | (script_of(head) != script_of(tail))
    return F.coalesce(new, F.lit(True))


def word_begins(toks: Column, by_script: bool = False) -> Column:
    """:func:`word_starts` of the array of a text's own tokens (``start, end, value``), in order: a boolean for each, without a shuffle."""

    def one(held: Column, t: Column, i: Column) -> Column:
        last = F.get(held, i - 1)
        return _begins(t["value"], t["start"], last["end"], F.substring(last["value"], -1, 1), by_script)

    return bound(toks, lambda held: F.transform(held, lambda t, i: one(held, t, i)))


def encoded_windows(text: Column, spans: Column, body: int = 382, stride: int = 96, pattern: str = TOKEN, first: Callable[[Column], Column] | None = None, label_all: bool = False) -> Column:
    """Array of ``win, lo, hi, tags`` of a text with spans: its tokens in sliding windows, a null tag at both ends for the special tokens.

    ``first`` takes the tokens to an array that says which begin a word (all of them by default). Tokens that go on
    with a word have no tag, or with ``label_all`` the inside tag of it. A window that starts inside a span begins it.
    """

    def tags(toks: Column) -> Column:
        own = bio_tags(toks, spans)
        if first is None:
            return own
        begins = first(toks)

        def carried(found: Column) -> Column:
            word = scanned(F.arrays_zip(found.alias("tag"), begins.alias("first")), F.lit(None).cast("string"), lambda s, x: F.when(x["first"], x["tag"]).otherwise(s), lambda s, x: F.when(x["first"], x["tag"]).otherwise(F.when(s == OUTSIDE, s).otherwise(F.concat(F.lit("I-"), F.substring(s, 3, 1 << 30)))), "string")
            return word if label_all else F.zip_with(word, begins, lambda t, b: F.when(b, t))

        return bound(own, carried)

    def cut(found: Column) -> Column:
        n, step = F.size(found), max(1, body - stride)
        last = F.greatest(F.lit(0), F.ceil((n - body) / F.lit(step))).cast("int")
        edge = F.array(F.lit(None).cast("string"))

        def window(w: Column) -> Column:
            def begun(part_: Column) -> Column:
                first = F.array_position(F.transform(part_, lambda t: t.isNotNull()), F.lit(True)).cast("int")
                forced = lambda t: F.when(t.startswith("I-"), F.concat(F.lit("B-"), F.substring(t, 3, 1 << 30))).otherwise(t)
                return bound(first, lambda k: F.when(k > 0, F.concat(F.slice(part_, F.lit(1), k - 1), F.array(forced(F.get(part_, k - 1))), F.slice(part_, k + 1, F.size(part_)))).otherwise(part_))

            tags_ = F.concat(edge, bound(F.slice(found, w * step + 1, F.lit(body)), begun), edge)
            return F.struct(w.alias("win"), (w * step).alias("lo"), F.least(w * step + body, n).alias("hi"), tags_.alias("tags"))

        return F.transform(F.sequence(F.lit(0), last), window)

    return bound(matches(text, pattern), lambda toks: bound(tags(toks), cut))
