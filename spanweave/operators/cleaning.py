"""Raw spans of a source to target labels: one expression over the spans of a text, with a counter for every rule.

The steps follow each other within the row: labels are mapped, unclear dates decided by their cue, bounds checked,
white space trimmed, overlaps resolved for the longer span, neighbours merged, bare places set apart, and the rest
of an address after a street masked. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions import values as V
from spanweave.functions.offsets import bound, part
from spanweave.functions.text import SPACE
from spanweave.labels import DATE_CUE, IGNORE, PLACE_ONLY
from spanweave.operators.spans import ADDRESS_CUE, STREET_TAIL, kept_longer, line_before

_RAW = "struct<start:int,end:int,label:string,raw:array<string>>"
_PLAIN = "struct<start:int,end:int,label:string>"
#: What may stand between two spans of a label that become one.
GAPS = {"ADDRESS": rf"^[{SPACE},]*\z"}
GAP = r"^[ \t]*\z"


def english_birth_cue(text: Column, start: Column, end: Column) -> Column:
    """Whether a birth word stands before a date on its line."""
    return line_before(text, start).rlike(V.BIRTH_CUE)


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv)) if entries else F.create_map().cast("map<string,string>")


def _plain(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label")).cast(_PLAIN)


def merged(text: Column, spans: Column) -> Column:
    """Disjoint spans ``start, end, label, raw`` in order, neighbours of one label joined where the gap allows; their raw labels add up."""

    def joins(p: Column, s: Column) -> Column:
        gap = part(text, p["end"], s["start"])
        fits = gap.rlike(GAP)
        for label, pattern in GAPS.items():
            fits = F.when(s["label"] == label, gap.rlike(pattern)).otherwise(fits)
        return F.coalesce((s["label"] == p["label"]) & (s["label"] != IGNORE) & fits, F.lit(False))

    def cut(held: Column) -> Column:
        # What is joined so far ends where its last span does and has its label, so neighbours alone decide.
        starts = F.filter(F.transform(held, lambda s, i: F.when((i == 0) | ~joins(F.get(held, i - 1), s), i)), lambda i: i.isNotNull())

        def one(begun: Column, a: Column, k: Column) -> Column:
            n = F.coalesce(F.get(begun, k + 1), F.size(held)) - a
            own = F.slice(held, a + 1, n)
            first = F.get(held, a)
            whole = F.struct(first["start"].alias("start"), F.get(held, a + n - 1)["end"].alias("end"), first["label"].alias("label"), F.array_distinct(F.flatten(F.transform(own, lambda s: s["raw"]))).alias("raw"))
            return F.when(n == 1, first).otherwise(whole.cast(_RAW))

        return bound(starts, lambda begun: F.transform(begun, lambda a, k: one(begun, a, k)))

    return bound(spans, cut)


def cleaned(
    text: Column,
    spans: Column,
    mapping: dict[str, str],
    lookalikes: dict[str, str] | None = None,
    street_tails: Column | bool = False,
    birth_cue: Callable[[Column, Column, Column], Column] = english_birth_cue,
) -> Column:
    """Struct ``spans, negs, stats`` of a text and its raw spans ``start, end, label``.

    ``mapping`` takes raw labels to targets, ``DATE_CUE`` among them, which ``birth_cue`` makes DOB or nothing; raw
    labels without a target whose group is in ``lookalikes`` become negatives, and so do bare places. A DOB without a
    digit becomes IGNORE. Invalid and blank spans go. ``stats`` counts what each rule did. Null spans count as none.
    """
    targets, groups = _table(mapping), _table(lookalikes or {})
    given = F.coalesce(spans, F.array().cast(f"array<{_PLAIN}>"))
    size = F.length(text)

    def read(s: Column) -> Column:
        value = part(text, s["start"], s["end"])
        mapped = F.try_element_at(targets, s["label"])
        inside = F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size), F.lit(False))
        date = F.coalesce(mapped == DATE_CUE, F.lit(False))
        born = date & F.coalesce(birth_cue(text, s["start"], s["end"]), F.lit(False))
        known = F.struct(mapped.alias("mapped"), value.alias("value"), inside.alias("inside"), date.alias("date"), born.alias("born"))
        return bound(known, lambda k: judged_raw(s, k))

    def judged_raw(s: Column, k: Column) -> Column:
        target = F.when(k["born"], F.lit("DOB")).when(~k["date"], k["mapped"])
        filled = k["inside"] & k["value"].rlike(rf"[^{SPACE}]")
        placeholder = F.coalesce((target == "DOB") & filled & ~k["value"].rlike(r"\p{Nd}"), F.lit(False))
        return F.struct(
            k["date"].alias("date"), k["born"].alias("born"), k["inside"].alias("inside"), filled.alias("filled"), placeholder.alias("placeholder"),
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("raw"), k["value"].alias("value"),
            F.when(placeholder, F.lit(IGNORE)).otherwise(target).alias("target"), F.when(target.isNull(), F.try_element_at(groups, s["label"])).alias("group"),
        )

    def trimmed(r: Column) -> Column:
        lead = F.length(r["value"]) - F.length(F.regexp_replace(r["value"], rf"^[{SPACE}]+", ""))
        tail = F.length(r["value"]) - F.length(F.regexp_replace(r["value"], rf"[{SPACE}]+\z", ""))
        return F.struct((r["start"] + lead).alias("start"), (r["end"] - tail).alias("end"), r["target"].alias("label"), F.array(r["raw"]).alias("raw")).cast(_RAW)

    def finish(rows: Column, whole: Column, kept: Column, joined: Column) -> Column:
        def bare(m: Column) -> Column:
            only = F.size(F.array_except(m["raw"], F.array(*map(F.lit, PLACE_ONLY)))) == 0
            return (m["label"] == "ADDRESS") & only & ~line_before(text, m["start"]).rlike(ADDRESS_CUE)

        def tail(m: Column, i: Column) -> Column:
            after = F.length(F.regexp_extract(part(text, m["end"], size), STREET_TAIL, 0))
            until = F.coalesce(F.get(joined, i + 1)["start"], size)
            street = (m["label"] == "ADDRESS") & (m["raw"] == F.array(F.lit("street_address")))
            on = street_tails if isinstance(street_tails, Column) else F.lit(street_tails)
            return F.when(on & street & (after > 0) & (m["end"] + after <= until), _plain(m["end"], m["end"] + after, F.lit(IGNORE)))

        def judged(m: Column, i: Column) -> Column:
            return bound(bare(m), lambda place: F.struct(_plain(m["start"], m["end"], m["label"]).alias("span"), place.alias("place"), F.when(~place, tail(m, i)).alias("tail")))

        return bound(F.transform(joined, judged), lambda j: summed(rows, whole, kept, joined, j))

    def summed(rows: Column, whole: Column, kept: Column, joined: Column, judged: Column) -> Column:
        own = F.flatten(F.transform(judged, lambda j: F.array(F.when(~j["place"], j["span"]), j["tail"])))
        found = F.filter(own, lambda s: s.isNotNull())
        places = F.transform(F.filter(judged, lambda j: j["place"]), lambda j: _plain(j["span"]["start"], j["span"]["end"], F.lit("place")))
        negs = F.transform(F.filter(rows, lambda r: r["group"].isNotNull() & r["inside"]), lambda r: _plain(r["start"], r["end"], r["group"]))
        count = lambda test: F.size(F.filter(rows, test))
        stats = F.struct(
            count(lambda r: r["born"]).alias("date_cue_dob"), count(lambda r: r["date"] & ~r["born"]).alias("date_cue_o"),
            count(lambda r: r["target"].isNotNull() & ~r["filled"]).alias("invalid"), count(lambda r: r["placeholder"]).alias("dob_placeholder"),
            (F.size(whole) - F.size(kept)).alias("overlap_dropped"), (F.size(kept) - F.size(joined)).alias("merged"),
            F.size(places).alias("address_bare_place_to_O"), F.size(F.filter(judged, lambda j: j["tail"].isNotNull())).alias("address_tail_ignored"),
        )
        return F.struct(found.alias("spans"), F.concat(negs, places).alias("negs"), stats.alias("stats"))

    def ordered(rows: Column) -> Column:
        usable = F.transform(F.filter(rows, lambda r: r["target"].isNotNull() & r["filled"]), trimmed)
        keyed = F.array_sort(F.transform(usable, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s"))))
        return F.transform(keyed, lambda k: k["s"])

    def with_rows(rows: Column) -> Column:
        return bound(ordered(rows), lambda whole: bound(kept_longer(whole, _RAW), lambda kept: bound(merged(text, kept), lambda joined: finish(rows, whole, kept, joined))))

    return bound(F.transform(given, read), with_rows)


def is_english(lang: Column, source: Column | None = None, always: tuple[str, ...] = ()) -> Column:
    """Whether a row's language is ``en`` or begins with ``english``, whatever its case; rows of some sources always are."""
    named = F.lower(F.regexp_replace(F.coalesce(lang, F.lit("")), rf"^[{SPACE}]+|[{SPACE}]+\z", ""))
    found = (named == "en") | named.startswith("english")
    return found if source is None else found | F.coalesce(source.isin(*always), F.lit(False))


def has_label(spans: Column, label: str) -> Column:
    """Whether any span has a label."""
    return F.exists(spans, lambda s: s["label"] == label)


def has_target(spans: Column) -> Column:
    """Whether any span is not masked."""
    return F.exists(spans, lambda s: s["label"] != IGNORE)


def without_types(rows: DataFrame, types: list[str], spans: str = "spans", kind: str | None = None) -> DataFrame:
    """Rows that neither are of one of some types (column ``kind``) nor have a span of one."""
    out = rows.where(~F.exists(spans, lambda s: s["label"].isin(types)))
    return out.where(F.col(kind).isNull() | ~F.col(kind).isin(types)) if kind else out


def normalized(
    rows: DataFrame,
    mapping: dict[str, str],
    lookalikes: dict[str, str] | None = None,
    language: Callable[[DataFrame], Column] | None = None,
    tail_sources: tuple[str, ...] = (),
    birth_cue: Callable[[Column, Column, Column], Column] = english_birth_cue,
) -> DataFrame:
    """``id, source, text, spans, negs, stats`` of raw rows ``id, source, text, spans``.

    Rows of another language (``language`` of the frame is a condition) and without text go; everything else is
    :func:`cleaned`. ``tail_sources`` are those whose addresses end at the street.
    """
    kept = rows.where(language(rows)) if language else rows
    kept = kept.where(F.col("text").rlike(rf"[^{SPACE}]"))
    out = cleaned(F.col("text"), F.col("spans"), mapping, lookalikes, F.coalesce(F.col("source").isin(*tail_sources), F.lit(False)) if tail_sources else False, birth_cue)
    return kept.select(F.concat_ws("-", "source", F.col("id").cast("string")).alias("id"), "source", "text", out.alias("c")).select("id", "source", "text", "c.spans", "c.negs", "c.stats")


def counted(rows: DataFrame, by: str = "source") -> DataFrame:
    """``by, rule, n``: what every rule of :func:`cleaned` did, zeros included."""
    names = rows.schema["stats"].dataType.names
    sums = rows.groupBy(by).agg(*(F.sum(F.col(f"stats.{n}")).alias(n) for n in names))
    return sums.unpivot([by], names, "rule", "n")
