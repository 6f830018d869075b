"""Documents from nested templates: productions expanded level by level, text and exact spans composed in one fold.

A production is plain text with slots: ``{NAME}`` is another symbol, ``{@column}`` a value of the row, and ``=LABEL`` in
a slot makes what fills it a span. A row's document is an array of pieces; at each level every open symbol is replaced
by the pieces of a production that is drawn from the row's key and the symbol's place in the tree, so documents are
independent of each other and of how they are dealt. Spans may nest. Offsets count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.offsets import bound, scanned
from spanweave.operators.generate import draw

Grammar = dict[str, list[str]]
_SLOT = re.compile(r"\{(@?)(\w+)(?:=(\w+))?\}")
_PIECE = "struct<kind:string,value:string,place:string>"
_SPAN = "struct<start:int,end:int,label:string>"


def pieces(production: str) -> list[tuple[str, str]]:
    """(kind, value) of a production: ``text``, ``symbol``, ``column``, and ``open`` and ``close`` around labelled slots."""
    found, at = [], 0
    for m in _SLOT.finditer(production):
        if m.start() > at:
            found.append(("text", production[at : m.start()]))
        slot = ("column" if m[1] else "symbol", m[2])
        found += [("open", m[3]), slot, ("close", m[3])] if m[3] else [slot]
        at = m.end()
    return found + ([("text", production[at:])] if at < len(production) else [])


def depth(grammar: Grammar, start: str) -> int:
    """Levels of symbols below ``start``; a symbol without productions, or one that leads to itself, is an error."""

    def below(name: str, over: tuple[str, ...]) -> int:
        if name in over:
            raise ValueError(f"{name} leads to itself: {' > '.join((*over, name))}")
        if not grammar.get(name):
            raise ValueError(f"there is no production of {name}")
        return 1 + max((below(v, (*over, name)) for p in grammar[name] for k, v in pieces(p) if k == "symbol"), default=0)

    return below(start, ())


def _piece(kind: str, value: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit("").alias("place"))


def _expanded(found: Column, grammar: Grammar, seed: str, key: Column) -> Column:
    """The pieces with every open symbol replaced by those of a drawn production."""
    ways = {name: F.array(*(F.array(*(_piece(*p) for p in pieces(said) or [("text", "")])) for said in options)) for name, options in grammar.items()}

    def replaced(p: Column) -> Column:
        out = F.array(p)
        for name, options in ways.items():
            drawn = F.get(options, draw(seed, key, p["place"], len(grammar[name])))
            placed = F.transform(drawn, lambda x, i: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), F.concat(p["place"], F.lit("."), i.cast("string")).alias("place")))
            out = F.when((p["kind"] == "symbol") & (p["value"] == name), placed).otherwise(out)
        return out.cast(f"array<{_PIECE}>")

    return F.flatten(F.transform(found, replaced))


def _composed(found: Column, columns: dict[str, Column]) -> Column:
    """``text, spans`` of expanded pieces: one fold carries the offset and the open labels."""

    def said(p: Column) -> Column:
        out = F.lit("")
        for name, value in columns.items():
            out = F.when((p["kind"] == "column") & (p["value"] == name), F.coalesce(value.cast("string"), F.lit(""))).otherwise(out)
        return F.when(p["kind"] == "text", p["value"]).otherwise(out)

    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"))

    def step(s: Column, p: Column) -> Column:
        open_ = F.when(p["kind"] == "open", F.concat(s["open"], F.array(s["at"]))).when(p["kind"] == "close", F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        return F.struct((s["at"] + F.length(p["said"])).alias("at"), open_.alias("open"))

    def closed(s: Column, p: Column) -> Column:
        return F.when(p["kind"] == "close", F.struct(F.element_at(s["open"], -1).alias("start"), s["at"].alias("end"), p["value"].alias("label")))

    told = F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), said(p).alias("said")))

    def made(t: Column) -> Column:
        spans = F.filter(scanned(t, begun, step, closed, _SPAN), lambda x: x.isNotNull())
        return F.struct(F.array_join(F.transform(t, lambda p: p["said"]), "").alias("text"), F.array_sort(spans).alias("spans"))

    return bound(told, made)


def composed(rows: DataFrame, grammar: Grammar, start: str, seed: str = "0", key: str = "id") -> DataFrame:
    """``rows`` with ``text`` and ``spans`` of a document of ``start`` each; spans by start and end, empty ones too.

    Null column values fill a slot with nothing. Repeated keys give equal choices.
    """
    levels = depth(grammar, start)
    used = {v for options in grammar.values() for said in options for k, v in pieces(said) if k == "column"}
    if missing := used - set(rows.columns):
        raise ValueError(f"the grammar fills slots from columns that are not there: {sorted(missing)}")
    out = rows.withColumn("__found__", F.array(F.struct(F.lit("symbol").alias("kind"), F.lit(start).alias("value"), F.lit("0").alias("place"))).cast(f"array<{_PIECE}>"))
    for _ in range(levels):
        out = out.withColumn("__found__", _expanded(F.col("__found__"), grammar, seed, F.col(key)))
    out = out.withColumn("__made__", _composed(F.col("__found__"), {c: F.col(c) for c in sorted(used)}))
    return out.select(*rows.columns, "__made__.text", "__made__.spans")
