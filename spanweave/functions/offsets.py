"""Regular-expression matches with code-point offsets, as columns.

Spark has no such function (``regexp_instr`` counts UTF-16 units). The text between matches and the matches
themselves alternate, so a match starts after all earlier pieces and matches: one running sum over their lengths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that one inner fold of :func:`scanned` appends to.
BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once in a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state before, item)`` of every item, while ``step(state, item)`` carries the state on; ``kind`` is the type of an output.

    Appending copies an array, so items are folded in blocks and only the blocks' outputs are joined.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x).cast(kind))).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        part = F.slice(items, k * BLOCK + 1, F.lit(BLOCK))
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / F.lit(BLOCK)).cast("int"))
    begun = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, begun, block, lambda acc: acc["out"]))).otherwise(none)


def upto(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` (associative) over an array up to every element, that element included: each round spans twice as many elements."""

    def round_(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= k, step(F.get(acc, i - k), x)).otherwise(x))

    reach = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda k: k < F.size(values))
    return F.aggregate(reach, values, round_)


_SPAN = "struct<start:int,end:int,label:string,value:string>"


_FOUND = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType()).add("value", T.StringType()))


@F.arrow_udf(_FOUND)
def _placed(found: pa.Array, label: pa.Array) -> pa.Array:
    hits, gaps = found.field("hits"), found.field("gaps")
    n = pc.list_value_length(hits).to_numpy(zero_copy_only=False)
    value = hits.flatten()
    size = pc.utf8_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size + gaps.flatten().to_numpy(zero_copy_only=False))])
    rows = np.concatenate([[0], np.cumsum(n)])
    end = upto[1:] - np.repeat(upto[rows[:-1]], n)
    named = label.take(pa.array(np.repeat(np.arange(len(n)), n)))
    spans = pa.StructArray.from_arrays([pa.array(end - size, pa.int32()), pa.array(end, pa.int32()), named, value], ["start", "end", "label", "value"])
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), spans)


def _gaps(text: Column, pattern: str, hits: Column) -> Column:
    """The text before each match, from the match before it."""
    return F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))


def matches(text: Column, pattern: str, label: str | None = None) -> Column:
    """Array of ``start, end, label, value`` of every match. The pattern has no capturing group and no empty match.

    Time grows with the text and its matches (times the logarithm of their number), not with their square; a text
    without a match is read once.
    """

    def located(hits: Column) -> Column:
        sizes = F.zip_with(_gaps(text, pattern, hits), hits, lambda gap, hit: F.length(gap) + F.length(hit))

        def spans(ends: Column) -> Column:
            return F.zip_with(hits, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), F.lit(label).cast("string").alias("label"), hit.alias("value")))

        found = bound(bound(sizes, lambda n: upto(n, lambda a, b: a + b)), spans).cast(f"array<{_SPAN}>")
        return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def batch_matches(text: Column, pattern: str, label: str | None = None) -> Column:
    """:func:`matches` with the running sum taken over a whole Arrow batch, in a third of the time.

    Spark still finds the matches and the lengths of the gaps. It is no expression for a lambda, nor for a column that
    one captures: Spark would put the function into it.
    """

    def located(hits: Column) -> Column:
        gaps = F.when(F.size(hits) > 0, F.transform(_gaps(text, pattern, hits), F.length))
        return F.struct(hits.alias("hits"), F.coalesce(gaps, F.array().cast("array<int>")).alias("gaps"))

    hits = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    return _placed(bound(hits, located), F.lit(label).cast("string"))


def find(docs: DataFrame, patterns: dict[str, str], text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each match of each labelled pattern: the kept columns, ``label, start, end, value``.

    Null and empty texts have no matches.
    """
    spans = F.flatten(F.array(*(batch_matches(F.col(text_col), p, label) for label, p in patterns.items())))
    rows = docs.select(*keep, F.explode(spans).alias("s"))
    return rows.select(*keep, F.col("s.label").alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))


def part(text: Column, start: Column, end: Column) -> Column:
    """``text`` from ``start`` up to ``end``, in code points."""
    return F.substring(text, start.cast("int") + 1, F.greatest((end - start).cast("int"), F.lit(0)))
