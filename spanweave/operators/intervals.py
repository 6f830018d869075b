"""Joins of intervals by bins: only intervals that share a bin of positions are compared, and each pair comes once.

An interval (half-open, of one key such as a document) stands in every bin of ``width`` positions that it touches. Two
that overlap meet in the bin of the later start, the first one they share, and only there does the pair count. Rows
are hashed by key and bin, so a document with very many intervals is spread over tasks; an interval is repeated once
for each ``width`` of its length. An empty interval stands in the bin of its position and overlaps what goes over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1024
BIN = "__bin__"


def binned(rows: DataFrame, start: str = "start", end: str = "end", width: int = WIDTH, outer: bool = False) -> DataFrame:
    """``rows`` once for each bin, with its number; rows with null bounds go, or with ``outer`` stay with a null bin."""
    at = lambda c: F.floor(c / F.lit(width)).cast("long")
    last = F.greatest(F.col(end), F.col(start) + 1) - 1
    bins = F.sequence(at(F.col(start)), at(last))
    return rows.withColumn(BIN, F.explode_outer(bins) if outer else F.explode(bins))


def meets(a: str, b: str, key: str, width: int = WIDTH, bounds: tuple[str, str] = ("start", "end"), others: tuple[str, str] = ("start", "end")) -> Column:
    """The condition that binned rows under aliases ``a`` and ``b`` overlap, in the first bin that both stand in."""
    s, e, t, f = F.col(f"{a}.{bounds[0]}"), F.col(f"{a}.{bounds[1]}"), F.col(f"{b}.{others[0]}"), F.col(f"{b}.{others[1]}")
    same = (F.col(f"{a}.{key}") == F.col(f"{b}.{key}")) & (F.col(f"{a}.{BIN}") == F.col(f"{b}.{BIN}"))
    return same & (s < f) & (t < e) & (F.col(f"{a}.{BIN}") == F.floor(F.greatest(s, t) / F.lit(width)))


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """All overlapping pairs of ``key, start, end, ...`` rows, once each: ``key``, and each side's other columns in the
    structs ``left`` and ``right``. Repeated rows pair as often as they are there; null keys and bounds pair with none."""
    a, b = binned(left, width=width).alias("a"), binned(right, width=width).alias("b")

    def side(name: str, rows: DataFrame) -> Column:
        return F.struct(*(F.col(f"{name}.{c}") for c in rows.columns if c != key))

    return a.join(b, meets("a", "b", key, width)).select(F.col(f"a.{key}").alias(key), side("a", left).alias("left"), side("b", right).alias("right"))


def touched(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The different ``key, start, end`` of ``left`` that any interval of ``right`` overlaps."""
    mine, theirs = (rows.select(key, "start", "end").distinct() for rows in (left, right))
    a, b = binned(mine, width=width).alias("a"), binned(theirs, width=width).alias("b")
    return a.join(b, meets("a", "b", key, width), "left_semi").select(key, "start", "end").distinct()


def with_overlap(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Rows of ``left`` that any interval of ``right`` overlaps."""
    return left.join(touched(left, right, key, width), [key, "start", "end"], "left_semi")


def without_overlap(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Rows of ``left`` that no interval of ``right`` overlaps."""
    return left.join(touched(left, right, key, width), [key, "start", "end"], "left_anti")


def beside(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """A left join for aggregation by ``left``'s columns: binned rows under aliases ``g`` and ``p``; a row of ``left``
    that stands in several bins comes once in each, with nulls where nothing overlaps."""
    return binned(left, width=width, outer=True).alias("g").join(binned(right, width=width).alias("p"), meets("g", "p", key, width), "left")
