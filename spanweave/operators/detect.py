"""Rule scorer: labelled patterns over documents, and the scorer interface that everything downstream uses.

A scorer maps ``doc_id, text`` to ``doc_id, start, end, label, score``. Besides the rules, saved predictions and
user-supplied functions fit the same interface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.offsets import find

#: Patterns without lookaround or Unicode classes, so that every engine reads them alike.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ACCOUNT": r"[0-9]{13,16}",
    "PHONE": r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "IP": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "SECRET": 'token = "[0-9a-f]+"',
}
#: A looser rule set, whose spans disagree with the first in bounds and labels; the queries score it.
LOOSE = {
    "EMAIL": r"[A-Za-z0-9.]+@[A-Za-z0-9.-]+",
    "ACCOUNT": r"[0-9]{7,16}",
    "PHONE": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}


def stable_score(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the md5 of some columns, alike in every engine."""
    return F.round(F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 4), 16, 10).cast("double") / 65536, 4)


def rules(docs: DataFrame, patterns: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans that the patterns find, with their values; keeps the named columns."""
    return find(docs, patterns or PATTERNS, keep=keep)


def scored(docs: DataFrame, patterns: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`rules` with a score derived from the span."""
    return rules(docs, patterns, keep).withColumn("score", stable_score(F.col("doc_id"), F.col("start"), F.col("label")))


def saved(predictions: DataFrame) -> DataFrame:
    """Saved predictions as a scorer's output; a missing score counts as 1."""
    return predictions.select("doc_id", "start", "end", "label", F.coalesce("score", F.lit(1.0)).alias("score"))


def plugged(docs: DataFrame, score: Callable[[str], list[tuple[int, int, str, float]]]) -> DataFrame:
    """A Python function from text to spans as a scorer, in Arrow batches."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *span) for key, text in zip(batch.doc_id, batch.text) for span in score(text or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "label", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, label string, score double")
