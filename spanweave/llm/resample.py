"""Importance resampling toward a target: hashed n-gram features of the corpus and of the target, and a seeded draw.

A document's words are runs of ASCII letters and digits and of all other characters beyond ASCII, in small letters
(A-Z only). Its features are all runs of one to ``longest`` consecutive words, repeats counted; a feature's bucket is
the CRC-32 of its bytes modulo the number of buckets. One scan finds all buckets: a ring holds the CRC state of the
runs that began at each of the last ``longest`` words, and a word extends each of them by a space and itself, so no
run is ever put together and no byte is read more than ``longest`` times.

A bucket's gain is the logarithm of its (smoothed) share in the target over its share in the corpus; a document weighs
the sum of its features' gains, and Gumbel noise of its id makes the highest scores a draw without replacement.

Scale: both counts are summed in the task and then by bucket, so a task sends one row for each bucket at most; the
gains, one integer a bucket, are all that is broadcast. Buckets of a document would take more room than its compressed
text, so a second scan makes them again. Ranks come from a range partitioning of narrow rows and the counts of its
parts: no task gets all scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanweave.llm.common import SLICE_ROWS, map_slices, picked, release, stored

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of a text that are split into words at a time; rows of one part of the ranking.
BLOCK, PART_ROWS = 1 << 20, 1_000_000
#: Capital letters to small ones, and every ASCII character that is neither letter nor digit to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            tail = text[end : end + BLOCK].translate(_PLAIN).find(b" ")
            while tail < 0 and end < len(text):
                end += BLOCK
                tail = text[end : end + BLOCK].translate(_PLAIN).find(b" ")
            end += max(tail, 0)
        yield text[at:end].translate(_PLAIN).split()
        at = end


def scanned(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs that end in them) of a UTF-8 text, some words at a time."""
    ring: list[int] = []
    for words in _words(text):
        found: list[int] = []
        for word in words:
            spaced = b" " + word
            ring = [crc32(word), *[crc32(spaced, state) for state in ring[: longest - 1]]]
            found += ring
        yield len(words), np.array(found, np.uint32) % np.uint32(buckets)


def feature_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket that has any."""
    schema = T._parse_datatype_string("bucket int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for _, found in scanned(text.as_py() or b"", longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=arrow)
        release()

    return picked(docs, text=text_col).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""

    def collected(df: DataFrame, column: str) -> list[float]:
        held = [0.0] * buckets
        for bucket, n in feature_counts(df, column, longest, buckets).collect():  # a row a bucket at most
            held[bucket] = float(n)
        return held

    source, wanted = collected(docs, text_col), collected(target, target_col)
    all_source, all_wanted = sum(source) + buckets, sum(wanted) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_wanted))) for s, t in zip(source, wanted)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def make() -> Callable[[pa.RecordBatch], list]:
        gain = given.value

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                words = features = weight = 0
                for n, found in scanned(text.as_py() or b"", longest, len(gain)):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                out.append((words, features, weight))
            return [batch.column(0), *zip(*out)]

        return work

    return map_slices(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long", make, SLICE_ROWS)


def importance(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` (and ``copy``, a row number) of every row of ``docs``.

    ``rank`` counts from 1 over the ``percent`` of the documents with at least ``least_words`` words that have the
    highest scores, ties to smaller ids, and is null for all others. Null texts count as empty: no features, weight 0.
    A null id draws as an empty one and comes last among ties; rows of one id are drawn each by itself. Without any
    target text all gains follow the corpus alone. An empty table gives no rows; extra columns are not read.
    """
    gain = gains(docs, target, text_col, target_col, longest, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000) * F.ln(-F.ln(uniform)))
    rows = weighed(docs, gain, id_col, text_col, longest)
    rows = stored(rows.select("*", score.alias("score"), F.monotonically_increasing_id().alias("copy")), "weights")
    fit = F.col("n_words") >= least_words
    total, eligible = rows.agg(F.count("*"), F.count_if(fit)).first()
    order = [F.col("out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("copy")]
    parts = rows.withColumn("out", ~fit).repartitionByRange(max(1, -(-total // PART_ROWS)), *order)
    parts = stored(parts.withColumn("part", F.spark_partition_id()), "scores")
    sizes = sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect())  # a row for each part
    before, upto = {}, 0
    for part, size in sizes:
        before[part], upto = upto, upto + size
    offsets = docs.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = parts.join(F.broadcast(offsets), "part").withColumn("place", place.cast("long"))
    rank = F.when(F.col("place") <= percent * eligible // 100, F.col("place"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"), "copy")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns: those whose id was drawn (ids that repeat are drawn together)."""
    drawn = importance(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn__")).distinct()
    return docs.join(drawn, F.col(f"`{id_col}`").eqNullSafe(F.col("__drawn__")), "left_semi")
