"""Numbers and carried values over ordered lines, without putting a file or document into one task.

Lines of a file get numbers from the counts of its splits. Running sums, values that hold until the next one, and
sentence cuts that depend on the cut before are each found in three steps: within buckets of consecutive lines, over
the (few) buckets of a file, and within buckets again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.offsets import bound, scanned

#: Lines of a bucket.
BUCKET = 1 << 14
_B, _PAST = "__bucket__", "__past__"


def _split_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``path, split, at, line`` of text files, and ``path, split, shift``: what makes ``at`` the number in the file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("line"))
    sizes = rows.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sizes.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, no, line``: text lines with their number in their file, from 0; a carriage return before a break goes.

    A file is read by splits. Rows keep their order within a split, so a line's number is its place in the split plus
    the lines of the splits before it; how a file is split is Spark's own choice and the same in both reads of a query.
    What is known of the splits, a row each, is broadcast; the lines are not shuffled.
    """
    rows, starts = _split_lines(spark, path)
    return rows.join(F.broadcast(starts), ["path", "split"]).select("path", (F.col("at") + F.col("shift")).alias("no"), "line")


def headed_lines(spark: SparkSession, path: str, head: Column) -> DataFrame:
    """``path, head_no, head, no, lines``: the lines below each ``line`` that is a head, numbered as in :func:`file_lines`.

    They come in pieces, arrays of consecutive lines of which the first has number ``no``; a head may have several, also
    empty ones, and lines above a file's first head have a null head. Lines are in order within a split, so they are cut
    where they are read, and only the last head of each split goes to those after it: the lines are not shuffled.
    """
    rows, starts = _split_lines(spark, path)
    numbered = rows.join(F.broadcast(starts), ["path", "split"]).select("path", "split", (F.col("at") + F.col("shift")).alias("no"), "line")
    numbered = numbered.withColumn("is_head", F.coalesce(head, F.lit(False)))
    last = numbered.where("is_head").groupBy("path", "split").agg(F.max(F.struct("no", "line")).alias("last"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    told = starts.select("path", "split").join(last, ["path", "split"], "left")
    told = told.select("path", "split", F.row_number().over(Window.orderBy("path", "split")).alias("part"), F.last("last", ignorenulls=True).over(before).alias("past"))
    # The paths, far longer than most lines, stay behind: a line takes along the number of its split.
    short = numbered.join(F.broadcast(told.select("path", "split", "part")), ["path", "split"]).select("part", "no", "line", "is_head")
    kind = pa.schema([("part", pa.int32()), ("head_no", pa.int64()), ("head", pa.string()), ("no", pa.int64()), ("lines", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held_no, held = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, no, line = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.string())
            flag = batch.column(3).to_numpy(zero_copy_only=False)
            if split != part[0]:
                held_no, held = None, None
            begins = np.flatnonzero(flag | (np.diff(part, prepend=part[0] - 1) != 0))
            own = flag[begins]
            kept = np.concatenate([[0], np.cumsum(~flag)])[np.append(begins, len(flag))]
            lines = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), line.filter(pa.array(~flag)))
            heads, numbers = line.take(pa.array(begins, mask=~own)), pa.array(no[begins], mask=~own)
            if not own[0]:
                heads, numbers = pa.concat_arrays([pa.array([held], pa.string()), heads.slice(1)]), pa.concat_arrays([pa.array([held_no], pa.int64()), numbers.slice(1)])
            split, held_no, held = part[-1], numbers[-1].as_py(), heads[-1].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(part[begins]), numbers, heads, pa.array(no[begins] + own), lines], schema=kind)

    found = short.mapInArrow(cut, "part int, head_no long, head string, no long, lines array<string>").join(F.broadcast(told), "part")
    return found.select("path", F.coalesce("head_no", "past.no").alias("head_no"), F.coalesce("head", "past.line").alias("head"), "no", "lines")


def _bucketed(rows: DataFrame, no: str, size: int) -> DataFrame:
    return rows.withColumn(_B, F.floor(F.col(no) / size))


def running_total(rows: DataFrame, by: str, value: Column, name: str, no: str = "no", size: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, that row included, in the order of ``no`` within ``by``."""
    cut = _bucketed(rows.withColumn(name, value), no, size or BUCKET)
    sums = cut.groupBy(by, _B).agg(F.sum(name).alias(_PAST))
    before = Window.partitionBy(by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select(F.col(by).alias("__by__"), F.col(_B).alias("__at__"), F.coalesce(F.sum(_PAST).over(before), F.lit(0)).alias(_PAST))
    within = Window.partitionBy(by, _B).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(past, F.col(by).eqNullSafe(F.col("__by__")) & (F.col(_B) == F.col("__at__")))
    return joined.withColumn(name, F.coalesce(F.sum(name).over(within), F.lit(0)) + F.col(_PAST)).select(*rows.columns, name)


def held(rows: DataFrame, by: str, values: dict[str, Column], no: str = "no", size: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values``: its last value that was not null, up to each row."""
    cut = _bucketed(rows.withColumns(values), no, size or BUCKET)
    last = cut.groupBy(by, _B).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col(no))).alias(n) for n in values))
    before = Window.partitionBy(by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    past = last.select(F.col(by).alias("__by__"), F.col(_B).alias("__at__"), *(F.last(n, ignorenulls=True).over(before).alias(f"__{n}__") for n in values))
    within = Window.partitionBy(by, _B).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(past, F.col(by).eqNullSafe(F.col("__by__")) & (F.col(_B) == F.col("__at__")))
    return joined.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(within), F.col(f"__{n}__")) for n in values}).select(*rows.columns, *values)


def cut_arrays(items: Column, final: Callable[[Column], Column], least: int) -> Column:
    """:func:`cut_after` within an array: its items as one array for each sentence. The items of a text in one row need no shuffle."""

    def after(count: Column, item: Column) -> Column:
        now = F.least(count + 1, F.lit(least))
        return F.when(F.coalesce(final(item), F.lit(False)) & (now >= least), F.lit(0)).otherwise(now)

    def cut(held: Column) -> Column:
        begins = scanned(held, F.lit(0), after, lambda s, _: s == 0, "boolean")
        starts = F.filter(F.transform(begins, lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
        return bound(starts, lambda found: F.transform(found, lambda a, k: F.slice(held, a + 1, F.coalesce(F.get(found, k + 1), F.size(held)) - a)))

    return bound(items, cut)


def cut_after(rows: DataFrame, by: str, final: Column, least: int, name: str, no: str = "no", size: int | None = None) -> DataFrame:
    """``rows`` with the number of their sentence, from 0: a row that may be ``final`` ends one that has ``least`` rows.

    Whether a row ends a sentence depends on where it began; all that matters is how many rows it has so far, up to
    ``least``. So a bucket is a map from that count at its begin to the count at its end; the maps of a file are
    followed one after the other, and each bucket is cut from the count it begins with.
    """
    cut = _bucketed(rows.withColumn("__final__", F.coalesce(final, F.lit(False))), no, size or BUCKET)
    flags = cut.groupBy(by, _B).agg(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), F.col("__final__").alias("f")))).alias("flags"))

    def after(count: Column, item: Column) -> Column:
        now = F.least(count + 1, F.lit(least))
        return F.when(item["f"] & (now >= least), F.lit(0)).otherwise(now)

    ends = F.array(*(F.aggregate("flags", F.lit(k), after) for k in range(least + 1)))
    parts = flags.withColumn("ends", ends)
    files = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(_B).alias("b"), "ends"))).alias("parts"))
    begun = bound(F.col("parts"), lambda p: scanned(p, F.lit(0), lambda s, x: F.get(x["ends"], s), lambda s, x: F.struct(x["b"].alias("b"), s.alias("count")), "struct<b:bigint,count:int>"))
    starts = files.select(F.col(by).alias("__by__"), F.explode(begun).alias("s")).select("__by__", F.col("s.b").alias("__at__"), F.col("s.count").alias("count"))
    joined = parts.join(starts, F.col(by).eqNullSafe(F.col("__by__")) & (F.col(_B) == F.col("__at__")))
    # A row begins a sentence if none is open before it.
    marks = bound(F.col("flags"), lambda f: scanned(f, F.col("count"), after, lambda s, x: F.struct(x["no"].cast("long").alias("no"), (s == 0).cast("int").alias("new")), "struct<no:bigint,new:int>"))
    told = joined.select(F.col(by).alias("__by__"), F.explode(marks).alias("m")).select("__by__", F.col("m.no").alias("__no__"), F.col("m.new").alias("__new__"))
    news = rows.join(told, F.col(by).eqNullSafe(F.col("__by__")) & (F.col(no) == F.col("__no__"))).select(*rows.columns, "__new__")
    return running_total(news, by, F.col("__new__"), name, no, size).withColumn(name, F.col(name) - 1).drop("__new__")
