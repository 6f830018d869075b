"""Extension: the stateless operators over a stream of documents, and windowed counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.operators.detect import scored


def documents(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 16) -> DataFrame:
    """New JSON-lines files of a folder, a bounded number for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def detect(docs: DataFrame) -> DataFrame:
    """The rule scorer over a stream; no state."""
    return scored(docs)


def deduplicated(docs: DataFrame, at: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """First document of each text (case ignored) within the watermark."""
    keyed = docs.withColumn("__key__", F.md5(F.lower(F.col(text)).cast("binary")))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["__key__"]).drop("__key__")


def counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums with a watermark; the same expression serves a batch."""
    grouped = events.withWatermark(at, delay).groupBy(F.window(at, width), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
