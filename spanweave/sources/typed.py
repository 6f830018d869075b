"""Typed rows from JSON lines: good rows by a schema, and beside them every rejected line with its file and the reason."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.text import SPACE
from spanweave.sources.numbering import file_lines
from spanweave.sources.staged import xz_lines

_BAD = "__bad__"


@dataclass
class Loaded:
    """``good``: rows of the schema, with ``path, no``; ``rejected``: ``path, no, line, reason``."""

    good: DataFrame
    rejected: DataFrame


def checked(lines: DataFrame, schema: str | T.StructType, required: tuple[str, ...] = ()) -> Loaded:
    """Rows of ``path, no, line`` read by a schema. A line is rejected, with the first reason that holds, if it is no
    JSON object, if a field that is there has another type, or if a required field is missing or null. Blank lines are
    neither. Both sides are the same expressions over the same lines; nothing is collected.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField(_BAD, T.StringType())])
    rows = lines.where(F.col("line").rlike(rf"[^{SPACE}]")).withColumn("row", F.from_json("line", wide, {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"}))
    rows = rows.withColumn("fields", F.from_json("line", "map<string,string>"))

    def wrong(f: T.StructField) -> Column:
        there = F.get(F.array(F.try_element_at(F.col("fields"), F.lit(f.name))), F.lit(0)).isNotNull()
        return F.when(there & F.col(f"row.`{f.name}`").isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))

    shape = F.when(F.col("fields").isNull() | ~F.col("line").rlike(rf"^[{SPACE}]*\{{"), F.lit("no JSON object"))
    types = [wrong(f) for f in kind.fields]
    other = F.when(F.col(f"row.{_BAD}").isNotNull(), F.lit("no row of the schema"))
    missing = [F.when(F.col(f"row.`{name}`").isNull(), F.lit(f"{name} is missing")) for name in required]
    rows = rows.withColumn("reason", F.coalesce(shape, *types, other, *missing))
    good = rows.where("reason IS NULL").select("path", "no", *(F.col(f"row.`{f.name}`").alias(f.name) for f in kind.fields))
    return Loaded(good, rows.where("reason IS NOT NULL").select("path", "no", "line", "reason"))


def loaded(spark: SparkSession, root: str, split: str, schema: str | T.StructType, required: tuple[str, ...] = (), packed: bool = False) -> Loaded:
    """One split of a corpus: the JSON lines of ``root/split``, plain or (``packed``) by xz, typed and checked."""
    path = f"{root.rstrip('/')}/{split}"
    return checked(xz_lines(spark, path) if packed else file_lines(spark, path), schema, required)


def merged_configuration(node):
    """A configuration with its defaults filled in: what a mapping has under ``<<`` (a mapping or several, earlier first)
    counts where it has no entry of its own, at every depth and through defaults of defaults."""
    if isinstance(node, list):
        return [merged_configuration(x) for x in node]
    if not isinstance(node, dict):
        return node
    base = node.get("<<", [])
    filled: dict = {}
    for part in reversed(base if isinstance(base, list) else [base]):
        filled |= merged_configuration(part)
    return filled | {k: merged_configuration(v) for k, v in node.items() if k != "<<"}


def read_configuration(spark: SparkSession, path: str) -> dict:
    """A configuration from a JSON file, read by Spark, so from any store, with its defaults filled in."""
    said = spark.read.text(path, wholetext=True).first()
    if said is None:
        raise ValueError(f"{path} is empty")
    return merged_configuration(json.loads(said[0]))


def leaves(spark: SparkSession, entries: dict) -> DataFrame:
    """``path, value``: the leaves of a nested configuration, values as JSON."""

    def under(node, path: str):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from under(v, f"{path}.{k}" if path else str(k))
        else:
            yield path, json.dumps(node, ensure_ascii=False)

    return spark.createDataFrame(list(under(merged_configuration(entries), "")), "path string, value string")
