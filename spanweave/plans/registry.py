"""Queries by name, each with the SQL that another engine must answer alike, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def values(rows: list[tuple], columns: str) -> str:
    """A fixture as an inline table that Spark and the other engine both read: ``(VALUES ...) AS t(columns)``."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


def fixture(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """The same fixture as a DataFrame."""
    return spark.createDataFrame(rows, ddl)
