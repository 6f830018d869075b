"""The pipeline's stages: columns, decisions that take effect, odd rows, and the queries' SQL."""

import duckdb
import pytest

import corpus_pipeline
from spanweave.llm import queries, secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs.columns
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "x y", None, None, 3)], docs.schema)
    leak = spark.createDataFrame([(10**6 + 2, "morning light token = '0123456789abcdef' ends here", "en", "src1", 50)], docs.schema)
    rows = docs.unionByName(odd).unionByName(leak)
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.stored(stage(spark, rows, sf_dir), f"test-{name}")
        counts.append(rows.count())
        if name != "encoding":
            assert rows.columns == start
        if name == "secrets":
            assert all(not secrets.base_spans(r.text or "") for r in rows.collect())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] >= counts[3] == counts[5]


def test_empty(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
        assert rows.collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    mine = queries.QUERIES[name](spark, sf_dir)
    got = con.sql(queries.ORACLE_SQL[name])
    order = sorted(mine.columns)
    assert sorted(got.columns) == order
    theirs = sorted((tuple(r) for r in got.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in mine.collect()), key=repr) == theirs
