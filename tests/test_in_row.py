"""Queries over the tokens and spans of a text's own row: nothing of it moves."""

import pytest
from pyspark.sql import functions as F

from spanweave.operators import spans as S
from spanweave.operators import transliterate as T
from spanweave.plans.all_queries import QUERIES
from spanweave.sources import numbering as N


@pytest.mark.parametrize("name", ["merge_adjacent", "cut_words", "token_offsets"])
def test_no_shuffle(spark, sf_dir, capsys, name):
    QUERIES[name](spark, sf_dir).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_merged_spans_equal_rows(spark):
    text = "Ab, Cd  Ef; Gh IJ x 12"
    spans = [(0, 2, "ADDRESS"), (4, 6, "ADDRESS"), (8, 10, "ADDRESS"), (12, 14, "ADDRESS"), (15, 17, "PERSON"), (18, 19, "PERSON"), (20, 22, "IGNORE")]
    rows = spark.createDataFrame([(1, text, *s) for s in spans], "doc_id int, text string, start int, end int, label string")
    want = sorted((r.start, r.end, r.label, r.parts) for r in S.merged_adjacent(rows).collect())
    one = spark.createDataFrame([(1, text, spans), (2, text, [])], "doc_id int, text string, s array<struct<start:int,end:int,label:string>>")
    got = {r.doc_id: r.m for r in one.select("doc_id", S.merged_spans(F.col("text"), F.col("s")).alias("m")).collect()}
    assert sorted(map(tuple, got[1])) == want and got[2] == []


def test_cut_arrays_equal_rows(spark):
    words = "a . b c . . d e f ! g h . i".split() * 20
    rows = spark.createDataFrame([("x", i, w) for i, w in enumerate(words)], "by string, no long, tok string")
    numbered = N.cut_after(rows, "by", F.col("tok") .isin(".", "!"), 3, "sentence", size=7)
    want = [r.n for r in numbered.groupBy("sentence").agg(F.count("*").alias("n")).orderBy("sentence").collect()]
    one = spark.createDataFrame([(words,)], "w array<string>")
    cut = one.select(N.cut_arrays(F.col("w"), lambda w: w.isin(".", "!"), 3).alias("c")).first().c
    assert [len(c) for c in cut] == want and [w for c in cut for w in c] == words


def test_restored_in_slices(spark, monkeypatch):
    """No more than ``ROWS`` texts are Python objects at a time."""
    monkeypatch.setattr(T, "ROWS", 3)
    df = spark.createDataFrame([(i, "éa" * i, [(0, 1, "X")] * (i > 0)) for i in range(10)], "doc_id int, text string, spans array<struct<start:int,end:int,label:string>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    back = {r.doc_id: [tuple(s) for s in r.spans] for r in T.restored(T.transliterated(df, T.Transducer({"é": "ee"}))).collect()}
    assert back == {i: [(0, 1, "X")] * (i > 0) for i in range(10)}
