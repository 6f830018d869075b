"""Offsets summed over a batch, and sums up to every element, against plain loops."""

import random

from pyspark.sql import functions as F

from spanweave.functions.offsets import batch_matches, find, matches, upto
from spanweave.operators import spans as S


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_matches_place_all_in_a_batch(spark, capsys):
    texts = [None, "", "  ", "a 😀b  c", "é " * 300 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    made = df.select("i", batch_matches(F.col("text"), S.TOKEN, "T").alias("m"))
    assert "ArrowEvalPython" in plan(made, capsys) and "ArrowEvalPython" in plan(find(df, {"A": "a"}), capsys)
    assert made.collect() == df.select("i", matches(F.col("text"), S.TOKEN, "T").alias("m")).collect()
    for r in made.collect():
        said = texts[r.i] or ""
        assert [s.value for s in r.m] == said.split()
        assert all(said[s.start : s.end] == s.value and s.label == "T" for s in r.m)
    assert find(df, {"A": "a", "B": "zz"}, keep=("i",)).count() == 1


def test_upto(spark):
    rng = random.Random(1)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 64, 65, 200)]
    df = spark.createDataFrame([(v,) for v in lists], "v array<int>")
    for r in df.select("v", upto(F.col("v"), lambda a, b: a + b).alias("s"), upto(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect():
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))] and r.m == [max(r.v[: k + 1]) for k in range(len(r.v))]
