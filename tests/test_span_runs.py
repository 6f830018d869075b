"""Overlaps and neighbours resolved by runs, against plain loops."""

import random

from pyspark.sql import functions as F

from spanweave.operators import cleaning as N
from spanweave.operators import spans as S


def test_runs_keep_the_longer(spark):
    rng = random.Random(2)
    lists = [sorted([(a := rng.randint(0, 60 * n), a + rng.randint(1, 40), "X") for _ in range(n)], key=lambda s: (s[0], -s[1])) for n in (0, 1, 2, 5, 30, 150)]
    lists.append([(0, 1000, "X")] + [(k, k + 2, "X") for k in range(1, 200, 3)])
    df = spark.createDataFrame([(v,) for v in lists], "v array<struct<start:int,end:int,label:string>>")
    for r in df.select("v", S.kept_longer(F.col("v"), S._SPAN).alias("k")).collect():
        want = []
        for s in r.v:
            if not want or s.start >= want[-1].end:
                want.append(s)
            elif s.end - s.start > want[-1].end - want[-1].start:
                want[-1] = s
        assert r.k == want


def test_merged_neighbours(spark):
    text = "Rome, Paris  x Oslo\tBonn, 5"
    spans = [(0, 4, "ADDRESS", ["a"]), (6, 11, "ADDRESS", ["b"]), (15, 19, "ADDRESS", ["a"]), (20, 24, "ADDRESS", ["a"]), (26, 27, "PHONE", ["c"])]
    df = spark.createDataFrame([(text, spans), (text, [])], f"text string, v array<{N._RAW}>")
    got = [[tuple(s) for s in r.m] for r in df.select(N.merged(F.col("text"), F.col("v")).alias("m")).collect()]
    assert got == [[(0, 11, "ADDRESS", ["a", "b"]), (15, 24, "ADDRESS", ["a"]), (26, 27, "PHONE", ["c"])], []]
