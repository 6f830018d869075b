"""Votes counted in the row of their token, against rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import spans as S
from spanweave.plans.all_queries import QUERIES


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("how", ["max", "central", "avg"])
def test_votes_in_the_row(spark, sf_dir, how, capsys):
    rng = random.Random(4)
    votes = [(d, i, w, w * 10, w * 10 + 19, rng.choice(["A", "B", "C"]), rng.randint(0, 7) / 8) for d in range(9) for i in range(10, 19) for w in (0, 1)]
    df = spark.createDataFrame(votes, "doc_id int, i int, win int, lo int, hi int, tag string, p double")
    held = df.groupBy("doc_id", "i").agg(F.collect_list(F.struct("i", "win", "lo", "hi", "tag", "p")).alias("v"))
    mine = held.select("doc_id", "i", S.voted_in_row(F.col("v"), how).alias("b")).select("doc_id", "i", "b.tag", "b.p")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, S.voted(df, ["doc_id", "i"], how).collect()))
    said = plan(QUERIES[f"window_vote_{how}"](spark, sf_dir), capsys)
    assert "SortAggregate" not in said and said.count("Exchange") == 1
