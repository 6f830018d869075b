"""The one-pass predictor against the separate steps, on short, long, null and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import spans as S
from spanweave.operators.predictor import Predictor, Window, predicted
from spanweave.plans.predict_queries import stable


def texts():
    rng = random.Random(4)
    said = [" ".join(rng.choices(["(Ana)", "Ruiz,", "12.", "é", "a", "of", "4471)", "、x"], k=n)) for n in (0, 1, 5, 11, 12, 13, 40, 200)]
    return [*said, None, "", " \n ", "one"]


@pytest.mark.parametrize("vote", ["max", "central", "avg"])
@pytest.mark.parametrize("batch", [1, 7, 64])
def test_equals_the_separate_steps(spark, vote, batch):
    rows = [*enumerate(texts()), (3, texts()[3] + " again"), (None, "12. Ruiz")]
    df = spark.createDataFrame([(100 + k if i == 3 and k > 3 else i, t, 1, "x") for k, (i, t) in enumerate(rows)], "doc_id int, text string, label int, tag string").repartition(2)
    got = predicted(df, Predictor(stable, 12, 4, vote, batch=batch)).collect()
    toks = S.tokens(df)
    counts = toks.groupBy("doc_id").agg(F.count("*").alias("n"))
    wide = S.windows(counts, body=12, stride=4)
    both = toks.join(wide, toks.doc_id.eqNullSafe(wide.doc_id) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).drop(wide.doc_id)
    scored = []
    for r in both.collect():
        tags, sure = stable([Window([r.tok], r.win, 0)])[0]
        scored.append((r.doc_id, r.i, r.s, r.e, r.win, r.lo, r.hi, tags[0], sure[0]))
    votes = spark.createDataFrame(scored, "doc_id int, i int, s int, e int, win int, lo int, hi int, tag string, p double")
    best = S.voted(votes, ["doc_id", "i", "s", "e"], vote)
    spans = S.bio_decoded(best)
    held = {r.doc_id: r.text for r in df.collect()}
    cut = spark.createDataFrame([(r.doc_id, held[r.doc_id], r.start, r.end, r.label) for r in spans.collect()], "doc_id int, text string, start int, end int, label string")
    want = cut.select("doc_id", S.trimmed(F.col("text"), F.col("start"), F.col("end"), F.col("label")).alias("c"), "label").where("c IS NOT NULL").select("doc_id", "c.start", "c.end", "label")
    assert sorted(((r.doc_id, r.start, r.end, r.label) for r in got), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)
    assert len(got) > 20


def test_long_document():
    """One document of many calls: no call gets more windows than the batch, every token is scored once or twice."""
    calls = []

    def score(windows):
        calls.append(len(windows))
        return [(["B-X"] * len(w.tokens), [1.0] * len(w.tokens)) for w in windows]

    found = Predictor(score, 382, 96).spans(["ab " * 200_000, "one"])
    assert [len(x) for x in found] == [200_000, 1] and max(calls) == 32
    assert sum(calls) == 1 + 1 + -(-(200_000 - 382) // 286)


def test_scorers_that_err(spark):
    with pytest.raises(ValueError, match="no vote"):
        Predictor(stable, vote="most")
    for bad in (lambda w: [], lambda w: [([], []) for _ in w]):
        with pytest.raises(ValueError, match="answered"):
            Predictor(bad).spans(["a b"])
    assert predicted(spark.createDataFrame([], "doc_id int, text string"), Predictor(stable)).collect() == []


def test_one_row_group_is_scored_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, "(Ana) Ruiz, 12. é a of " * 5) for i in range(40)], "doc_id int, text string").coalesce(1)
        found = predicted(df, Predictor(stable, 12, 4), trim=False).select("doc_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id for r in found} == set(range(40)) and len({r.task for r in found}) > 1
