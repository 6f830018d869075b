"""Rules whose edges the tables do not reach: marks in texts, unknown contexts, range search, result files."""

import bisect

from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.operators import corpus as K
from spanweave.operators import evaluation as E
from spanweave.operators import leaderboard as B
from spanweave.operators import spans as S


def test_segments_are_the_text(spark):
    texts = ["a\0b", "a\n\nb", "\n\n", "a\n \n\n b\n\n", "", "x\0\n\ny\0", "one"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.segments(F.col("t")).alias("b")).collect()
    found = {r.i: r.b for r in got}
    assert all("".join(found[i]) == t for i, t in enumerate(texts))
    assert found[0] == ["a\0b"] and found[1] == ["a\n\n", "b"] and found[5] == ["x\0\n\n", "y\0"]


def test_address_cue_has_unicode_letters(spark):
    rows = [(1, "city名Rome", 5), (2, "city：Rome", 5), (3, "city é Rome", 7), (4, "residenéé: Rome", 11), (5, "CITY\n", 5)]
    df = spark.createDataFrame(rows, "id int, text string, start int")
    got = {r.id: r.cue for r in df.select("id", S.line_before(F.col("text"), F.col("start")).rlike(S.ADDRESS_CUE).alias("cue")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_flagged_by_context(spark):
    negs = spark.createDataFrame([(1, 0, 5, "A", "x"), (1, 0, 5, "A", "x"), (1, 9, 12, "B", None), (2, 0, 3, "A", "y")], "doc_id int, start int, end int, label string, ctx string")
    pred = spark.createDataFrame([(1, 4, 6, "P"), (1, 4, 7, "Q"), (2, 3, 4, "P")], "doc_id int, start int, end int, label string")
    assert {r.ctx: (r.n, r.flagged) for r in E.flagged_by(negs, pred).collect()} == {"x": (2, 2), "?": (1, 0), "y": (1, 0), "ALL": (4, 2)}


def test_range_search(spark):
    bounds = sorted({k * k % 997 for k in range(60)})
    for part in ([], bounds[:1], bounds[:2], bounds):
        df = spark.createDataFrame([(v,) for v in range(-1, 1000, 3)], "v int")
        assert all(r.k == bisect.bisect_left(part, r.v) for r in df.select("v", K._below(part, F.col("v")).alias("k")).collect())


def test_result_files(spark):
    files = [("v1_a.txt", 5), ("english/v1/v1_a.txt", 9), ("english/v1/v1_b.txt", 1), ("gpu_latency/A_1.txt", 3), ("gpu_latency/summary.tsv", 3), ("other", 1), ("v5/x/deep_1.txt", 1)]
    df = spark.createDataFrame(files, "path string, modified int")
    assert {r.path: r.target for r in B.organised(df).collect()} == {
        "v1_a.txt": "english/v1/v1_a.txt", "english/v1/v1_a.txt": None, "english/v1/v1_b.txt": "english/v1/v1_b.txt", "gpu_latency/A_1.txt": "v5/latency/gpu_latency/A_1.txt", "other": "misc/other", "v5/x/deep_1.txt": "v5/x/deep_1.txt",
    }
    asked = spark.createDataFrame([("v1_a.txt",), ("v1_b.txt",), ("x/deep_1.txt",), ("none.txt",), ("deep_1.txt",)], "rel string")
    assert {r.rel: r.path for r in B.located(asked, df).collect()} == {"v1_a.txt": "v1_a.txt", "v1_b.txt": "english/v1/v1_b.txt", "x/deep_1.txt": "v5/x/deep_1.txt", "none.txt": "none.txt", "deep_1.txt": "v5/x/deep_1.txt"}


def test_difficulty_in_one_pass(spark):
    from spanweave.operators import leaderboard as L

    rows = [(a, b, c, p / 16, q / 16) for k, (a, b, c, p, q) in enumerate((f"l{k % 3}", f"g{k % 2}", f"s{k % 5}", k * 7 % 17, k * 5 % 17) for k in range(90))]
    df = spark.createDataFrame(rows, "label string, lang string, source string, p_e double, p_c double")
    one, two = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=repr) for x in (L.difficulty_report(df), L.difficulty_summary(L.difficulty(df))))
    assert one == two
