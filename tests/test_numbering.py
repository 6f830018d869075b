"""Numbers, held values and sentence cuts by buckets and splits against loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.sources import numbering as N
from spanweave.sources import readers as R


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_lines_of_a_file_of_many_splits(spark, tmp_path, ending):
    rng = random.Random(1)
    wanted = []
    for name in ("a.txt", "b.txt", "c.txt"):
        said = ["".join(rng.choices("abc é", k=rng.randint(0, 30))).strip("\r") for _ in range(3000 if name != "c.txt" else 1)]
        (tmp_path / name).write_bytes((ending.join(said) + (ending if name != "b.txt" else "")).encode())
        wanted += [(name, k, line) for k, line in enumerate(said) if name != "b.txt" or line or k + 1 < len(said)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = R.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r.path.rsplit("/", 1)[1], r.no, r.line) for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(wanted)


def test_lines_below_heads_of_many_splits(spark, tmp_path):
    """Heads, also repeated and last ones, whose lines go over batches and splits; no line is shuffled."""
    rng = random.Random(4)
    wanted = []
    for name in ("a.txt", "b.txt", "c.txt"):
        said = [rng.choice(["#h é", "#h x"]) if rng.random() < {"a.txt": 0.003, "b.txt": 0.3, "c.txt": 0}[name] else "w" + "x" * rng.randint(0, 9) for _ in range(4000)]
        (tmp_path / name).write_text("\n".join(said) + "\n")
        head = (None, None)
        for k, line in enumerate(said):
            head = (k, line) if line.startswith("#") else head
            wanted += [] if line.startswith("#") else [(name, *head, k, line)]
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = R.headed_lines(spark, str(tmp_path), F.col("line").startswith("#"))
        got = [(r.path.rsplit("/", 1)[1], r.head_no, r.head, r.no + i, line) for r in found.collect() for i, line in enumerate(r.lines)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def rows(spark, seed=2):
    rng = random.Random(seed)
    made = [(doc, no, rng.choice(["w", "w", "w", ".", "!"]), rng.choice([None, None, "x", "y"])) for doc in ("a", "b", None) for no in range(rng.randint(1, 200))]
    rng.shuffle(made)
    return sorted(made, key=lambda r: (str(r[0]), r[1])), spark.createDataFrame(made, "doc string, no int, tok string, v string")


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_buckets(spark, size):
    made, df = rows(spark)
    total, last, seen = {}, {}, []
    for doc, no, tok, v in made:
        total[doc] = total.get(doc, 0) + (tok == ".")
        last[doc] = v or last.get(doc)
        seen.append((doc, no, total[doc], last[doc]))
    out = N.running_total(df, "doc", (F.col("tok") == ".").cast("int"), "n", size=size).select("doc", "no", "n").collect()
    assert sorted((tuple(r) for r in out), key=repr) == sorted((s[:3] for s in seen), key=repr)
    out = N.held(df.drop("tok"), "doc", {"h": F.col("v")}, size=size).select("doc", "no", "h").collect()
    assert sorted((tuple(r) for r in out), key=repr) == sorted(((s[0], s[1], s[3]) for s in seen), key=repr)


@pytest.mark.parametrize("size, least", [(1, 4), (3, 1), (7, 4), (1000, 4)])
def test_cuts(spark, size, least):
    made, df = rows(spark, 3)
    want, count, sentence = [], {}, {}
    for doc, no, tok, _ in made:
        if not count.get(doc):
            sentence[doc] = sentence.get(doc, -1) + 1
        want.append((doc, no, sentence[doc]))
        count[doc] = count.get(doc, 0) + 1
        if tok in ".!" and count[doc] >= least:
            count[doc] = 0
    got = N.cut_after(df, "doc", F.col("tok").isin(".", "!"), least, "s", size=size).select("doc", "no", "s").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc string, no int, tok string, line string")
    assert N.cut_after(none, "doc", F.col("tok") == ".", 4, "s").collect() == []
    assert R.frames(none, "doc").collect() == [] and R.tagged_sentences(none, "doc").collect() == []
