"""Two-phase sinks, xz lines, array shards, typed rows with their rejects, and configurations."""

import json
import lzma
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.sources import readers as R
from spanweave.sources import staged as X
from spanweave.sources import typed as Y


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def batch(values, kind=pa.list_(pa.int32())):
    return pa.record_batch([pa.array(values, kind)], ["x"])


def test_a_task_that_ran_twice_leaves_nothing(tmp_path):
    writer = X._NpyWriter({"path": str(tmp_path), "rows": "2", "meta": '{"seq": 3}'}, False)
    first = writer.write(iter([batch([[1, 2], [3, 4]]), batch([[5, 6]])]))
    again = writer.write(iter([batch([[1, 2], [3, 4]]), batch([[5, 6]])]))
    with pytest.raises(ValueError):
        writer.write(iter([batch([[7, 8], [9, 9]]), batch([[1]])]))  # dies half-way, after a shard
    assert len(files(tmp_path)) == 5 and first.files != again.files
    writer.commit([again, None, X.Written()])
    assert files(tmp_path) == ["meta.json", "part-000000.npy", "part-000001.npy"]
    meta = json.loads((tmp_path / "meta.json").read_text())
    assert meta == {"seq": 3, "dtype": "int32", "width": 2, "sequences": 3, "shards": [{"file": "part-000000.npy", "rows": 2}, {"file": "part-000001.npy", "rows": 1}]}
    assert np.load(tmp_path / "part-000001.npy").tolist() == [[5, 6]]


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = X._XzWriter({"path": str(tmp_path)}, False)
    writer.write(iter([batch(["a", "b"], pa.string())]))
    writer.abort([])
    assert files(tmp_path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    seqs = spark.range(100).select(F.when(F.col("id") == 77, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("ids")).repartition(4)
    with pytest.raises(Exception, match="do not make one array|wrote sequences"):
        X.write_arrays(seqs, f"file://{tmp_path}/a", rows=5)
    assert not any("part-" in f or "meta" in f for f in files(tmp_path))


def test_arrays(spark, tmp_path):
    rows = [([k, k * 3, -k],) for k in range(103)]
    df = spark.createDataFrame(rows, "ids array<int>").repartition(3)
    X.write_arrays(df, f"file://{tmp_path}/a", rows=10, meta={"seed": 5})
    assert sorted(r.ids for r in X.arrays(spark, f"file://{tmp_path}/a").collect()) == sorted(r[0] for r in rows)
    whole = np.concatenate([np.load(tmp_path / "a" / f) for f in files(tmp_path / "a") if f.endswith(".npy")])
    assert whole.dtype == np.int32 and sorted(whole.tolist()) == sorted(r[0] for r in rows)
    X.write_arrays(df.limit(4), f"file://{tmp_path}/a", dtype="int16", overwrite=True)
    assert X.arrays(spark, f"file://{tmp_path}/a").count() == 4
    with pytest.raises(Exception, match="do not fit"):
        X.write_arrays(spark.createDataFrame([([1 << 20],)], "ids array<int>"), f"file://{tmp_path}/b", dtype="int16")


def test_xz_lines(spark, tmp_path):
    with lzma.open(tmp_path / "a.jsonl.xz", "wb") as out:
        out.write('{"a": 1}\r\n\n{"a": "é"}\nlast'.encode())
    with lzma.open(tmp_path / "b.jsonl.xz", "wb"):
        pass
    got = sorted((r.path.rsplit("/", 1)[1], r.no, r.line) for r in X.xz_lines(spark, str(tmp_path)).collect())
    assert got == [("a.jsonl.xz", 0, '{"a": 1}'), ("a.jsonl.xz", 1, ""), ("a.jsonl.xz", 2, '{"a": "é"}'), ("a.jsonl.xz", 3, "last")]
    X.write_xz_jsonl(spark.range(50).select("id", F.lit(None).cast("string").alias("no")), f"file://{tmp_path}/out")
    back = Y.checked(X.xz_lines(spark, f"{tmp_path}/out"), "id long, no string")
    assert sorted(r.id for r in back.good.collect()) == list(range(50)) and back.rejected.collect() == []


LINES = [
    ('{"id": 1, "name": "a", "at": {"x": 1}}', None), ('{"id": 2}', None), ("", "blank"), ("  ", "blank"), ('{"id": 3, "name": "cut', "no JSON object"), ("[1]", "no JSON object"), ("12", "no JSON object"),
    ('{"id": "four"}', "id is no bigint"), ('{"id": 5.5}', "id is no bigint"), ('{"name": "b"}', "id is missing"), ('{"id": null}', "id is missing"), ('{"id": 6, "at": 7}', "at is no struct<x:int>"), ('{"id": 7, "more": [1], "name": null}', None),
]


def test_typed_rows(spark):
    lines = spark.createDataFrame([("f", k, t) for k, (t, _) in enumerate(LINES)], "path string, no long, line string")
    found = Y.checked(lines, "id long, name string, at struct<x:int>", ("id",))
    assert {r.no: r.reason for r in found.rejected.collect()} == {k: why for k, (_, why) in enumerate(LINES) if why not in (None, "blank")}
    good = {r.no: r for r in found.good.collect()}
    assert sorted(good) == [k for k, (_, why) in enumerate(LINES) if why is None]
    assert good[0].name == "a" and good[0]["at"].x == 1 and good[1].name is None
    assert found.good.columns == ["path", "no", "id", "name", "at"]


def test_loaded_split(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "a.jsonl").write_text('{"id": 1}\nno\n{"id": 2}\n')
    found = Y.loaded(spark, str(tmp_path), "train", "id int")
    assert [r.id for r in found.good.orderBy("no").collect()] == [1, 2]
    assert [(r.no, r.line) for r in found.rejected.collect()] == [(1, "no")]


def test_configuration(spark, tmp_path):
    far = {"a": 1, "b": 1, "c": 1}
    near = {"<<": far, "b": 2, "c": 2}
    said = {"x": {"<<": near, "c": 3}, "list": {"<<": [{"p": 1, "q": 1}, {"p": 2, "r": 2}], "r": {"<<": far, "a": 9}}}
    assert Y.merged_configuration(said) == {"x": {"a": 1, "b": 2, "c": 3}, "list": {"p": 1, "q": 1, "r": {"a": 9, "b": 1, "c": 1}}}
    (tmp_path / "c.json").write_text(json.dumps(said))
    rows = {r.path: r.value for r in R.configuration(spark, str(tmp_path / "c.json")).collect()}
    assert rows["x.a"] == "1" and rows["x.c"] == "3" and rows["list.r.b"] == "1"
    assert {"xz_lines", "arrays", "typed_split"} <= set(R.READERS.names())


def test_readers_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "q", " a "), (2, None, "b")], "id int, input string, output string").write.parquet(f"{tmp_path}/qa")
    assert sorted(r.text for r in R.READERS.read("answers", spark, path=f"{tmp_path}/qa").collect()) == ["\nb", "q\na"]
    assert R.READERS.read("held_out", spark, path=f"{tmp_path}/qa", key="id").columns == ["id", "input", "output", "split"]
    (tmp_path / "w.txt").write_text("a\tO\nb\tB-X\n.\tO\nc\tO\n")
    assert [r.tokens for r in R.READERS.read("words", spark, path=f"{tmp_path}/w.txt", least=2).orderBy("sentence").collect()] == [["a", "b", "."], ["c"]]
    assert len(R.READERS.names()) >= 21
    with pytest.raises(KeyError):
        R.READERS.read("none", spark)


def test_value_pools_are_kept_and_checked(spark, tmp_path):
    from spanweave.operators.corpus import value_pools

    first = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "g string, v int")
    later = spark.createDataFrame([("c", 3)], "g string, v int")
    assert sorted(map(tuple, value_pools(first, "g", "v", f"{tmp_path}/pool").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, value_pools(later, "g", "v", f"file://{tmp_path}/pool").collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="not the values"):
        value_pools(later.withColumnRenamed("v", "w"), "g", "w", f"{tmp_path}/pool")
    (tmp_path / "broken").mkdir()
    assert value_pools(later, "g", "v", f"{tmp_path}/broken").count() == 1
