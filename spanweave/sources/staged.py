"""File formats that Spark lacks, as Python data sources: JSON lines compressed by xz, and arrays in ``.npy`` shards.

Writing takes two phases. A task writes files of names of its own below ``_staged``; when all tasks are done the
driver moves the files of the attempts that count beside each other and drops the rest, so a task that ran twice, or
died half-way, leaves nothing behind. Paths are URIs of any file system that pyarrow reaches.
"""

from __future__ import annotations

import io
import json
import lzma
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Lines and bytes of a batch that is handed to Spark; bytes that are decompressed at a time.
BATCH_LINES, BATCH_BYTES, READ_BYTES = 4_096, 4 << 20, 1 << 20
STAGED = "_staged"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}")


def exists(path: str) -> bool:
    system, at = _opened(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    """Files of one attempt, and what a sink says of each."""

    files: list[str] = field(default_factory=list)
    told: list[dict] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """Writes below ``_staged`` and moves what counts; subclasses write the files of a task and may add one at the end."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.options = options["path"].rstrip("/"), overwrite, dict(options)
        self.run = uuid.uuid4().hex

    def files(self, batches: Iterator[pa.RecordBatch], create) -> Iterator[dict]:
        """Writes a task's rows by ``create(name)``, which opens a stream; yields what is told of each file."""
        raise NotImplementedError

    def last(self, told: list[dict]) -> tuple[str, bytes] | None:
        """Name and bytes of a file beside the others."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        attempt, done = uuid.uuid4().hex, Written()
        system.create_dir(f"{root}/{STAGED}/{self.run}", recursive=True)

        def create(suffix: str):
            done.files.append(f"{attempt}-{len(done.files)}{suffix}")
            return system.open_output_stream(f"{root}/{STAGED}/{self.run}/{done.files[-1]}", compression=None)

        done.told = list(self.files(iterator, create))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name != STAGED:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        told, number = [], len([f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.startswith("part-")])
        for message in messages:
            for name, said in zip(message.files, message.told) if message else ():
                final = f"part-{number:06d}{name[name.index('.') :]}"
                system.move(f"{root}/{STAGED}/{self.run}/{name}", f"{root}/{final}")
                told.append({"file": final, **said})
                number += 1
        if more := self.last(told):
            with system.open_output_stream(f"{root}/{more[0]}") as out:
                out.write(more[1])
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        """What attempts that do not count have left, of this run only."""
        if system.get_file_info(f"{root}/{STAGED}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGED}/{self.run}")
        if not system.get_file_info(fs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)) and system.get_file_info(f"{root}/{STAGED}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGED}")


# -- JSON lines by xz --------------------------------------------------------------------------------------------


class _XzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """One for each file: a stream can only be read from its begin."""
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in found if f.is_file and f.path.endswith(".xz") and f"/{STAGED}/" not in f.path]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        with system.open_input_stream(partition.path) as raw, lzma.open(raw) as text:
            no, held, size = 0, [], 0

            def batch() -> pa.RecordBatch:
                first = no - len(held)
                said = pa.array([line.decode("utf-8", "replace") for line in held])
                return pa.record_batch([pa.array([partition.path] * len(held)), pa.array(range(first, no), pa.int64()), said], ["path", "no", "line"])

            for line in text:
                held.append(line.rstrip(b"\r\n"))
                no, size = no + 1, size + len(line)
                if len(held) >= BATCH_LINES or size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
            if held:
                yield batch()


class _XzWriter(StagedWriter):
    def files(self, batches, create):
        out, rows = None, 0
        for batch in batches:
            if out is None:
                raw = create(".jsonl.xz")
                out = lzma.open(raw, "wb", preset=int(self.options.get("preset", 3)))
            for value in batch.column(0).cast(pa.binary()):
                if value.is_valid:
                    out.write(value.as_py() + b"\n")
                    rows += 1
        if out is not None:
            out.close()
            raw.close()
            yield {"rows": rows}


class XzLines(DataSource):
    """``path, no, line`` of the lines of all ``.xz`` files below a path; writing takes one column of lines."""

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return "path string, no bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _XzReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _XzWriter(self.options, overwrite)


# -- arrays ------------------------------------------------------------------------------------------------------


def npy(rows: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, rows, allow_pickle=False)
    return out.getvalue()


class _NpyWriter(StagedWriter):
    """Shards of at most ``rows`` sequences; the first column of rows has the numbers, all of one length."""

    def files(self, batches, create):
        kind, most = np.dtype(self.options.get("dtype", "int32")), int(self.options.get("rows", 4_096))
        held, count, seen = [], 0, set()

        def shard():
            whole = np.concatenate(held)
            with create(".npy") as out:
                out.write(npy(whole[:most]))
            held[:] = [whole[most:]] if len(whole) > most else []
            return {"rows": min(len(whole), most), "width": int(whole.shape[1])}

        for batch in batches:
            column = batch.column(0)
            if column.null_count or not len(column):
                if column.null_count:
                    raise ValueError("a sequence is null")
                continue
            seen |= set(column.value_lengths().to_pylist())
            flat = column.flatten()
            if len(seen) > 1 or flat.null_count:
                raise ValueError(f"sequences of lengths {sorted(seen)} or with nulls do not make one array")
            numbers = flat.to_numpy(zero_copy_only=False)
            narrow = numbers.astype(kind)
            if (narrow != numbers).any():
                raise ValueError(f"numbers do not fit {kind}")
            held.append(narrow.reshape(len(column), -1))
            count += len(column)
            while count >= most:
                yield shard()
                count -= most
        if count:
            yield shard()

    def last(self, told):
        widths = {t["width"] for t in told}
        if len(widths) > 1:
            raise ValueError(f"tasks wrote sequences of lengths {sorted(widths)}")
        meta = {**json.loads(self.options.get("meta", "{}")), "dtype": self.options.get("dtype", "int32"), "width": max(widths, default=0), "sequences": sum(t["rows"] for t in told), "shards": [{"file": t["file"], "rows": t["rows"]} for t in told]}
        return "meta.json", (json.dumps(meta, ensure_ascii=False, sort_keys=True) + "\n").encode()


class _NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        system, root = _opened(self.path)
        with system.open_input_stream(f"{root}/meta.json") as said:
            meta = json.loads(said.read())
        return [_File(f"{root}/{s['file']}") for s in meta["shards"]]

    def read(self, partition):
        system, _ = _opened(self.path)
        with system.open_input_stream(partition.path) as raw:
            rows = np.load(io.BytesIO(raw.read()), allow_pickle=False)
        name = partition.path.rsplit("/", 1)[1]
        ids = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel().astype(np.int64)))
        yield pa.record_batch([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), ids], ["shard", "no", "ids"])


class NpyShards(DataSource):
    """``shard, no, ids`` of arrays in ``.npy`` shards that ``meta.json`` lists; writing takes one column of sequences."""

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def schema(self) -> str:
        return "shard string, no bigint, ids array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _NpyWriter(self.options, overwrite)


def _with(spark: SparkSession, source: type[DataSource]) -> str:
    spark.dataSource.register(source)
    return source.name()


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, no, line``: lines of every ``.xz`` file below ``path``, numbered in their file."""
    return spark.read.format(_with(spark, XzLines)).option("path", path).load()


def write_xz_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as JSON lines in ``.jsonl.xz`` files, one for each task that has rows; null fields are left out."""
    said = df.select(F.to_json(F.struct("*")).alias("value"))
    said.write.format(_with(df.sparkSession, XzLines)).mode("overwrite" if overwrite else "append").option("path", path).save()


def write_arrays(seqs: DataFrame, path: str, ids: str = "ids", meta: dict | None = None, dtype: str = "int32", rows: int = 4_096, overwrite: bool = False) -> None:
    """Sequences of one length as ``.npy`` shards of at most ``rows``, and ``meta.json`` with settings and totals."""
    options = {"path": path, "dtype": dtype, "rows": str(rows), "meta": json.dumps(meta or {})}
    seqs.select(ids).write.format(_with(seqs.sparkSession, NpyShards)).mode("overwrite" if overwrite else "append").options(**options).save()


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """``shard, no, ids`` of what :func:`write_arrays` wrote."""
    return spark.read.format(_with(spark, NpyShards)).option("path", path).load()
