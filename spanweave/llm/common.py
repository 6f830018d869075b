"""Helpers that the operators of this subpackage share: shared tables and sliced Arrow maps."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, notebooks) gets a temporary folder, once.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spanweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back; this cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: ``picked(df, doc_id="id")`` reads ``id`` as ``doc_id``."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are reused, and what one stage held would stay beside the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_slices(
    df: DataFrame,
    schema: T.StructType | str,
    make: Callable[[], Callable[[pa.RecordBatch], list | None]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``mapInArrow`` in slices of few rows, so that Python holds few decoded texts at a time.

    ``make()`` runs once in each task and returns the function from a slice to a list of columns.
    """
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = work(batch.slice(at, rows))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)],
                        schema=arrow,
                    )
        del work
        release()

    return df.mapInArrow(run, schema)


def struct_of(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` and further columns given as DDL."""
    return T.StructType(list(df.schema.fields) + list(T._parse_datatype_string(more).fields))


#: Classes that the built-in engine lacks or reads in another way, and escapes that both engines read alike.
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")
_ALIKE = set("rnt\\'\"[](){}.*+?|^$-/")


@lru_cache(maxsize=None)
def _ranges(name: str) -> str:
    """The characters of a class in the Basic Multilingual Plane, as ranges."""
    match = regex.compile(name).match
    inside = [not 0xD800 <= c < 0xE000 and match(chr(c)) is not None for c in range(0x10000)] + [False]
    edges = [c for c in range(0x10001) if inside[c] != (c > 0 and inside[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))


@lru_cache(maxsize=None)
def _plain(pattern: str) -> re.Pattern | None:
    """The pattern for the built-in engine, with classes written out; None if it has anything that might differ."""
    out, at, inside = "", 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            name = next((k for k in _CLASSES if pattern.startswith(k, at)), None)
            if name:
                out += _ranges(name) if inside else f"[{_ranges(name)}]"
                at += len(name)
                continue
            if pattern.startswith(r"\S", at) and not inside:
                out += f"[^{_ranges(_CLASSES[2])}]"
            elif pattern[at + 1 : at + 2] in _ALIKE:
                out += pattern[at : at + 2]
            else:
                return None
            at += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out += c
        at += 1
    return re.compile(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern of the regex library.

    The built-in engine is over twice as fast on classes written out, but only for characters of one plane; texts
    with others, and patterns that it may read in another way, go through the library.
    """
    whole, plain = regex.compile(pattern).findall, _plain(pattern)
    if plain is None:
        return whole
    quick = plain.findall

    def split(text: str) -> list[str]:
        return quick(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else whole(text)

    return split
