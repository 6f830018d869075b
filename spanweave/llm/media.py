"""Media columns: payloads stored once by content in tar shards, read back by byte ranges.

A payload is written as a lossless grayscale PNG of 8-bit samples, ``WIDTH`` samples a row. Each task appends the
distinct payloads of its rows to one tar shard in the shared folder and returns, for every row, the digest and
the shard, offset and length of the stored form, so no payload crosses the network. Metadata columns are then
filled by ranged reads of the image header alone (``HEADER_BYTES``), and whole reads serve features.

Recovery: a shard is written under a name of its own for each attempt, and only rows of the attempt that
succeeded are kept, so a lost executor leaves at most an unreferenced file. The index is a written table: later
reads never write shards again.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, picked, shared_dir, stored

#: Samples in a row of the image, and so the unit that payloads are padded to.
WIDTH = 192
#: A PNG signature and its IHDR chunk: the fixed layout of the format.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A shard is closed when it reaches this size.
SHARD_BYTES = 256 << 20
#: Stored bytes that one task reads back.
READ_BYTES = 16 << 20
#: Names that Hadoop gives to file systems which Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """``payload`` with bytes 32 up to a positive multiple of ``unit``."""
    return payload + b" " * (-len(payload) % unit if payload else unit)


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    """Whole rows of 8-bit gray samples as a PNG; equal samples give equal bytes."""
    rows = len(samples) // width
    lines = np.zeros((rows, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, width)
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(data: bytes) -> dict:
    """Width, height, bit depth and colour type from the first ``HEADER_BYTES`` of a PNG."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def from_png(data: bytes) -> bytes:
    """The samples of a PNG written by :func:`to_png`, with the chunk checksums verified."""
    head, at, body = header(data), 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head["height"], head["width"] + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes, width: int = WIDTH) -> str:
    """Mean, deviation and an 8 by 8 average hash of the image, as text."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width).astype(np.float64)
    bands = np.linspace(0, len(image), 9).astype(int)
    rows = np.stack([image[a : max(b, a + 1)].mean(axis=0) if a < len(image) else image[-1] for a, b in zip(bands, bands[1:])])
    blocks = rows.reshape(8, 8, width // 8).mean(axis=2)
    bits = np.packbits((blocks > blocks.mean()).ravel()).tobytes().hex()
    return f"mean={image.mean():.3f};std={image.std():.3f};ahash={bits}"


class Files:
    """Files below one folder, by the file system that its address names."""

    def __init__(self, folder: str):
        scheme, mark, rest = folder.partition("://")
        self.system, self.root = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}")

    def write(self, name: str):
        self.system.create_dir(self.root, recursive=True)
        return self.system.open_output_stream(f"{self.root}/{name}")

    def read(self, name: str):
        return self.system.open_input_file(f"{self.root}/{name}")


class Shard:
    """One tar file under a name of its own; members are named by the digest of their payload."""

    def __init__(self, files: Files):
        self.files, self.name, self.size = files, "", 0
        self.stream, self.known = None, {}

    def add(self, digest: str, make) -> tuple[str, int, int]:
        if digest not in self.known:
            if self.stream is None:
                self.name = f"shard-{uuid.uuid4().hex}.tar"
                self.stream, self.size = self.files.write(self.name), 0
            data = make()
            info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.PAX_FORMAT)
            self.stream.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
            self.known[digest] = (self.name, self.size + len(head), len(data))
            self.size += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        place = self.known[digest]
        if self.size >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            self.stream.close()
            self.stream, self.known = None, {}


_INDEX = "digest string, n_bytes long, payload_bytes long, shard string, offset long, length long"


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text of ``docs`` as a payload; returns the index: the id, digest, sizes, shard, offset, length.

    The digest is the SHA-256 of the padded payload. Null texts count as empty; repeated texts of a task are
    stored once; null ids are carried; extra columns are not read; an empty table writes no shard.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(f"doc_id {kind}, {_INDEX}"))

    def run(batches):
        shard = Shard(Files(folder))
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part, out = batch.slice(at, 256), []
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        raw = (text or "").encode()
                        payload = padded(raw)
                        digest = hashlib.sha256(payload).hexdigest()
                        out.append((key, digest, len(raw), len(payload), *shard.add(digest, lambda p=payload: to_png(p))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        finally:
            shard.close()

    return stored(rows.mapInArrow(run, f"doc_id {kind}, {_INDEX}"), "media-index")


def _opener(folder: str):
    files, opened = Files(folder), {}

    def read(name: str, offset: int, length: int) -> bytes:
        if name not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            opened[name] = files.read(name)
        opened[name].seek(offset)
        return opened[name].read(length)

    return read


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with width, height and bit depth, read from the headers alone."""
    at = [index.columns.index(c) for c in ("shard", "offset")]

    def make():
        read = _opener(folder)

        def work(batch: pa.RecordBatch):
            heads = [header(read(s, o, HEADER_BYTES)) for s, o in zip(*(batch.column(i).to_pylist() for i in at))]
            return [*batch.columns, *([h[k] for h in heads] for k in ("width", "height", "bit_depth"))]

        return work

    from spanweave.llm.common import struct_of

    return map_slices(index, struct_of(index, "width int, height int, bit_depth int"), make)


def with_payload_columns(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with what whole reads give: digests of payload and stored form, the tail's CRC-32 and the feature."""
    at = [index.columns.index(c) for c in ("shard", "offset", "length")]
    names = "payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"

    def make():
        read, last = _opener(folder), {}

        def values(name: str, offset: int, length: int) -> tuple:
            if (name, offset) not in last:
                if len(last) > 4096:
                    last.clear()
                data = read(name, offset, length)
                samples = from_png(data)
                crc = zlib.crc32(samples[-16:])
                last[name, offset] = (hashlib.sha256(samples).hexdigest(), crc, hashlib.sha256(data).hexdigest(), feature(samples))
            return last[name, offset]

        def work(batch: pa.RecordBatch):
            got = [values(*x) for x in zip(*(batch.column(i).to_pylist() for i in at))]
            return [*batch.columns, *zip(*got)]

        return work

    from spanweave.llm.common import struct_of

    return map_slices(index, struct_of(index, names), make)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the payloads below the shared folder, then read headers and payloads back; one row for each row of ``docs``."""
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    index = store(docs, folder, id_col, text_col)
    # The index is small, so its own partitions would read many shards each: dealt by shard, a task reads about READ_BYTES.
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.repartition(max(1, -(-total // READ_BYTES)), "shard")
    return with_payload_columns(with_metadata(dealt, folder), folder).withColumnRenamed("length", "media_bytes")
