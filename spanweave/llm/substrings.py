"""Removal of repeated word windows: a partitioned count-min prefilter, then an exact second pass.

The corpus is dealt once into chunks of whole documents. Pass one: each chunk is a partition whose windows
fill a sparse count-min sketch of ``DEPTH`` rows; the rows are cut into slices and each slice's partition
sketches are merged. The merged counters only overestimate, so a window whose least counter is below two
occurs once in the whole corpus and is dropped; each chunk gets back one bit per cell. The sketch uses a fast
linear hash of the words: windows that share it are only overestimated. Pass two: the windows estimated as
repeated, and no others, are grouped by the 128-bit BLAKE2b digest of their words, joined by one space, so equal
means equal words (no two texts of one digest are known, and none can be made on purpose).

Scale: sketch width follows the corpus (cells per window are fixed), and no task or broadcast holds more
than one slice. A chunk sends one entry for each distinct window, so a passage that a third of the corpus
shares costs one entry a chunk. The text is shuffled once; all passes reuse that exchange.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.common import picked

WINDOW = 13
DEPTH = 2
CHUNK_BYTES = 8 << 20
#: A slice of a sketch row has 2**25 cells for the windows of SLICE_BYTES of text, so about eight for each.
SLICE_BITS = 25
SLICE_BYTES = 24 << 20
LAST = np.iinfo(np.int64).max

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < size:
        size = max(size, _BLOCK)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(size, np.uint64(base))
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        _powers = (out[0], out[1])
    return _powers


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of documents laid end to end, and each document's first word number (and the total)."""
    gap = _SEPARATOR[data]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[full]] = True
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    after[offsets[full + 1] - 1] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = np.searchsorted(starts, offsets)
    doc = 0
    while doc < len(offsets) - 1:
        upto = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + _BLOCK, "right")) - 1)
        a, b = int(offsets[doc]), int(offsets[upto])
        i, j = int(first[doc]), int(first[upto])
        if j > i:
            power, inverse = _tables(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            hashes[i:j] = _mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        doc = upto
    return hashes, first


def _rolled(words: np.ndarray, base: int, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, built by doubling."""
    runs, have, left = {1: words}, 1, size
    b = lambda n: np.uint64(pow(base, n, 1 << 64))
    while have * 2 <= size:
        h = runs[have]
        runs[have * 2] = h[: len(h) - have] * b(have) + h[have:]
        have *= 2
    out, done = runs[have], have
    left -= have
    while left:
        piece = 1 << (left.bit_length() - 1)
        n = len(words) - done - piece + 1
        out = out[:n] * b(piece) + runs[piece][done : done + n]
        done, left = done + piece, left - piece
    return _mix(out)


def _data(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk's texts end to end, and the offsets of the texts."""
    text = table.column("text").combine_chunks().fill_null("").cast(pa.large_string())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _windows(table: pa.Table, size: int):
    """Of a chunk: the sketch's hash, start word and document of every window, and the word offsets."""
    words, first = _word_hashes(*_data(table))
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), first
    start = np.flatnonzero(doc[: len(words) - size + 1] == doc[size - 1 :])
    return _rolled(words, 0x9FB21C651E98DF25, size)[start], start, doc[start], first


def _digests(table: pa.Table, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of the windows' words that begin at some words of a chunk."""
    data, offsets = _data(table)
    gap = _SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:-1]
    # Each word's bytes and one space: the place of a byte follows from the words before it.
    kept = np.flatnonzero(~gap)
    before = np.cumsum(last[kept]) - last[kept]
    joined = np.full(len(kept) + int(last.sum()), 0x20, np.uint8)
    joined[np.arange(len(kept)) + before] = data[kept]
    ends = np.flatnonzero(last[kept]) + np.arange(int(last.sum())) + 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    view, digest, out = memoryview(joined), hashlib.blake2b, []
    for at in range(0, len(start), 1 << 15):
        own = start[at : at + (1 << 15)]
        spans = zip(begins[own].tolist(), ends[own + size - 1].tolist())
        out.append(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in spans]))
    raw = np.frombuffer(b"".join(out), ">u8").reshape(-1, 2)
    return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)


def _packed(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, bytes of equal weight together, compressed."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return pa.compress(gaps.view(np.uint8).reshape(len(gaps), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, count: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=count * width, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, count).T).view(kind).ravel(), dtype=kind)


def _cells(one: np.ndarray, slices: int):
    """For each sketch row: its distinct cells (slice and offset in one number), their counts, each window's place."""
    for row in range(DEPTH):
        h = _mix(one + np.uint64((row + 1) * 0xA24BAED4963EE407 % (1 << 64)))
        cell = ((h >> np.uint64(32)) % np.uint64(slices) << np.uint64(SLICE_BITS)) | (h & np.uint64((1 << SLICE_BITS) - 1))
        yield row, *np.unique(cell, return_inverse=True, return_counts=True)


def _by_slice(cells: np.ndarray):
    """(slice, from, to) of sorted cells."""
    part = (cells >> np.uint64(SLICE_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[a]), int(a), int(b)


_SKETCH = "chunk long, row int, slice long, n long, cells binary, more binary"
_ANSWER = "chunk long, row int, slice long, bits binary"
_ENTRY = "chunk long, slice long, n long, one binary, two binary, doc binary"


def _sketch(size: int, slices: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        one = _windows(table, size)[0]
        out = []
        for row, cells, _, counts in _cells(one, slices):
            for part, a, b in _by_slice(cells):
                offsets = (cells[a:b] & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)
                out.append((chunk, row, part, b - a, _packed(offsets), np.packbits(counts[a:b] > 1).tobytes()))
        return _table(out, ("chunk", "row", "slice", "n", "cells", "more"), _TYPES_SKETCH)

    return run


_TYPES_SKETCH = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_TYPES_ANSWER = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
_TYPES_ENTRY = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _table(rows: list[tuple], names: tuple, types: tuple) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _merged(table: pa.Table) -> pa.Table:
    """One slice of one row: add the partition sketches, then tell each chunk which of its cells have two or more."""
    counter = np.zeros(1 << SLICE_BITS, np.uint8)
    row, part = table.column("row")[0].as_py(), table.column("slice")[0].as_py()
    names = ("chunk", "n", "cells", "more")

    def each():
        for k in range(table.num_rows):
            chunk, n, blob, more = (table.column(c)[k].as_py() for c in names)
            yield chunk, n, _unpacked(blob, n, np.uint32), more

    for _, n, cells, more in each():
        twice = np.unpackbits(np.frombuffer(more, np.uint8), count=n)
        counter[cells] = np.minimum(counter[cells] + 1 + twice, 2)
    out = [(chunk, row, part, np.packbits(counter[cells] > 1).tobytes()) for chunk, _, cells, _ in each()]
    return _table(out, ("chunk", "row", "slice", "bits"), _TYPES_ANSWER)


def _repeated(one: np.ndarray, slices: int, answers: pa.Table) -> np.ndarray:
    """Which windows every sketch row estimates at two or more."""
    bits = _answers(answers, 0)
    found = np.ones(len(one), bool)
    for row, cells, place, _ in _cells(one, slices):
        flag = np.zeros(len(cells), bool)
        for part, a, b in _by_slice(cells):
            flag[a:b] = np.unpackbits(np.frombuffer(bits[row, part], np.uint8), count=b - a)
        found &= flag[place]
    return found


def _answers(table: pa.Table, kind: int) -> dict:
    """Bits by (row, slice) of the sketch (kind 0) or of the exact pass, whose row is -1 (kind 1)."""
    rows = zip(*(table.column(c).to_pylist() for c in ("row", "slice", "bits")))
    return {(r, s): b for r, s, b in rows if (r < 0) == bool(kind)}


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _candidates(table: pa.Table, size: int, slices: int, answers: pa.Table):
    """The chunk's windows that the sketch leaves, grouped: first entry of each distinct window is its least document.

    Returns, sorted by digest and document, both halves of the digests, ids, starts, documents, where a distinct window
    begins, and the word offsets.
    """
    rolled, start, doc, first = _windows(table, size)
    at = np.flatnonzero(_repeated(rolled, slices, answers)) if len(rolled) else np.zeros(0, np.int64)
    start, doc = start[at], doc[at]
    one, two = _digests(table, start, size) if len(start) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    ids = _ids(table)[doc]
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    return one[order], two[order], ids[order], start[order], doc[order], new, first


def _exact_slices(one: np.ndarray, slices: int):
    """(slice, from, to) of sorted hashes; slices are equal ranges of the hash."""
    width = (1 << 64) // slices + 1
    edges = [min(k * width, (1 << 64) - 1) for k in range(slices + 1)]
    cuts = np.searchsorted(one, np.array(edges, np.uint64))
    cuts[-1] = len(one)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield k, int(a), int(b)


def _enter(size: int, slices: int):
    def run(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], ("chunk", "slice", "n", "one", "two", "doc"), _TYPES_ENTRY)
        one, two, ids, _, _, new, _ = _candidates(table, size, slices, answers)
        one, two, ids = one[new], two[new], ids[new]
        out = []
        for part, a, b in _exact_slices(one, slices):
            known, place = np.unique(ids[a:b], return_inverse=True)
            doc = np.int64(len(known)).tobytes() + known.tobytes() + pa.compress(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
            out.append((key[0].as_py(), part, b - a, _packed(one[a:b]), two[a:b].tobytes(), doc))
        return _table(out, ("chunk", "slice", "n", "one", "two", "doc"), _TYPES_ENTRY)

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """One range of hashes: group the chunks' entries exactly, and tell each chunk which of its windows begin in an earlier document."""
    part = table.column("slice")[0].as_py()
    sizes = np.array(table.column("n").to_pylist(), np.int64)
    one = np.concatenate([_unpacked(b.as_py(), n, np.uint64) for b, n in zip(table.column("one"), sizes)])
    two = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("two")])
    ids = []
    for b, n in zip(table.column("doc"), sizes):
        raw = b.as_py()
        known = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
        planes = np.frombuffer(pa.decompress(raw[8 + known.nbytes :], decompressed_size=int(n) * 4, codec="zstd", asbytes=True), np.uint8)
        ids.append(known[np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel()])
    ids = np.concatenate(ids)
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    least = ids[order][new][np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = ids[order] > least
    cuts = np.cumsum(sizes) - sizes
    out = [(c, -1, part, np.packbits(later[a : a + n]).tobytes()) for c, a, n in zip(table.column("chunk").to_pylist(), cuts, sizes)]
    return _table(out, ("chunk", "row", "slice", "bits"), _TYPES_ANSWER)


def _removed(table: pa.Table, size: int, slices: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For every word of the chunk whether it goes, and the word offsets of the documents."""
    one, _, ids, start, _, new, first = _candidates(table, size, slices, answers)
    bits = _answers(answers, 1)
    distinct = one[new]
    flag = np.zeros(len(distinct), bool)
    for part, a, b in _exact_slices(distinct, slices):
        flag[a:b] = np.unpackbits(np.frombuffer(bits[-1, part], np.uint8), count=b - a)
    group = np.cumsum(new) - 1
    later = flag[group] | (ids > ids[new][group]) if len(one) else np.zeros(0, bool)
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, start[later], 1)
    np.add.at(edge, start[later] + size, -1)
    return np.cumsum(edge)[:-1] > 0, first


def _kept(size: int, slices: int, keep_text: bool):
    def run(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
        if table.num_rows:
            gone, first = _removed(table, size, slices, answers)
            for k in range(table.num_rows):
                mask = gone[first[k] : first[k + 1]]
                words = (table.column("text")[k].as_py() or "").encode().split()
                kept = b" ".join(compress(words, ~mask) if mask.any() else words)
                rows["n_words"].append(len(words))
                rows["n_removed"].append(int(mask.sum()))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["kept_text"].append(kept.decode() if keep_text else None)
            rows["doc_id"] = table.column("doc_id").to_pylist()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(rows.values(), types)], names=list(rows))

    return run


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row of ``docs``.

    Words are runs of anything but blanks 0x20 and 0x09 to 0x0D. A word goes if a window of ``window`` words
    that covers it also starts in a document with a smaller id. Null texts have no words; a null id counts as
    larger than any other; rows that share an id do not remove each other's words; extra columns are not read;
    an empty table gives no rows; ids are whole numbers, others raise ``ValueError``. Rows that repeat both id and
    text are dealt to one chunk. ``keep_text=False`` leaves ``kept_text`` null.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids are compared, so they must be whole numbers")
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    slices = max(1, -(-total // SLICE_BYTES))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    sketches = dealt.groupBy("chunk").applyInArrow(_sketch(window, slices), _SKETCH)
    answers = sketches.groupBy("row", "slice").applyInArrow(_merged, _ANSWER)
    entries = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_enter(window, slices), _ENTRY)
    exact = entries.groupBy("slice").applyInArrow(_grouped, _ANSWER)
    both = answers.unionByName(exact)
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(
        _kept(window, slices, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
