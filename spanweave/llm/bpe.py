"""Byte-level BPE: ranked merges folded by Spark higher-order functions over the distinct words of the corpus.

A task splits its texts into words by the tokenizer's pattern and numbers the distinct ones of each chunk of texts.
The chunks' words are dealt by hash into buckets, where every distinct word is folded once, whatever the number of
chunks that have it: ``aggregate`` over the word's bytes merges, step by step, the leftmost pair of least rank. The
parts are binary strings, and the rank of two neighbours is looked up under their concatenation in a literal map,
cut into small maps by CRC-32 because Spark searches a map from its start. The ids go back to the chunks, which put
them together in the order of each text; decoding concatenates the ids' binary pieces.

Scale: texts are read once and never shuffled; one exchange has each chunk's distinct words and its word numbers (the
frequent ones small, compressed), and all steps read that exchange. Buckets follow the corpus, and a word is in a
bucket once for each chunk, so neither a frequent word nor a hot source fills one. A chunk is named by a digest of
what it holds: if a lost task's rows came again in another order, its answers would be missing and the job would stop. The fold's step copies the word's parts, so words beyond ``LONG`` bytes are merged by a heap
instead, in n log n. The map has the vocabulary's fixed size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from spanweave.llm.common import picked, release, splitter

BUCKETS = 1 << 16
#: Characters of text in a chunk; bytes of text for each bucket of words; words folded in one row; bytes of a long word.
CHUNK_CHARS, BUCKET_BYTES, FOLD_WORDS, LONG = 8 << 20, 16 << 20, 2_000, 256
_UNKNOWN = 2**31 - 1
_RANKS, _TOKENS = "__bpe_ranks__", "__bpe_tokens__"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """One vocabulary as literals of the plan, and the expressions that encode and decode with them."""

    def __init__(self, spark, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.pattern, self.ranks = pattern, ranks
        held: list[list] = [[] for _ in range(BUCKETS)]
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            held[zlib.crc32(token) % BUCKETS].append((token, rank))
            self.pieces[rank] = token
        row = {
            _RANKS: pa.array([held], pa.list_(pa.map_(pa.binary(), pa.int32()))),
            _TOKENS: pa.array([self.pieces], pa.list_(pa.binary())),
        }
        given = spark.createDataFrame(pa.table(row))
        self._constants = {name: given.select(name) for name in row}

    def beside(self, df: DataFrame) -> DataFrame:
        """``df`` with the literals as columns."""
        return df.withColumns({name: value.scalar() for name, value in self._constants.items()})

    @staticmethod
    def rank(piece: Column) -> Column:
        """The rank of a binary string, null if it is no token or null."""
        return F.try_element_at(F.get(F.col(_RANKS), F.crc32(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece)

    def fold(self, word: Column) -> Column:
        """The ids of a word (binary), by ranked merges.

        The state is the parts and, between two nulls, the rank of each neighbouring pair, null if it is no token.
        """

        def state(parts: Column, ranks: Column) -> Column:
            """Parts, ranks, and the place of the leftmost pair of least rank among the ranks, from 1."""
            return F.transform(F.array(ranks), lambda r: F.struct(parts.alias("parts"), r.alias("ranks"), F.array_position(r, F.array_min(r)).cast("int").alias("at")))[0]

        def merged(s: Column) -> Column:
            """The state after parts ``at - 1`` and ``at`` became one."""
            parts, ranks, at = s["parts"], s["ranks"], s["at"]

            def with_joined(joined: Column) -> Column:
                left, right = self.rank(F.concat(F.get(parts, at - 3), joined)), self.rank(F.concat(joined, F.get(parts, at)))
                return state(
                    F.concat(F.slice(parts, F.lit(1), at - 2), F.array(joined), F.slice(parts, at + 1, F.size(parts))),
                    F.concat(F.slice(ranks, F.lit(1), at - 2), F.array(left, right), F.slice(ranks, at + 2, F.size(ranks))),
                )

            return F.transform(F.array(F.concat(F.get(parts, at - 2), F.get(parts, at - 1))), with_joined)[0]

        def cut(width: int) -> Column:
            """The word's bytes, or its neighbouring pairs of bytes."""
            count = F.octet_length(word) - (width - 1)
            pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substring(word, k, F.lit(width)))
            return F.when(count > 0, pieces).otherwise(F.array().cast("array<binary>"))

        guard = F.array(F.lit(None).cast("int"))
        turns = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
        begun = state(cut(1), F.concat(guard, F.transform(cut(2), self.rank), guard))
        return F.aggregate(turns, begun, lambda s, _: F.when(s["at"].isNull(), s).otherwise(merged(s)), lambda s: F.transform(s["parts"], self.rank))

    @staticmethod
    def decoded(ids: Column) -> Column:
        """The bytes of ids: their pieces, concatenated in two levels, so that long arrays are not copied for each id."""
        width = F.greatest(F.ceil(F.sqrt(F.size(ids).cast("double"))).cast("int"), F.lit(1))

        def whole(pieces: Column) -> Column:
            return F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p))

        def run(k: Column) -> Column:
            return whole(F.transform(F.slice(ids, k * width + 1, width), lambda i: F.get(F.col(_TOKENS), i)))

        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(ids) / width).cast("int")), run)
        return F.when(ids.isNotNull(), whole(runs))


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by the same merges, the pairs in a heap ordered by rank and place."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    get = ranks.get
    rank = [get(word[i : i + 2], _UNKNOWN) for i in range(n - 1)] + [_UNKNOWN]
    heap = [(r, i) for i, r in enumerate(rank) if r != _UNKNOWN]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue
        gone = after[i]
        rank[gone] = -1
        after[i] = end = after[gone]
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0:
                middle = after[k]
                rank[k] = new = get(word[k : after[middle]], _UNKNOWN) if middle < n else _UNKNOWN
                if new != _UNKNOWN:
                    heapq.heappush(heap, (new, k))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


# -- what travels ------------------------------------------------------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, bytes of equal weight together, compressed."""
    data = np.ascontiguousarray(numbers, np.uint32)
    return pa.compress(data.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(data) else b""


def _unpacked(blob: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=4 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, count).T).view(np.uint32).ravel()


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _cut(blob: bytes, sizes: np.ndarray) -> list[bytes]:
    """The byte strings of a compressed run of them."""
    total = int(sizes.sum())
    data = pa.decompress(blob, decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``first``, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(first - before, sizes) + np.arange(total)]


_NUMBERED = "at long, chunk long, n long, sizes binary, data binary, places binary, keys array<{kind}>"
_WORDS = pa.schema({"at": pa.int64(), "words": pa.list_(pa.binary())})
_ANSWER = pa.schema({"at": pa.int64(), "n": pa.int64(), "places": pa.binary(), "sizes": pa.binary(), "total": pa.int64(), "ids": pa.binary()})


class _Numbers(dict):
    """The number of each word, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


def _chunk_rows(name: bytes, buckets: int, keys: list, sizes: list[int], numbers: list[np.ndarray], known: dict[str, int]):
    """Rows of one chunk: its documents (``at`` is the chunk, below zero: words in each, word numbers in order, keys), and
    its distinct words of each bucket (``at`` is the bucket: their lengths, bytes, and numbers)."""
    words = np.concatenate(numbers)
    often = np.argsort(-np.bincount(words, minlength=len(known)), kind="stable")
    number = np.empty(len(often), np.uint32)
    number[often] = np.arange(len(often))
    counts, data = _packed(np.array(sizes, np.uint32)), _packed(number[words])
    spelled = [w.encode() for w in known]
    said = [spelled[k] for k in often.tolist()]
    mark = hashlib.blake2b(name, digest_size=8)
    for part in (counts, data, *said):
        mark.update(part)
    chunk = -(int.from_bytes(mark.digest(), "big") >> 1) - 1
    yield [(chunk, chunk, len(words), counts, data, None, keys)]
    bucket = np.fromiter((zlib.crc32(w, 1) % buckets for w in said), np.int64, len(said))
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    held = []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        at = order[a:b]
        part = [said[k] for k in at.tolist()]
        lengths = np.fromiter(map(len, part), np.uint32, len(part))
        held.append((int(bucket[at[0]]), chunk, len(part), _packed(lengths), _squeezed(b"".join(part)), _packed(np.diff(at, prepend=0)), None))
        if len(held) == 64:
            yield held
            held = []
    if held:
        yield held


def _numbered(rows: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """:func:`_chunk_rows` of every chunk of texts."""
    schema = T._parse_datatype_string(_NUMBERED.format(kind=rows.schema["doc_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        split = splitter(pattern)
        task, count = TaskContext.get().partitionId(), 0
        known, keys, sizes, numbers, chars = _Numbers(), [], [], [], 0

        def out():
            for part in _chunk_rows(f"{task} {count}".encode(), buckets, keys, sizes, numbers, known):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = split(text or "")
                    keys.append(key)
                    sizes.append(len(found))
                    numbers.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                    chars += len(text or "")
                    if chars >= CHUNK_CHARS:
                        yield from out()
                        known, keys, sizes, numbers, chars, count = _Numbers(), [], [], [], 0, count + 1
        if keys:
            yield from out()
        known, keys, sizes, numbers = _Numbers(), [], [], []
        release()

    return rows.mapInArrow(run, schema)


def _columns(rows: list[tuple], arrow: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in arrow]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _distinct(table: pa.Table) -> pa.Table:
    """The distinct words of a bucket that the fold takes."""
    bucket = table.column("at")[0].as_py()
    seen: set[bytes] = set()
    if bucket >= 0:
        for n, sizes, data in zip(*(table.column(c).to_pylist() for c in ("n", "sizes", "data"))):
            seen.update(w for w in _cut(data, _unpacked(sizes, n)) if len(w) <= LONG)
    words = sorted(seen)
    return _columns([(bucket, words[k : k + FOLD_WORDS]) for k in range(0, len(words), FOLD_WORDS)], _WORDS)


def _answers(ranks: dict[bytes, int]):
    """Of a bucket, the ids of each chunk's words."""

    def run(words: pa.Table, folded: pa.Table) -> pa.Table:
        if not words.num_rows or words.column("at")[0].as_py() < 0:
            return _columns([], _ANSWER)
        place: dict[bytes, int] = {}
        lists = folded.column("ids").combine_chunks().flatten()
        for part in folded.column("words").to_pylist():
            for w in part:
                place[w] = len(place)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
        longer: list[list[int]] = []
        rows = list(zip(*(words.column(c).to_pylist() for c in ("chunk", "n", "sizes", "data", "places"))))
        held = [_cut(data, _unpacked(sizes, n)) for _, n, sizes, data, _ in rows]
        for part in held:
            for w in part:
                if len(w) > LONG and w not in place:
                    place[w] = len(place)
                    longer.append(merged_long(w, ranks))
        counts = np.concatenate([counts, np.array([len(x) for x in longer], np.int64)])
        ids = np.concatenate([ids, *(np.array(x, np.uint32) for x in longer)])
        first = np.cumsum(counts) - counts
        out = []
        for (chunk, n, _, _, places), part in zip(rows, held):
            at = np.fromiter(map(place.__getitem__, part), np.int64, n)
            mine = _gathered(ids, first[at], counts[at])
            out.append((chunk, n, places, _packed(counts[at]), len(mine), _packed(mine)))
        return _columns(out, _ANSWER)

    return run


def _word_ids(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk's words in the order of their numbers, and how many each word has."""
    places, sizes, ids = [], [], []
    for n, place, size, total, blob in zip(*(answers.column(c).to_pylist() for c in ("n", "places", "sizes", "total", "ids"))):
        places.append(np.cumsum(_unpacked(place, n).astype(np.int64)))
        sizes.append(_unpacked(size, n).astype(np.int64))
        ids.append(_unpacked(blob, total))
    if not places:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    count = np.concatenate(sizes)
    order = np.argsort(np.concatenate(places))
    first = np.cumsum(count) - count
    return _gathered(np.concatenate(ids), first[order], count[order]), count[order]


def _assembled(rows: DataFrame, codec: Codec, schema: str, prepare: Callable, finish: Callable) -> DataFrame:
    """Rows of documents: ``prepare(ids_of_words)`` makes what ``finish(prepared, words)`` needs of a chunk."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    numbered = _numbered(rows, codec.pattern, buckets)
    distinct = numbered.groupBy("at").applyInArrow(_distinct, from_arrow_schema(_WORDS))
    folded = codec.beside(distinct).select("at", "words", F.transform("words", codec.fold).alias("ids"))
    answers = numbered.groupBy("at").cogroup(folded.groupBy("at")).applyInArrow(_answers(codec.ranks), from_arrow_schema(_ANSWER))

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        made: list[tuple] = []
        if not chunk.num_rows or chunk.column("at")[0].as_py() >= 0:
            return _columns(made, arrow)
        ids, counts = _word_ids(answers)
        ends = np.cumsum(counts).tolist()
        ids = ids.tolist()
        held = prepare([ids[a:b] for a, b in zip([0, *ends], ends)])
        for n, sizes, data, keys in zip(*(chunk.column(c).to_pylist() for c in ("n", "sizes", "data", "keys"))):
            numbers = _unpacked(data, n)
            if n and int(numbers.max()) + 1 != len(counts):
                raise RuntimeError("a chunk's words came back incomplete: its texts were read again in another order")
            upto = np.cumsum(_unpacked(sizes, len(keys)), dtype=np.int64).tolist()
            for key, a, b in zip(keys, [0, *upto], upto):
                made.append((key, *finish(held, numbers[a:b].tolist())))
        held = ids = None
        out = _columns(made, arrow)
        release()
        return out

    return numbered.groupBy("at").cogroup(answers.groupBy("at")).applyInArrow(run, schema)


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for every row; a null text counts as empty and has no ids.

    Null ids and repeated rows are carried; extra columns are not read; an empty table gives no rows.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return _assembled(rows, codec, schema, lambda words: words, lambda ids, words: ([i for w in words for i in ids[w]],))


def decode(coded: DataFrame, codec: Codec, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``coded`` and the bytes of its ids as column ``name``; null ids stay null."""
    return codec.beside(coded).withColumn(name, codec.decoded(F.col(ids_col))).drop(_RANKS, _TOKENS)


def round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row: digests of all ids and of all decoded bytes.

    Rows as in :func:`encode`.
    """
    pieces = codec.pieces
    rows = picked(docs, doc_id=id_col, text=text_col)

    def prepare(words: list[list[int]]) -> tuple[list[str], list[bytes]]:
        said = [str(p) for p in range(len(pieces))]
        return [" ".join([said[i] for i in w]) for w in words], [b"".join([pieces[i] for i in w]) for w in words]

    def finish(held: tuple[list[str], list[bytes]], words: list[int]) -> tuple[int, str, str]:
        ids, data = held
        decimal = " ".join([ids[w] for w in words])
        return (
            decimal.count(" ") + 1 if words else 0,
            hashlib.sha256(decimal.encode()).hexdigest(),
            hashlib.sha256(b"".join([data[w] for w in words])).hexdigest(),
        )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _assembled(rows, codec, schema, prepare, finish)
