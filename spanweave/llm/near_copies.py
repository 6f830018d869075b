"""Near copies by SimHash and the exact Jaccard similarity of five-word shingles, and their components.

A text is the set of its shingles' 64-bit hashes. The vantage-point trees of the SimHash operator find the sets whose
fingerprints are within ``RADIUS`` bits, which are most of the close copies; similar sets further apart are found
exactly as follows. Sets are put in one global order, rare shingles first. Two sets
of similarity ``percent`` or more share a shingle within their first ``n - ceil(percent * n) + 1``, so grouping
these prefixes by shingle finds every pair; sizes, places and parity sketches then rule out pairs by bounds that
hold for all of them, and what is left is verified on the whole sets. No pair at the limit or above is lost, and
none below it is linked. Frequencies of shingles are estimated on a sample; any order gives the same links.

Scale: equal sets collapse first. Within a shingle's group every set is at first paired with the first few alone that
no bound parts it from, so a large group of copies gives linearly many pairs, also where its first set is no copy of
the others; then so again, in another order, with sets of other components. All pairs are compared only between the
components that this leaves. Texts are hashed once. Nothing is collected but the frequent shingles of the sample.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, release, stored, unused
from spanweave.llm.simhash import BITS, SEED, components, links, simhash

WORDS = 5
PERCENT = 80
RADIUS = 4
#: Sampled documents and frequent shingles kept, for the order only.
SAMPLE_ROWS, FREQUENT = 5_000, 50_000
#: Least words of a parity sketch; rows that one task groups.
SKETCH = 16
SHARD_ROWS = 200_000
#: Rows of a task in the rounds after the first, which have few rows left and more pairs for each.
ROUND_ROWS = 25_000
#: Sets of a group that a set is compared with before components are known.
LEADERS = 3
#: An odd factor that puts keys in another order.
TURN = 0x9E3779B97F4A7C15
#: Shingles of the sets that one task compares.
SHARD_SHINGLES = 1_500_000
#: Rows of a digest each that may be broadcast (some 100 MB once hashed); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, none has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = [n + i for i, n in enumerate(accumulate(map(len, tokens)))]
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(tokens) - words + 1))


def parities(s: np.ndarray, bits: int | None = None) -> bytes:
    """The parity of a set's hashes in each cell of a table, a power of two, by default of four to eight cells a hash."""
    bits = bits or max(64, 1 << max(0, 4 * len(s) - 1).bit_length())
    cells = np.bincount(((s >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """At least so many hashes are in one of two sets only: the cells whose parities differ, the larger table folded."""
    a, b = (np.frombuffer(z, np.uint64) for z in (x, y))
    while len(a) != len(b):
        long = a if len(a) > len(b) else b
        folded = long[: len(long) // 2] ^ long[len(long) // 2 :]
        a, b = (folded, b) if len(a) > len(b) else (a, folded)
    return int(np.bitwise_count(a ^ b).sum())


def sketched(s: np.ndarray) -> bytes:
    """:func:`parities` in fewer cells, half a cell to one a hash: enough to tell sets of any size apart that share little."""
    return parities(s, max(64 * SKETCH, 1 << max(0, len(s).bit_length() - 1)))


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Parities, one row each, in a smaller table."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


class _Sketches:
    """Sketches of a task's sets, by width, so that one is compared with many at once."""

    def __init__(self, column: pa.Array):
        words = column.buffers()[2]
        held = np.frombuffer(words, np.uint8) if words else np.empty(0, np.uint8)
        starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.width = np.diff(starts) // 8
        self.place = np.zeros(len(column), np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.concatenate([held[starts[k] : starts[k + 1]] for k in at]).view(np.uint64).reshape(-1, w)

    def apart(self, one: int, others: np.ndarray) -> np.ndarray:
        """At least so many hashes are in ``one`` set only or in each of the ``others`` only."""
        out = np.zeros(len(others), np.int64)
        width = self.width[others]
        w = int(self.width[one])
        mine = self.rows[w][self.place[one]][None]
        for v in np.unique(width).tolist():
            at = np.flatnonzero(width == v)
            least = min(v, w)
            out[at] = np.bitwise_count(_folded(self.rows[v][self.place[others[at]]], least) ^ _folded(mine, least)).sum(axis=1)
        return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """``key, shingles`` of ``key, text``."""

    def make():
        return lambda batch: [batch.column(0), _lists([shingles(t, words) for t in batch.column(1).to_pylist()])]

    return map_slices(rows, "key long, shingles array<long>", make)


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample of ``text`` have, ascending, and in how many."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.sample(share, SEED).select(F.lit(0).cast("long").alias("key"), "text")
    counted = _sets(sample, words).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 2")
    found = counted.orderBy(F.desc("c"), "s").limit(FREQUENT).collect()
    s = np.array([r.s for r in found], np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.array([r.c for r in found], np.int64)[order]


def _printed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``digest, key, n, fp, sketch, fine, prefix`` of every ``digest, text``: equal sets have equal keys; ``fp`` is the SimHash of the set."""
    often, counts = _frequent(docs, words)

    def one(text: str | None):
        s = shingles(text, words)
        key = xxhash.xxh64_intdigest(s.tobytes(), SEED)
        weight = np.zeros(len(s), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            weight = np.where(often[at] == s, counts[at], 0)
        kept = len(s) + -len(s) * percent // 100 + 1 if len(s) else 0
        return key, len(s), simhash(s), sketched(s), parities(s), s[np.lexsort((s, weight))[:kept]]

    def make():
        def work(batch: pa.RecordBatch):
            if not batch.num_rows:
                return None
            key, n, fp, sketch, fine, prefix = zip(*map(one, batch.column(1).to_pylist()))
            key, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, fp))
            return [batch.column(0), key, pa.array(n, pa.int32()), fp, pa.array(sketch, pa.binary()), pa.array(fine, pa.binary()), _lists(list(prefix))]

        return work

    return map_slices(docs.select("digest", "text"), "digest binary, key long, n int, fp long, sketch binary, fine binary, prefix array<long>", make)


def _sharded(rows: DataFrame, count: int, most: int | None = None) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("s"), F.lit(max(1, -(-count // (most or SHARD_ROWS))))))


def _repeated(points: DataFrame) -> DataFrame:
    """``s, at, key`` of the prefix shingles that several sets have."""

    def search(table: pa.Table) -> pa.Table:
        _, back, count = np.unique(table.column("s").to_numpy(), return_inverse=True, return_counts=True)
        release()
        return table.select(["s", "at", "key"]).filter(pa.array(count[back] > 1))

    rows = points.select("key", F.posexplode("prefix").alias("at", "s"))
    count = points.agg(F.sum(F.size("prefix"))).first()[0] or 0
    return _sharded(rows, count).groupBy("shard").applyInArrow(search, "s long, at int, key long")


def _parted(shared: DataFrame, roots: DataFrame, count: int) -> DataFrame:
    """``s, at, key, root`` of the ``count`` rows ``s, at, key`` whose shingle is in sets of several components.

    Roots are joined to shingles, one row each, so the join grows with the shingles and not with the shards; groups
    within one component have no pair to find and take no sketch along.
    """

    def search(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        _, group = np.unique(table.column("s").to_numpy(), return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        many = np.minimum.reduceat(root[order], starts) != np.maximum.reduceat(root[order], starts)
        release()
        return table.select(["s", "at", "key", "root"]).filter(pa.array(many[group]))

    rooted = shared.select("s", "at", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return _sharded(rooted, count).groupBy("shard").applyInArrow(search, "s long, at int, key long, root long")


def _placed(shared: DataFrame, points: DataFrame, count: int, most: int | None = None) -> DataFrame:
    """``shard, key, n, sketch, root, places`` of ``s, at, key, root``: a set goes to a shard once, with all its shared shingles there, so its sketch may be long."""
    rows = _sharded(shared.join(points.select("key", "n", "sketch"), "key"), count, most)
    firsts = (F.first(c).alias(c) for c in ("n", "sketch", "root"))
    return rows.groupBy("shard", "key").agg(*firsts, F.collect_list(F.struct("s", "at")).alias("places"))


def _candidates(rows: DataFrame, percent: int, all_pairs: bool, turn: int = 0) -> DataFrame:
    """Distinct pairs ``a, b`` that share a prefix shingle and that no bound rules out, of :func:`_placed` rows.

    Each set with the first ``LEADERS`` of its group and of another root that it may be similar to, or all
    pairs of different roots. Another ``turn`` has another order within the groups.
    """

    def search(table: pa.Table) -> pa.Table:
        key, n, root = (table.column(c).to_numpy() for c in ("key", "n", "root"))
        n = n.astype(np.int64)
        sketches = _Sketches(table.column("sketch").combine_chunks())
        places = table.column("places").combine_chunks()
        of = np.repeat(np.arange(len(key)), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        s, at = (places.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("s", "at"))
        order = np.lexsort(((key.view(np.uint64) * np.uint64(TURN**turn % (1 << BITS)))[of], s))
        s, of = s[order], of[order]
        left = n[of] - at.astype(np.int64)[order]
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        out = [np.empty((0, 2), np.int64)]
        held = 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            met = np.zeros(b - a, np.int64)
            for i in range(a, b - 1):
                if not all_pairs and met[i - a] >= LEADERS:
                    continue
                mine, j = of[i], np.arange(i + 1, b)
                j = j[(root[of[j]] != root[mine]) & (all_pairs | (met[j - a] < LEADERS))]
                other = n[of[j]]
                need = -(-percent * (other + n[mine]) // (100 + percent))
                fits = (100 * np.minimum(other, n[mine]) >= percent * np.maximum(other, n[mine])) & (np.minimum(left[j], left[i]) >= need)
                j, most = j[fits], (other + n[mine] - 2 * need)[fits]
                j = j[sketches.apart(mine, of[j]) <= most]
                met[j - a] += 1
                if len(j):
                    out.append(np.stack([np.minimum(key[mine], key[of[j]]), np.maximum(key[mine], key[of[j]])], axis=1))
                    held += len(j)
            if held > 1 << 20:
                out, held = [np.unique(np.concatenate(out), axis=0)], 0
        pairs = np.unique(np.concatenate(out), axis=0)
        out = sketches = None
        release()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def _neighbours(points: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets that join those of one fingerprint, and the fingerprints that the vantage-point trees link."""
    first = points.groupBy("fp").agg(F.min("key").alias("first"))
    same = points.select("fp", "key").join(first, "fp").where("key <> first").select(F.least("key", "first").alias("a"), F.greatest("key", "first").alias("b"))
    found = links(first.select("fp"), RADIUS)
    u, v = (first.select(F.col("fp").alias(f"fp_{k}"), F.col("first").alias(f"first_{k}")) for k in "uv")
    near = found.join(u, F.col("u") == F.col("fp_u")).join(v, F.col("v") == F.col("fp_v"))
    return same.unionByName(near.select(F.least("first_u", "first_v").alias("a"), F.greatest("first_u", "first_v").alias("b")))


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` for a join: broadcast if they are few, else by shuffle; the joined rows are the same."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _closer(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """``a, b, n_a, n_b``: the pairs that the parities of all their hashes do not rule out, with the sizes of their sets; few others are left."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    fine = prints.select("key", "n", "fine").join(keys, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    a, b = (fine.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("fine").alias(f"fine_{k}")) for k in "ab")

    def make():
        def work(batch: pa.RecordBatch):
            a, b, n_a, fine_a, n_b, fine_b = (c.to_pylist() for c in batch.columns)
            total = [x + y for x, y in zip(n_a, n_b)]
            kept = [k for k, t in enumerate(total) if least_difference(fine_a[k], fine_b[k]) <= t - 2 * -(-percent * t // (100 + percent))]
            return [[c[k] for k in kept] for c in (a, b, n_a, n_b)] if kept else None

        return work

    both = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "fine_a", "n_b", "fine_b")
    return stored(map_slices(both, "a long, b long, n_a int, n_b int", make), "closer")


def _verified(pairs: DataFrame, texts: DataFrame, points: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``u, v`` (u > v) of the pairs whose sets are as similar as wanted.

    ``points`` name a text's digest for every key, so only the texts of these pairs are read again. Pairs are dealt by
    their first set, so a set travels once to each shard of its pairs; the partners of one are split where they are too
    many for a task.
    """
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = stored(points.join(keys, "key", "left_semi").select("digest", "key"), "keys")
    found = texts.join(_few(wanted), "digest").select("key", "text").groupBy("key").agg(F.first("text").alias("text"))
    total = pairs.agg(F.sum(F.col("n_a").cast("long") + F.col("n_b"))).first()[0] or 0
    tasks = max(1, -(-total // SHARD_SHINGLES))
    split = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / SHARD_SHINGLES).cast("int").alias("cut")).where("cut > 1")
    dealt = pairs.join(split, "a", "left").select("a", "b", F.pmod(F.hash("b"), F.coalesce("cut", F.lit(1))).alias("cut"))
    dealt = stored(dealt.select("a", "b", F.pmod(F.xxhash64("a", "cut"), F.lit(tasks)).alias("shard")), "dealt")
    places = dealt.select(F.col("a").alias("key"), "shard").unionByName(dealt.select(F.col("b").alias("key"), "shard")).distinct()
    placed = _sets(found, words).join(places, "key")
    return placed.groupBy("shard").cogroup(dealt.withColumnRenamed("shard", "part").groupBy("part")).applyInArrow(_compared(percent), "u long, v long")


def _compared(percent: int):
    """Of the sets of a shard, the links among its pairs."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        column = sets.column("shingles").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        keys = sets.column("key").to_pylist()
        own = {k: values[a:b] for k, a, b in zip(keys, [0, *ends.tolist()], ends.tolist())}
        found = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = own[a], own[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * 100 >= (len(x) + len(y) - both) * percent:
                found.append((max(a, b), min(a, b)))
        u, v = zip(*found) if found else ((), ())
        own = values = None
        release()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``digest, group``: one number for all texts that a chain of similar texts joins, of ``digest, text``.

    ``digest`` names a text; every different one is once in the result. Null texts count as empty.
    """
    prints = stored(_printed(docs, words, percent), "shingles")
    points = prints.groupBy("key").agg(F.min("digest").alias("digest"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    points = stored(points, "sets")
    shared = stored(_repeated(points), "shared")
    count = shared.count()
    begun = _candidates(_placed(shared.withColumn("root", F.col("key")), points, count), percent, False)
    tried = stored(begun.unionByName(_neighbours(points)).distinct(), "pairs")
    close = stored(_verified(_closer(tried, prints, percent), docs, points, words, percent), "links")
    roots = components(close).withColumnRenamed("node", "key")
    for turn, all_pairs in ((1, False), (0, True)):
        # A shingle of one component stays one of one component, so the next round goes on with what this one keeps.
        shared = stored(_parted(shared, roots, count), "shared")
        count = shared.count()
        if not count:
            break
        rest = stored(_candidates(_placed(shared, points, count, ROUND_ROWS), percent, all_pairs, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        closer = _closer(rest, prints, percent)
        tried = tried.unionByName(rest)
        # Rounds without new pairs leave the components as they are.
        if not closer.isEmpty():
            close = close.unionByName(stored(_verified(closer, docs, points, words, percent), "links"))
            roots = components(close).withColumnRenamed("node", "key")
    return prints.select("digest", "key").distinct().join(roots, "key", "left").select("digest", F.coalesce("root", "key").alias("group"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with only the row of smallest id of each group of near copies; all columns stay.

    Of repeated rows with that id one stays; a null id is last. ``docs`` is read several times and must have the same
    rows each time, in any order. Texts are read where they are: what is joined are digests, and the rows that go.
    """
    columns = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.md5(text.cast("binary")))
    row = F.unhex(F.md5(F.concat_ws("|", F.hex(digest), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("string")).cast("binary")))
    groups = near_groups(docs.select(digest.alias("digest"), text.alias("text")), words, percent)
    narrow = docs.select(digest.alias("digest"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), row.alias("row"))
    rows = narrow.groupBy("digest", "id", "hash", "row").agg(F.count("*").alias("copies")).join(groups, "digest")
    order = F.struct(F.col("id").isNull(), "id", "hash", "row")
    first = rows.groupBy("group").agg(F.min(order).alias("first"))
    judged = rows.join(first, "group").select("row", "copies", (F.col("row") == F.col("first.row")).alias("stays"))
    judged = stored(judged, "judged")
    mark = unused(docs, "row")
    given = docs.withColumn(mark, row)
    gone = judged.where("NOT stays OR copies > 1").select(F.col("row").alias(mark))
    repeated = judged.where("stays AND copies > 1").select(F.col("row").alias(mark))
    once = given.join(_few(gone), mark, "left_anti")
    again = given.join(_few(repeated), mark, "left_semi").dropDuplicates([mark])
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in columns])
