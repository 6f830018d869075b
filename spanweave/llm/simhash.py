"""SimHash fingerprints, exact Hamming links through vantage-point trees, and their components.

Two fingerprints within ``radius`` bits are within ``bound = radius // projections`` bits on at least one of
``projections`` disjoint bit ranges. Each range is a metric space with a vantage-point tree of its own: the vantage
points are fingerprints of the data, and each level splits its points by their Hamming distance to that level's
vantage point. A branch whose points have distance c to the vantage point can hold a partner of a query at distance
d only if ``|d - c| <= bound``; and since the parity of a Hamming distance is the sum of the parities to any third
point, all levels' differences are even together or odd together.

The first levels make the shards: a point is indexed in its home shard, and as a query goes to its home and to the
neighbouring shards that its ball overlaps by these bounds, and to no other. The levels below are walked inside a
shard by both sides at once: two branches stay together while the bound holds, and are dropped with all they hold
where it fails. What remains at the leaves is compared in all 64 bits, so no link is lost and none is wrong.

Scale: equal fingerprints collapse before the search, so a third of the corpus in one group of copies is one point.
Levels and ranges follow the number of points. A shard with more comparisons than one task should make is split by
its queries. Links leave a shard as a spanning forest, never as all pairs. Only the vantage points are collected.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, picked, release, stored, struct_of, unused

SEED = 42
BITS = 64
#: Levels of each tree.
LEVELS = 16
PAIRS_AT_ONCE = 1 << 21
#: Pairs of points below which two branches are compared rather than walked on.
LEAF_PAIRS = 64
#: Rows that one task searches; homes times queries of a shard beyond which its queries are split.
SHARD_ROWS, SHARD_PAIRS = 400_000, 1 << 32
#: Fingerprints of more than one in so many documents are joined by broadcast; there are fewer than so many of them.
HOT = 1_000
#: Points from which two longer ranges leave fewer candidates than three; points for each shard of two, three, ... levels.
MANY_POINTS, SHARD_POINTS = 20_000_000, 200_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of one text, unsigned; a text without words has 0."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    size = max(1, len(tokens) - words + 1)
    ends = list(accumulate(map(len, tokens)))
    spans = range(size)
    if len(tokens) < words:
        pieces: Iterable[bytes] = [whole]
    else:
        pieces = (whole[(ends[i - 1] + i if i else 0) : ends[i + words - 1] + i + words - 1] for i in spans)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, size)
    return simhash(hashes)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", words: int = 4) -> DataFrame:
    """``docs`` with all its columns and the fingerprint, a signed long, as column ``name``."""
    at = docs.columns.index(text_col)

    def make():
        def work(batch: pa.RecordBatch):
            values = np.fromiter((fingerprint(t, words) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            return [*batch.columns, pa.array(values.view(np.int64))]

        return work

    return map_slices(docs, struct_of(docs, f"`{name}` long"), make)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row; a null text counts as empty."""
    return with_fingerprint(picked(docs, doc_id=id_col, text=text_col), "fp", "text", words).select("doc_id", "fp")


def _ranges(projections: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // projections for i in range(projections + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    """64 bits as a long."""
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _vantages(points: DataFrame) -> list[int]:
    """Vantage points of all levels: the fingerprints of least hash, and a fixed spread where there are too few."""
    golden = 0x9E3779B97F4A7C15
    found = [r.fp % (1 << BITS) for r in points.orderBy(F.xxhash64("fp"), "fp").limit(LEVELS).collect()]
    return found + [golden * (level + 1) % (1 << BITS) for level in range(len(found), LEVELS)]


def _neighbours(levels: int, bound: int) -> list[tuple[int, ...]]:
    """Differences of distances on all levels that points within ``bound`` bits may have: all even or all odd."""
    steps = [[d for d in range(-bound, bound + 1) if d % 2 == parity] for parity in (0, 1)]
    return [deltas for s in steps if s for deltas in product(s, repeat=levels)]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs into ``label``, which points every point at the smallest of its group."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop


def _ranged(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of numbers, the run and the number of each element."""
    which = np.repeat(np.arange(len(low)), count)
    first = np.cumsum(count) - count
    return which, low[which] + np.arange(len(which)) - first[which]


def _walk(branches: list[tuple[np.ndarray, np.ndarray]], keys: list[np.ndarray], bound: int):
    """Pairs of leaves that no level's bound parts, as ranges of both sides: query from, to, home from, to.

    ``branches`` are the two sides' edges of every level's branches, level 0 being the shard; ``keys`` the same edges'
    distances. Pairs wait on a stack in blocks, so few are held at once.
    """
    (q0, h0), depth = branches[0], len(branches)
    _, q_at, h_at = np.intersect1d(keys[0][0], keys[0][1], return_indices=True)
    stack = [(0, np.stack([q0[q_at], q0[q_at + 1], h0[h_at], h0[h_at + 1]]))] if len(q_at) else []
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > PAIRS_AT_ONCE >> 8:
            half = pairs.shape[1] // 2
            stack += [(level, pairs[:, :half]), (level, pairs[:, half:])]
            continue
        small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAF_PAIRS
        if level + 1 == depth:
            small[:] = True
        if small.any():
            yield pairs[:, small]
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        (q_edges, h_edges), (q_keys, h_keys) = branches[level + 1], keys[level + 1]
        qa, qb = (np.searchsorted(q_edges, x) for x in pairs[:2])
        ha, hb = (np.searchsorted(h_edges, x) for x in pairs[2:])
        which, child = _ranged(qa, qb - qa)
        both, other = _ranged(ha[which], (hb - ha)[which])
        near = np.abs(q_keys[child[both]] - h_keys[other]) <= bound
        mine, other = child[both][near], other[near]
        if len(mine):
            stack.append((level + 1, np.stack([q_edges[mine], q_edges[mine + 1], h_edges[other], h_edges[other + 1]])))


def _edges(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of sorted rows, where the branches of each level begin (and the end), and their keys."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    edges, keys = [], []
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        edges.append(np.append(at, n))
        keys.append(c[at])
    return edges, keys


def _forest(shard: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int, bound: int, trees: list[tuple[int, int, list[int]]]):
    """Spanning links among the fingerprints of some shards. ``part`` names a shard's tree; ``trees`` have shift, bits, vantages below the shards."""
    points, number = np.unique(fp, return_inverse=True)
    label = np.arange(len(points))
    for tree in np.unique(part).tolist():
        shift, bits, vantages = trees[tree]
        sides, order = [], []
        for side in (~home, home):
            at = np.flatnonzero((part == tree) & side)
            value = (fp[at] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            columns = [shard[at], *(np.bitwise_count(value ^ np.uint64(v)).astype(np.int64) for v in vantages)]
            rank = np.lexsort(columns[::-1])
            sides.append(_edges([c[rank] for c in columns]))
            order.append(number[at[rank]])
        branches = list(zip(sides[0][0], sides[1][0]))
        keys = list(zip(sides[0][1], sides[1][1]))
        if not len(order[0]) or not len(order[1]):
            continue
        for pairs in _walk(branches, keys, bound):
            for a, b in _compared(pairs):
                a, b = order[0][a], order[1][b]
                keep = label[a] != label[b]
                a, b = a[keep], b[keep]
                near = np.bitwise_count(points[a] ^ points[b]) <= radius
                if near.any():
                    label = _merge(label, a[near], b[near])
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _compared(pairs: np.ndarray):
    """Rows of both sides for all pairs of leaves, a bounded number at once."""
    qa, qb, ha, hb = pairs
    which, query = _ranged(qa, qb - qa)
    low, count = ha[which], (hb - ha)[which]
    total = np.cumsum(count)
    at = 0
    while at < len(query):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        some = slice(at, upto)
        if upto == at + 1 and count[at] > PAIRS_AT_ONCE:
            for k in range(0, int(count[at]), PAIRS_AT_ONCE):
                homes = low[at] + np.arange(k, min(k + PAIRS_AT_ONCE, int(count[at])))
                yield np.full(len(homes), query[at]), homes
        else:
            row, homes = _ranged(low[some], count[some])
            yield query[some][row], homes
        at = upto


def links(points: DataFrame, radius: int = 4, projections: int | None = None) -> DataFrame:
    """Spanning links ``u, v`` (u > v) between the distinct longs ``fp`` of ``points`` at most ``radius`` bits apart.

    Any two fingerprints that close are joined by a path of links; an empty table has none. ``projections`` is chosen
    by the number of points: more ranges have a smaller bound, longer ones fewer points by chance.
    """
    total = points.count()
    projections = projections or (3 if total < MANY_POINTS else 2)
    bound = radius // projections
    levels = 2
    while total > SHARD_POINTS * 80 * 9 ** (levels - 2) and levels < 6:
        levels += 1
    vantages = _vantages(points)
    trees, rows = [], None
    steps = _neighbours(levels, bound)
    deltas = F.array(*(F.array(*map(F.lit, d)) for d in sorted(steps, key=any)))
    for number, (shift, bits) in enumerate(_ranges(projections)):
        own = [v >> shift & ((1 << bits) - 1) for v in vantages]
        trees.append((shift, bits, own[levels:]))
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
        distance = F.array(*(F.bit_count(value.bitwiseXOR(F.lit(_signed(v)).cast("long"))) for v in own[:levels]))
        # Row 0 is the point at home; the others are the query's shards, its own among them.
        placed = points.select("fp", distance.alias("d")).select("fp", "d", F.posexplode(F.concat(F.array(deltas[0]), deltas)).alias("row", "by"))
        code = F.lit(number)
        for level in range(levels):
            code = code * (2 * BITS) + F.col("d")[level] + F.col("by")[level] + bound
        placed = placed.select("fp", (F.col("row") == 0).alias("home"), F.lit(number).alias("tree"), code.cast("long").alias("shard"))
        rows = placed if rows is None else rows.unionByName(placed)
    sizes = rows.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("asks"))
    split = sizes.where(F.col("homes") > 0).withColumn("cut", F.ceil(F.col("homes").cast("double") * F.col("asks") / SHARD_PAIRS).cast("int")).where("cut > 1").select("shard", "cut")
    # Such shards have over 2**14 homes each, so they are fewer than one for 5,000 points.
    rows = rows.join(F.broadcast(split), "shard", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    rows = rows.select("fp", "home", "tree", "shard", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("cut") - 1)).otherwise(F.array(mine))).alias("cut"))
    tasks = max(1, -(-total * projections * (len(steps) + 1) // SHARD_ROWS))

    def search(table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_numpy()
        part, cut = table.column("tree").to_numpy(), table.column("cut").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy().astype(bool)
        place = np.unique(np.stack([shard, cut.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        u, v = _forest(place, part, fp, home, radius, bound, trees)
        u, v = u.view(np.int64), v.view(np.int64)
        release()
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    dealt = rows.withColumn("task", F.pmod(F.xxhash64("shard", "cut"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(search, "u long, v long")


#: Links that one task merges at once before they are shuffled.
MERGED_AT_ONCE = 1 << 20


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer links: each task's blocks of links become stars around their least nodes."""
    schema = pa.schema({"u": pa.int64(), "v": pa.int64()})

    def stars(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate([*u, *v]), return_inverse=True)
        half = len(place) // 2
        label = _merge(np.arange(len(nodes)), place[:half], place[half:])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], schema=schema)

    def run(batches):
        u, v, held = [], [], 0
        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= MERGED_AT_ONCE:
                yield stars(u, v)
                u, v, held = [], [], 0
        if held:
            yield stars(u, v)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (longs u > v): root is the least node that links reach.

    Large-star and small-star passes until nothing moves, each written to the shared folder. Before each, every task
    merges the links that it holds, so few passes are left. Only the linked nodes take part.
    """

    def kept(links: DataFrame):
        held = stored(_contracted(links).distinct(), "links")
        return held, held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges, state = kept(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small, "u")
        moved = pairs.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges, now = kept(moved.where("u > v"))
        if now == state:
            break
        state = now
    found = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, projections: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the smallest doc_id that links reach, and ``root_fp``.

    Null texts count as empty (fingerprint 0, linked like any other); null doc_ids are carried but never
    name a component unless no other id is there; repeated rows stay repeated; extra columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = stored(components(links(points.select("fp"), radius, projections)), "roots")
    linked = points.join(roots, points.fp == roots.node).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select(F.col("fp").alias("node"), "least", "root")
    known = points.join(named, points.fp == named.node, "left").select(
        F.col("fp").alias("point"), "n",
        F.coalesce("least", "first").alias("component_id"),
        F.coalesce("root", "fp").alias("root_fp"),
    )
    known = stored(known, "components")
    limit = prints.count() // HOT
    hot = F.broadcast(known.where(F.col("n") > limit))
    often = prints.join(hot, prints.fp == hot.point)
    rest = prints.join(hot.select("point"), prints.fp == hot.point, "left_anti").join(known.where(F.col("n") <= limit), F.col("fp") == F.col("point"))
    return often.unionByName(rest).select("doc_id", "fp", "component_id", "root_fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with only the document of smallest id of each component; all columns stay.

    Of repeated rows with that id one stays. A component whose ids are all null keeps one of its rows.
    """
    groups = stored(simhash_components(docs, id_col, text_col, **how), "groups")
    rank, root = unused(docs, "rank"), unused(docs, "root")
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(root)).distinct()
    same = F.col(id_col) == F.col(root)
    order = [F.xxhash64(text_col), F.col(text_col)]
    named = docs.where(F.col(id_col).isNotNull()).join(kept, same, "left_semi")
    named = named.withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    alone = groups.where("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias(rank), F.col("root_fp").alias(root)).distinct()
    nameless = with_fingerprint(docs.where(F.col(id_col).isNull()), rank, text_col, how.get("words", 4)).join(alone, rank)
    nameless = nameless.withColumn(rank, F.row_number().over(Window.partitionBy(root).orderBy(*order)))
    return named.unionByName(nameless.select(*named.columns)).where(f"{rank} = 1").select(*docs.columns)
