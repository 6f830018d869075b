"""Interval joins by bins and the block-based greedy choice against nested loops, and their time on one long document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanweave.operators import intervals as I
from spanweave.operators import scoring as C
from spanweave.operators import spans as S

DDL = "doc_id int, start int, end int, label string"


def rows(seed, n, far, longest):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randint(0, far)
        out.append((rng.choice([1, 1, 1, 2, 3]), start, start + rng.choice([0, 1, rng.randint(0, longest)]), rng.choice("AB")))
    return out + out[:5] + [(None, 1, 9, "A"), (1, None, 4, "A"), (1, 2, None, "B")]


def over(a, b):
    return None not in (*a[:3], *b[:3]) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("width", [1, 7, 64, 1024])
def test_all_pairs(spark, width):
    left, right = rows(1, 120, 300, 40), rows(2, 150, 300, 90)
    found = I.overlapping(spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL), width=width).collect()
    got = sorted(((r.doc_id, *r.left), (r.doc_id, *r.right)) for r in found)
    assert got == sorted((a, b) for a in left for b in right if over(a, b))


@pytest.mark.parametrize("width", [3, 1024])
def test_rows_with_and_without(spark, width):
    left, right = rows(3, 80, 400, 20), rows(4, 40, 400, 20)
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    has = [x for x in left if any(over(x, y) for y in right)]
    assert sorted(map(tuple, I.with_overlap(a, b, width=width).select("doc_id", "start", "end", "label").collect()), key=repr) == sorted(has, key=repr)
    assert sorted(map(tuple, I.without_overlap(a, b, width=width).select("doc_id", "start", "end", "label").collect()), key=repr) == sorted((x for x in left if not any(over(x, y) for y in right)), key=repr)


def test_best_and_first(spark):
    """Long gold spans stand in many bins; what overlaps in a later bin only is found, too."""
    rng = random.Random(8)
    gold = [(1, k * 4000, k * 4000 + rng.randint(1, 3900), "A") for k in range(20)]
    pred = [(1, s, s + rng.randint(1, 60), str(k)) for k, s in enumerate(rng.randint(0, 80_000) for _ in range(60))]
    g, p = spark.createDataFrame(gold, DDL), spark.createDataFrame(pred, DDL)
    first = {r.start: r.pred_label for r in C.first_overlap(g, p).collect()}
    best = {r.start: r.pred_label for r in C.best_overlap(g, p).collect()}
    for x in gold:
        mine = [y for y in pred if over(x, y)]
        assert first[x[1]] == (min(mine, key=lambda y: (y[1], y[2]))[3] if mine else None)
        assert best[x[1]] == (max(mine, key=lambda y: (min(x[2], y[2]) - max(x[1], y[1]), -y[1], -y[2]))[3] if mine else None)


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], DDL), spark.createDataFrame([(1, 0, 5, "A")], DDL)
    assert I.overlapping(none, some).collect() == I.overlapping(some, none).collect() == []
    assert I.with_overlap(some, none).collect() == [] and I.without_overlap(some, none).count() == 1


def test_one_document_of_many_spans(spark):
    n = 100_000
    made = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 15).cast("int").alias("end"), F.lit("A").alias("label"))
    made.count()
    began = time.time()
    assert I.overlapping(made, made).count() == 3 * n - 2
    assert time.time() - began < 10


def plain_greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[2], s[0], s[1])):
        if not any(o[0] < s[1] and s[0] < o[1] for o in kept):
            kept.append(s)
    return kept


KIND = "array<struct<start:int,end:int,label:string,score:double>>"


def test_greedy(spark):
    rng = random.Random(5)
    many = []
    for far, longest in ((10, 4), (200, 30), (5000, 900), (300, 300)):
        many.append([(s, s + rng.choice([0, rng.randint(1, longest)]), rng.choice("AB"), rng.randint(0, 9) / 8) for s in (rng.randint(0, far) for _ in range(120))])
    many += [[], [(0, 0, "A", 1.0)], [(0, 5, "A", 0.5)] * 3]
    found = spark.createDataFrame(list(enumerate(many)), f"id int, s {KIND}").select("id", S.greedy(F.col("s")).alias("k")).collect()
    for r in found:
        assert [tuple(k) for k in r.k] == plain_greedy(many[r.id])


def test_greedy_takes_many_spans(spark):
    rng = random.Random(6)
    spans = [(s, s + rng.randint(1, 12), "A", rng.random()) for s in (rng.randint(0, 1_000_000) for _ in range(100_000))]
    df = spark.createDataFrame([(spans,)], f"s {KIND}")
    df.count()
    began = time.time()
    kept = df.select(F.explode(S.greedy(F.col("s"))).alias("k")).select("k.*").collect()
    assert time.time() - began < 5
    ordered = sorted((k.start, k.end) for k in kept)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])) and len(kept) > 40_000


def plain_tags(toks, spans):
    out, before = [], None
    for a, b in toks:
        hit = next((s for s in sorted(spans) if s[0] < b and a < s[1]), None)
        out.append("O" if hit is None or hit[2] == "O" else None if hit[2] == "IGNORE" else ("I-" if hit == before else "B-") + hit[2])
        before = hit
    return out


def test_tags_of_many_tokens(spark):
    """Stretches of tokens see the spans over them only; long, nested and empty spans, and spans over the edges of stretches."""
    rng = random.Random(12)
    cases = []
    for n, many, longest in ((0, 3, 5), (1, 0, 5), (63, 9, 200), (64, 9, 20), (65, 40, 400), (300, 30, 900), (300, 200, 6)):
        toks, at = [], 0
        for _ in range(n):
            at += rng.randint(0, 2)
            toks.append((at, at + rng.randint(1, 4)))
            at = toks[-1][1]
        spans = [(s, s + rng.choice([0, 1, rng.randint(1, longest)]), rng.choice(["X", "Y", "O", "IGNORE"])) for s in (rng.randint(0, at + 5) for _ in range(many))]
        cases.append((toks, spans))
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t array<struct<start:int,end:int>>, s array<struct<start:int,end:int,label:string>>")
    got = {r.k: r.tags for r in df.select("k", S.bio_tags(F.col("t"), F.col("s")).alias("tags")).collect()}
    assert got == {k: plain_tags(t, s) for k, (t, s) in enumerate(cases)}


def test_tags_take_linear_time(spark):
    def took(n):
        toks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end")))
        spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end"), F.lit("X").alias("label")))
        began = time.time()
        assert spark.range(1).select(F.size(S.bio_tags(toks, spans)).alias("n")).first().n == n
        return time.time() - began

    took(100)
    assert took(20_000) < 8
