"""The pipeline's near-duplicate stage against all pairs, on planted copies."""

import random

import pytest

import corpus_pipeline
from spanweave.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts with copies of similarity 0.8 to 0.95, copies below it, a chain, a line that all share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        texts.append(" ".join(base))
        for wanted in (0.95, 0.9, 0.85, 0.8, 0.7):
            copy = list(base)
            while True:
                less = list(copy)
                less[rng.randrange(len(less))] = word()
                if jaccard(grams(" ".join(base)), grams(" ".join(less))) < wanted:
                    break
                copy = less
            texts.append(" ".join(copy))
    step = [word() for _ in range(100)]
    for i in range(5):
        step = [*step[8:], *[word() for _ in range(8)]]
        texts.append(" ".join(step))
    line = " ".join(word() for _ in range(12))
    texts += [f"{line} {' '.join(word() for _ in range(40))}" for _ in range(30)]
    base = [word() for _ in range(9)]
    texts += [" ".join(base), " ".join(base[:8]), texts[0].upper(), "", None, " \n", "one two", "one  Two", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def wanted(rows):
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted({g for g in group})


@pytest.mark.parametrize("most", [near_copies.SHARD_SHINGLES, 300])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, most):
    """With all candidates in shards, and with the larger ones met pair by pair."""
    monkeypatch.setattr(near_copies, "SHARD_SHINGLES", most)
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", near_copies.BROADCAST_ROWS if most > 300 else 0)
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == wanted(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "A b c d e f"), (7, "a b c d e f"), (None, "x y"), (None, "x y"), (3, "z")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert sorted(((r.doc_id, r.text.lower()) for r in near_copies.keep_first(docs).collect()), key=repr) == [(3, "z"), (7, "a b c d e f"), (None, "x y")]
    assert near_copies.keep_first(docs.limit(0)).collect() == []


def test_parities_bound_the_difference():
    """Never more than the hashes that two sets do not share, whatever their sizes, and close to it."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n, m in ((0, 0), (0, 5), (10, 3000), (400, 400), (1000, 1300)):
        for shared in (0, min(n, m) // 2, min(n, m)):
            pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
            apart = len(np.setxor1d(x, y))
            least = near_copies.least_difference(near_copies.parities(x), near_copies.parities(y))
            assert least <= apart and (min(n, m) < 400 or least > 0.6 * apart - 10)


def test_pairs_of_a_large_group_follow_its_size(spark, monkeypatch):
    """Copies that are similar to their source but hardly to one another: few of their pairs are looked at."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(200):
        copy = list(base)
        for at in rng.sample(range(10, 140), 2):
            copy[at] = word()
        texts.append(" ".join(copy))
    seen, closer = [], near_copies._closer
    monkeypatch.setattr(near_copies, "_closer", lambda pairs, *rest: seen.append(pairs.count()) or closer(pairs, *rest))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert [r.doc_id for r in near_copies.keep_first(docs).collect()] == wanted(list(enumerate(texts))) == [0]
    assert sum(seen) < 10 * len(texts)


def test_rounds_go_on_with_shingles_of_several_components(spark, monkeypatch):
    """Once a group of copies is one component, no later round joins or places its shingles again."""
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(120)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(10, 110, 5)]
    seen, candidates = [], near_copies._candidates
    monkeypatch.setattr(near_copies, "_candidates", lambda rows, *rest: seen.append(rows.count()) or candidates(rows, *rest))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert [r.doc_id for r in near_copies.keep_first(docs).collect()] == [0]
    assert seen[0] >= len(texts) and sum(seen[1:]) == 0


def test_sketches_bound_the_difference():
    """One set against many of other widths: never more than the hashes that two sets do not share."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = [np.unique(pool[a:b]) for a, b in ((0, 0), (0, 50), (40, 90), (0, 3000), (10, 3000), (5, 2000), (0, 9000), (5000, 8000))]
    found = near_copies._Sketches(pa.array([near_copies.sketched(x) for x in sets], pa.binary()))
    for i, x in enumerate(sets):
        least = found.apart(i, np.arange(len(sets)))
        assert all(d <= len(np.setxor1d(x, y)) for d, y in zip(least.tolist(), sets)) and least[i] == 0
    assert found.apart(3, np.array([7])) > 6000 // 9
