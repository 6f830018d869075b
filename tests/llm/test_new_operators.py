"""Personal data, importance resampling and whitening against brute force, and their defined results on odd tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spanweave.llm import personal, resample, unigram, whitening
from spanweave.llm.queries import QUERIES

EXTRA = "score long, rank int, part int, `out` string, copy string, found string, v string, n int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
NOTHING = (None,) * 8


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), *NOTHING) for i, t in rows], DOCS).repartition(3)


def texts():
    rng = random.Random(5)
    words = "the and Of stone river ÉCOLE straße 12 x9 a_b it's o’clock über 日本".split()
    out = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    out += [out[0], out[0], None, None, "", " \n\t", "one", "a-b/c", "x" * 5000, "ab " * 4000, "mail me at a.b+c@d-e.co.uk, +1 (017) 555-7713 or 10.0.0.255!", "4111 1111-1111 1111"]
    return list(enumerate(out)) + [(3, out[3]), (None, out[5]), (None, None)]


# -- personal data -----------------------------------------------------------------------------------------------


def plain_base(text):
    """The contract's patterns as they stand."""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], personal.BASE.index(s[2])))


ODD = ["a@b", "@b.c", "a@b.c@d.e", "a@b.co-x%y@e.fg", "x..@-.-", "a@b..c", "é@b.c a@b.é", "1.2.3", "1.2.3.4.5.6.7.8", "001.2.3.4", "256.1.1.1", "1.1.1.1111", "١.2.3.4", "+1 23456789", "+1(", "+12", "++49 30 1234567-", "+49.30.1234567)x", "4111111111111111", "4111-1111 1111  1111", "0000000000000", "5 4111111111111111", "1" * 5000, "9." * 3000, "a" * 5000 + "@", "a@" * 3000, "+1 " * 2000, "1-" * 3000]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices("ab1234567890.@+-() _%é", k=rng.randint(0, 60))) for _ in range(1500)] + ODD
    for text in made:
        assert personal.base_spans(text) == plain_base(text), text


def test_base_spans_take_linear_time():
    import time

    began = time.time()
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "a" * 400_000):
        personal.base_spans(text)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def field(spark):
    return personal.trained(personal.labelled_table(spark))


def test_best_paths(field):
    """Paths between sure tokens are those of plain Viterbi over all tokens."""
    lines = [t for t, _ in personal.labelled_lines(77, 300)]
    for text in [*lines, " ".join(lines[:40]), "", "A", "A A A A", *(t or "" for _, t in texts())]:
        numbers = np.array([0] * personal.BEFORE + field.numbers(text) + [0] * personal.BEFORE)
        scores = field.scores(numbers).T.astype(float)
        best, back = scores[0] + field.moves[0], []
        for row in scores[1:]:
            ways = best[:, None] + field.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tags = [int((best + field.moves[:, 0]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        mine = field.paths(numbers).tolist()
        assert mine == tags[::-1]
        assert all(t % 2 or t == 0 or mine[k - 1] in (t, t - 1) for k, t in enumerate(mine))


def test_gradient():
    """After fitting, the likelihood of the lines learnt from is high: all spans of the smallest table are found again."""
    lines = personal.labelled_lines(5, 60, ("call {phone} .", "my name is {person} .", "{prose}"))
    field = personal.fitted(tuple((t, tuple(s)) for t, s in lines), rounds=60)
    assert field.spans([t for t, _ in lines]) == [s for _, s in lines]


def test_field_on_frames_it_never_saw(field):
    frames = (
        "Hello , my name is {person} from {Title} .", "Please call me on {phone} after {number} .", "Mrs {person} {prose}", "Tel : {phone} , Fax : {phone}", "the license number is {identity} .",
        "We live at {address} .", "{prose} . Our address is {address} .", "my mobile number : {phone}", "passport {identity} , {prose}", "Frau {person} wohnt {prose}",
    ) + ("{prose} {prose}", "{prose} {plain} {prose}", "{Title} {prose} {long}", "{prose} {isbn}", "{many} {prose}")
    lines = personal.labelled_lines(123, 1500, frames)
    found = field.spans([t for t, _ in lines])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, lines))
    assert right / sum(map(len, found)) >= 0.9
    assert right / sum(len(b) for _, b in lines) >= 0.85


def test_scan(spark):
    rows = texts()
    got = sorted((tuple(r) for r in personal.scan(documents(spark, rows)).drop("found").collect()), key=repr)
    field = personal.trained(personal.labelled_table(spark))
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        more = [s for s in field.spans([t or ""])[0] if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        spans = sorted(base + more, key=lambda s: (s[0], personal.KINDS.index(s[2])))
        told = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in x)
        want.append((i, *(sum(s[2] == k for s in spans) for k in personal.KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
    assert got == sorted(want, key=repr)
    assert sum(r[1] for r in got) == 1 and sum(r[2] for r in got) == 1 and sum(r[3] for r in got) == 1 and sum(r[4] for r in got) == 1


def test_masked(spark):
    rows = [(1, "my name is Anna Keller , mail a@b.co or +1 (017) 555-7713"), (2, None), (3, ""), (4, "plain words")]
    out = {r.doc_id: (r.text, r.n_chars) for r in personal.masked(documents(spark, rows), length_col="n_chars").collect()}
    assert out[1][0] == "my name is [PERSON] , mail [EMAIL] or [PHONE]" and out[1][1] == len(out[1][0])
    assert out[2] == (None, None) and out[3] == ("", 0) and out[4] == ("plain words", 11)
    kinds = {r.kind: (r.n_docs, r.n_spans) for r in personal.counts_by_kind(personal.scan(documents(spark, rows))).collect()}
    assert kinds == {"person": (1, 1), "email": (1, 1), "phone": (1, 1)}


def test_personal_empty(spark):
    assert personal.scan(documents(spark, [])).collect() == []
    assert personal.masked(documents(spark, [])).collect() == []


# -- resampling --------------------------------------------------------------------------------------------------


def plain_features(text, longest, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_importance(rows, target, percent, least, longest=3, buckets=10_000):
    docs = [(i, *plain_features(t, longest, buckets)) for i, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, found in docs:
        np.add.at(s, found, 1)
    for text in target:
        np.add.at(t, plain_features(text, longest, buckets)[1], 1)
    big_s, big_t = s.sum() + buckets, t.sum() + buckets
    gain = [math.floor(1000 * math.log((b + 1) * big_s / ((a + 1) * big_t))) for a, b in zip(s, t)]
    out = []
    for i, n, found in docs:
        weight = sum(gain[k] for k in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = percent * len(fit) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("block, percent, longest", [(1 << 20, 30, 3), (7, 50, 2), (64, 100, 4)])
def test_importance(spark, monkeypatch, block, percent, longest):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "PART_ROWS", 9)
    rows, target = texts(), ["stone river and the river", None, "", "x9 x9"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    found = resample.importance(documents(spark, rows), wanted, percent=percent, longest=longest).drop("copy")
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_importance(rows, target, percent, 20, longest)


def test_resampled(spark):
    rows = [(i, f"{'stone river' if i < 10 else 'other words'} " * 12) for i in range(40)]
    docs = documents(spark, rows)
    drawn = resample.resampled(docs, spark.createDataFrame([("stone river stone river",)], "text string"), percent=25)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == list(range(10))


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.importance(documents(spark, []), none).collect() == []
    assert {r.rank for r in resample.importance(documents(spark, [(1, "a b"), (2, None)]), none).collect()} == {None}


def test_long_text_of_one_word():
    assert [n for n, _ in resample.scanned(b"A" * (3 << 20))] == [1]
    assert sum(len(f) for _, f in resample.scanned(("é " * 2_000_000).encode())) == 3 * 2_000_000 - 3


# -- whitening ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component string, v int, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, None, None, None) for i, e in rows], VECTORS).repartition(3)


def plain_whole(rows):
    keep = [(i, e) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    return [i for i, _ in keep], [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for _, e in keep]


@pytest.mark.parametrize("width, spread", [(5, 1.0), (40, 3.0), (6, 1e6)])
def test_whitening(spark, width, spread):
    rng = np.random.default_rng(width)
    made = [(k, (rng.normal(size=width) * (spread if k % 2 else 1)).astype(np.float32).tolist()) for k in range(150)]
    made += [(3, made[3][1]), (None, made[4][1]), (900, None), (901, [None] * width), (902, [math.nan] * width), (903, [math.inf] + [0.0] * (width - 1)), (904, []), (905, [1.0] * (width + 1))]
    rows = [tuple(r) for r in whitening.whiten(vectors(spark, made)).collect()]
    ids, x = plain_whole([r for r in made if r[0] != 905])
    n, count = len(x), min(width, 32)
    sums = [sum(c) for c in zip(*x)]

    def long(row):
        found = sum(c * c for c in row)
        return found if found < 1 << 63 else None

    centred = [[n * c - s for c, s in zip(row, sums)] for row in x]
    assert len(rows) == n * count and all(r[2] == n for r in rows)
    assert sorted({(r[0], r[3]) for r in rows}, key=repr) == sorted({(i, long(row)) for i, row in zip(ids, centred)}, key=repr)
    exact = [[float(Fraction(sum(a * b for a, b in zip(p, q)), n**3)) for q in zip(*centred)] for p in zip(*centred)]
    values, directions = np.linalg.eigh(np.array(exact))
    values, directions = values[::-1], directions[:, ::-1]
    for k in range(1, count + 1):
        mine = np.array([r[4] for r in sorted((r for r in rows if r[1] == k), key=repr)])
        want = (np.array(centred, float) / n) @ directions[:, k - 1] / math.sqrt(values[k - 1])
        want = np.array([w for _, w in sorted(zip([(i, k, n, long(row)) for i, row in zip(ids, centred)], want), key=lambda p: repr(p[0]))])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-6
        assert all(r[5] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9) for r in rows if r[1] == k)
    assert {r[6] < 1e-9 for r in rows} == {True}


def test_exact_products():
    rng = np.random.default_rng(0)
    for far in (10, 1 << 30, 1 << 61):
        x = rng.integers(-far, far, (300, 4))
        o = x.astype(object)
        assert (whitening.cross(x) == o.T @ o).all()


def test_far_apart_components():
    """A direction 1e9 times as wide as the others costs them nothing: their covariance is the identity still."""
    rng = np.random.default_rng(2)
    x = rng.integers(-90, 90, (400, 7)).astype(object)
    x[:, 2] *= 10**9
    x[:, 5] = x[:, 1] + x[:, 2]
    s = x.sum(axis=0)
    model = whitening.decomposed(400, 0, list(s), 400 * (x.T @ x) - np.outer(s, s))
    assert np.count_nonzero(model.values) == 6 and model.values[6] == 0
    assert model.error < 1e-6


def test_directions_without_spread(spark):
    rows = [(k, [float(k), 2.0, float(k)]) for k in range(10)]
    got = [tuple(r) for r in whitening.whiten(vectors(spark, rows)).collect()]
    assert {r[4] is None for r in got if r[1] > 1} == {True} and {r[5] for r in got if r[1] > 1} == {0.0}
    assert {round(r[5], 12) for r in got if r[1] == 1} == {1.0}
    same = [tuple(r) for r in whitening.whiten(vectors(spark, rows[:1] * 3)).collect()]
    assert {(r[3], r[4], r[5], r[6]) for r in same} == {(0, None, None, 0.0)} and len(same) == 9


def test_deviation_beyond_a_long(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [0.0, 2.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got[0] is None and got[1] is None


def test_whitening_empty(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# -- unigram counts of long words --------------------------------------------------------------------------------


def test_long_pre_tokens(monkeypatch):
    rng = random.Random(9)
    pieces = {bytes([b]): -math.log(b + 2) for b in range(256)} | {w: -math.log(k + 258) for k, w in enumerate([b"th", b"the", b" the", b"st", b"stone", b"one", b"ones", b"aa", b"aaaa", b"aaaaaaa"])}
    ends, longest = unigram.tails(pieces), max(map(len, pieces))

    def plain(word):
        ways = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways.append(max((ways[b][0] + pieces[word[b:end]], ways[b][1] - 1) for b in range(max(0, end - longest), end) if word[b:end] in pieces))
        return -ways[-1][1]

    words = ["".join(rng.choices(["the", "stones", "a", "one ", "x", "é"], k=rng.randint(0, 25))).encode() for _ in range(200)]
    for depth in (1, 5, 16, 256):
        monkeypatch.setattr(unigram.Trie, "DEPTH", depth)
        trie = unigram.Trie(ends, longest)
        assert [trie.insert(w) for w in words] == [plain(w) for w in words]
        assert len(trie.best) <= 1 + sum(min(len(w), depth) for w in words)


def test_a_megabyte_without_a_cut():
    import time

    pieces = {bytes([b]): -1.0 for b in range(256)} | {b"ab": -1.5, b"abab": -2.0}
    began = time.time()
    trie = unigram.Trie(unigram.tails(pieces), 4)
    assert trie.insert(b"ab" * 500_000) == 250_000 and len(trie.best) == 257
    assert time.time() - began < 15


def test_vocabulary_without_all_bytes(spark, tmp_path):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="255 are missing"):
        unigram.token_counts(documents(spark, [(1, "a")]), str(tmp_path / "v"), r"\S+")


def test_queries_cover_their_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op11_personal", "op12_resampling"):
        assert QUERIES[name](spark, sf_dir).count() == docs
    assert QUERIES["op13_whitening"](spark, sf_dir).count() == 32 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
