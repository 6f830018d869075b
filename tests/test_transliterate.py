"""The longest-match transducer, its map of positions and Hangul against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from spanweave.operators import transliterate as T
from spanweave.plans.all_queries import QUERIES
from spanweave.plans.predict_queries import _WORDS, LETTERS, WORD_LETTERS


def plain(table, text):
    out, at = [], 0
    while at < len(text):
        key = max((k for k in table if text.startswith(k, at)), key=len, default=None)
        out.append(table[key] if key else text[at])
        at += len(key or "x")
    return "".join(out)


def test_longest_matches_and_positions():
    rng = random.Random(2)
    for _ in range(400):
        table = {"".join(rng.choices("abcé", k=rng.randint(1, 4))): "".join(rng.choices("XY", k=rng.randint(0, 3))) for _ in range(6)}
        text = "".join(rng.choices("abcéd ", k=rng.randint(0, 30)))
        new, edits = T.Transducer(table).apply(text)
        assert new == plain(table, text)
        assert all(b <= len(text) and text[a:b] in table and new[c:d] == table[text[a:b]] for a, b, c, d in edits)
        cuts = [p for p in range(len(text) + 1) if not any(a < p < b for a, b, _, _ in edits)]
        for p in cuts:
            for q in (q for q in cuts if q >= p):
                s, e = T.moved(edits, p, q)
                if not any(c == d for _, _, c, d in edits):
                    assert new[s:e] == plain(table, text[p:q]) and T.moved(edits, s, e, True) == (p, q)


def test_a_bound_inside_a_piece_goes_outward():
    _, edits = T.Transducer({"abc": "xy"}).apply("--abc--abc")
    assert T.moved(edits, 3, 4) == (2, 4) and T.moved(edits, 4, 9) == (2, 8)


@pytest.mark.parametrize("said, want", [("한국", "hanguk"), ("서울", "seoul"), ("부산", "busan"), ("값", "gaps"), ("가힣", "gahit"), ("아", "a")])
def test_hangul(said, want):
    assert T.Transducer({}).apply(said)[0] == want
    assert T.Transducer({}, hangul=False).apply(said)[0] == said
    assert T.Transducer({said[0]: "!"}).apply(said)[0].startswith("!")


def test_rows(spark):
    kind = "doc_id int, text string, spans array<struct<start:int,end:int,label:string>>, edits string"
    df = spark.createDataFrame([(1, "é서울!", [(0, 1, "A"), (1, 3, "B")], None), (2, None, [(0, 1, "A")], None), (3, "", None, None), (None, "x", [], None)], kind)
    made = T.transliterated(df, T.Transducer({"é": "ee"}))
    got = {r.doc_id: r for r in made.collect()}
    assert got[1].text == "eeseoul!" and [tuple(s) for s in got[1].spans] == [(0, 2, "A"), (2, 7, "B")]
    assert got[2].text is None and [tuple(s) for s in got[2].spans] == [(0, 1, "A")] and got[3].spans == [] and got[None].text == "x"
    back = {r.doc_id: [tuple(s) for s in r.spans] for r in T.restored(made).collect()}
    assert back == {1: [(0, 1, "A"), (1, 3, "B")], 2: [(0, 1, "A")], 3: [], None: []}
    with pytest.raises(ValueError):
        T.Transducer({"": "x"})


def _flat(transducer, texts):
    """Edits and new texts of a whole batch, text by text."""
    points, sizes = T._points(texts)
    edits, new = transducer.edits(points, sizes)
    held = [[] for _ in texts]
    for row, *e in zip(*(x.tolist() for x in edits)):
        held[row].append(tuple(e))
    said, out = new.tobytes().decode("utf-32-le"), []
    for text, es in zip(texts, held):
        n = len(text or "") + sum(d - c - b + a for a, b, c, d in es)
        out.append((said[:n], es))
        said = said[n:]
    assert not said
    return edits, out


def test_batches_equal_single_texts():
    rng = random.Random(4)
    for k in range(400):
        table = {"".join(rng.choices("abcé서𝒳", k=rng.randint(1, 4))): "".join(rng.choices("XY", k=rng.randint(0, 3))) for _ in range(rng.randint(0, 7))}
        made = T.Transducer(table, hangul=k % 2 == 0)
        texts = ["".join(rng.choices("abcéd 서울𝒳", k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(rng.randint(0, 6))]
        edits, got = _flat(made, texts)
        assert got == [made.apply(t) for t in texts]
        spans = [(r, *sorted(rng.choices(range(-2, len(t) + 4), k=2))) for r, t in enumerate(texts) for _ in range(5)]
        row, start, end = (np.array(x, np.int64) for x in (zip(*spans) if spans else ([], [], [])))
        for back in (False, True):
            new = edits.moved(row, start, end, back)
            assert list(zip(*(x.tolist() for x in new))) == [T.moved(made.apply(texts[r])[1], a, b, back) for r, a, b in spans]


def test_long_chains_of_overlapping_keys():
    made = T.Transducer({"aa": "b", "aaa": "", "ab": "xyz"})
    texts = ["a" * n for n in (1, 2, 3, 4, 1000, 1001, 5000)] + ["aab" * 999, ""]
    assert _flat(made, texts)[1] == [made.apply(t) for t in texts]


def test_runs_equal_a_pattern():
    rng = random.Random(5)
    letters = np.zeros(0x110000, bool)
    letters[[ord(c) for c in WORD_LETTERS]] = True
    for _ in range(200):
        texts = ["".join(rng.choices("aZß é.1Ä\n", k=rng.choice([0, 1, 2, 9]))) for _ in range(rng.randint(0, 6))]
        points, sizes = T._points(texts)
        begin = np.cumsum(sizes) - sizes
        want = [(int(b) + m.start(), int(b) + m.end()) for b, t in zip(begin, texts) for m in re.finditer(_WORDS["WORD"], t)]
        assert list(zip(*(x.tolist() for x in T.runs_of(points, sizes, letters)))) == want


def test_moved_runs_equal_moved_spans(spark, monkeypatch):
    """What the query tells of a text is what its spans moved and restored tell; nothing is shuffled or read twice."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(["sch", "the", " ", "ß", "ción", "é", "x", "서", "1", "\n", "c", "𝒳"], k=rng.choice([0, 1, 40, 300]))) for _ in range(60)] + [None, "", "...", "a"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "the é")], "doc_id int, text string").coalesce(1)
    made = T.Transducer(LETTERS)
    want = {}
    for k, text in [*enumerate(texts), (None, "the é")]:
        new, edits = made.apply(text or "")
        old = [m.span() for m in re.finditer(_WORDS["WORD"], text or "")]
        spans = [T.moved(edits, *s) for s in old]
        back = [T.moved(edits, *s, True) for s in spans]
        said = hashlib.md5("|".join(new[a:b] for a, b in spans).encode()).hexdigest()
        if old:
            want[k] = (len(old), *map(sum, zip(*spans)), said, *map(sum, zip(*back)))
    for rows, chars in ((4096, 1 << 20), (3, 1 << 20), (4096, 50)):
        monkeypatch.setattr(T, "ROWS", rows)
        monkeypatch.setattr(T, "CHARS", chars)
        assert {r[0]: tuple(r[1:]) for r in T.moved_runs(df, made, WORD_LETTERS).collect()} == want


def test_moved_spans_reads_texts_once(spark, sf_dir, capsys):
    QUERIES["moved_spans"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == 1 and plan.count("MapInArrow") == 1 and "Exchange" not in plan
