"""Nested grammars against a recursive rendering, and covering plans against all pairs."""

import hashlib
import itertools

import pytest

from spanweave.operators import generate as G
from spanweave.operators import grammar as M

GRAMMAR = {
    "S": ["{A} and {B=OUTER}", "{B=OUTER}{B}", "", "plain é"],
    "A": ["<{@x=X}>", "{C=INNER}", "{@x}"],
    "B": ["[{C=INNER}, {C=INNER}]", "{A=MID}"],
    "C": ["c", "日本 {@y}", "{@y=Y}{@x=X}"],
}


def draw(seed, key, place, n):
    return int(hashlib.md5(f"{seed}|{key}|{place}".encode()).hexdigest()[:8], 16) % n


def render(name, place, row, seed, key):
    """Text and spans by recursion, depth first."""
    text, spans, opened = "", [], []
    found = M.pieces(GRAMMAR[name][draw(seed, key, place, len(GRAMMAR[name]))]) or [("text", "")]
    for i, (kind, value) in enumerate(found):
        if kind == "text":
            text += value
        elif kind == "column":
            text += "" if row[value] is None else str(row[value])
        elif kind == "open":
            opened.append(len(text))
        elif kind == "close":
            spans.append((opened.pop(), len(text), value))
        else:
            inner, more = render(value, f"{place}.{i}", row, seed, key)
            spans += [(a + len(text), b + len(text), label) for a, b, label in more]
            text += inner
    return text, spans


def test_documents_equal_the_recursion(spark):
    rows = [(k, f"name{k}" if k % 5 else None, k * 7) for k in range(300)] + [(3, "again", 1)]
    df = spark.createDataFrame(rows, "id int, x string, y int").repartition(5)
    seen = set()
    for r in M.composed(df, GRAMMAR, "S", "seed").collect():
        text, spans = render("S", "0", {"x": r.x, "y": r.y}, "seed", r.id)
        assert r.text == text and sorted(tuple(s) for s in r.spans) == sorted(spans)
        seen |= {s[2] for s in spans}
    assert seen == {"OUTER", "MID", "INNER", "X", "Y"}


def test_grammars_that_do_not_end(spark):
    rows = spark.createDataFrame([(1,)], "id int")
    for bad, why in (({"S": ["{S}"]}, "leads to itself"), ({"S": ["{T}"]}, "no production"), ({"S": ["{@no}"]}, "not there")):
        with pytest.raises(ValueError, match=why):
            M.composed(rows, bad, "S")
    assert M.composed(rows.limit(0), {"S": ["a"]}, "S").collect() == []


@pytest.mark.parametrize("sizes, least", [([1], 2), ([3, 1], 1), ([4, 4, 4, 4, 4], 1), ([2] * 9, 2), ([7, 3, 5, 6], 3), ([11, 2], 1)])
def test_every_pair_is_planned(spark, sizes, least):
    factors = {f"f{k}": [f"{k}.{v}" for v in range(n)] for k, n in enumerate(sizes)}
    plan = G.grid_plan(spark, factors, least).collect()
    for a, b in itertools.combinations(factors, 2):
        for pair in itertools.product(factors[a], factors[b]):
            assert sum((r[a], r[b]) == pair for r in plan) >= least
    assert all({r[f] for r in plan} == set(v) for f, v in factors.items())
