"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and blanks collapsed. An item of m characters gets an error budget of
``floor(m * max_error_rate)`` edits and is split into budget-plus-one pieces: wherever the item occurs within
the budget, one piece occurs unchanged. One automaton finds all pieces of a block of items in one pass over a
text. A hit is verified from the piece upward through a binary tree of its item's pieces: a node of n pieces may
have n - 1 edits, and an occurrence within the budget passes every node from some unchanged piece to the root.
Myers' bit-parallel distance decides at each node, so most chance hits end after a few characters.

Scale: the documents are never shuffled. Items go to the tasks in blocks of about ``BLOCK_BYTES`` of text, checked
before anything is sent; what a task builds of a block is some hundred bytes for each character of it (a block takes
under 300 MB), as bit vectors are made only for nodes that are verified and a bounded number is kept. A larger
benchmark takes more passes, one for each block.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, picked, struct_of, unused

MAX_ERROR_RATE = 0.1
BLOCK_BYTES = 2 << 20
#: Nodes whose bit vectors a task keeps.
KEPT_NODES = 1 << 14

_built: dict[str, Matcher] = {}


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget-plus-one pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A text searched for with at most ``budget`` edits (Myers' bit vectors in one Python integer each)."""

    def __init__(self, item: str, budget: int):
        self.item, self.budget, self.size = item, budget, len(item)
        self.mask = (1 << self.size) - 1
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """The least number of edits between the item and any substring of ``text``."""
        plus, minus, score, mask = self.mask, 0, self.size, self.mask
        top, get, best = 1 << (self.size - 1), self.peq.get, self.size
        for c in text:
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (mask & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = ph << 1 & mask
            plus = (mh << 1 & mask) | (mask & ~(xv | ph))
            minus = ph & xv
        return best


def nodes(count: int, k: int) -> list[tuple[int, int]]:
    """The nodes (first piece, piece after the last) above piece ``k`` of ``count``, smallest first and all pieces last."""
    a, b, above = 0, count, [(0, count)]
    while b - a > 2:
        middle = (a + b) // 2
        a, b = (a, middle) if k < middle else (middle, b)
        if b - a > 1:
            above.append((a, b))
    return above[::-1]


class Matcher:
    """The automaton and patterns of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: list[str] = []
        self.budgets: list[int] = []
        self.ids: list[list[int]] = []
        known: dict[str, int] = {}
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            item = normal(raw)
            if not item:
                continue
            if item in known:
                self.ids[known[item]].append(item_id)
                continue
            number = known[item] = len(self.items)
            self.items.append(item)
            self.budgets.append(int(len(item) * rate))
            self.ids.append([item_id])
            for k, (_, piece) in enumerate(pieces(item, self.budgets[-1])):
                hits.setdefault(piece, []).append((number, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()
        self.empty = not hits
        self.node = lru_cache(KEPT_NODES)(self._node)
        self.above = lru_cache(KEPT_NODES)(nodes)

    def _cut(self, number: int, k: int) -> int:
        return len(self.items[number]) * k // (self.budgets[number] + 1)

    def _node(self, number: int, a: int, b: int) -> Pattern:
        """The pattern of some neighbouring pieces of an item."""
        return Pattern(self.items[number][self._cut(number, a) : self._cut(number, b)], b - a - 1)

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item number, distance) of every item within its budget, in item order."""
        if self.empty:
            return []
        text = normal(text)
        best: dict[int, int] = {}
        for end, (size, where) in self.automaton.iter(text):
            begin = end - size + 1
            for number, k in where:
                if best.get(number) == 0:
                    continue
                at = self._cut(number, k)
                if begin >= at and text.startswith(self.items[number], begin - at):
                    best[number] = 0
                    continue
                for a, b in self.above(self.budgets[number] + 1, k):
                    p = self.node(number, a, b)
                    start = begin - at + self._cut(number, a)
                    found = p.distance(text[max(0, start - p.budget) : start + p.size + p.budget])
                    if found > p.budget:
                        break
                else:
                    best[number] = min(best.get(number, found), found)
        return sorted(best.items())


def _matcher(block, rate: float) -> Matcher:
    """Built once in each Python worker."""
    key, items = block.value
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, rate)
    return _built[key]


class Blocks:
    """Broadcast blocks of the items, dealt by hash: about BLOCK_BYTES of text each, or one longer item."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str):
        rows = picked(items, item_id=id_col, text=text_col).where("text IS NOT NULL")
        size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        self.count = max(1, -(-size // BLOCK_BYTES))
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.count)))

    def __iter__(self):
        sc = self.rows.sparkSession.sparkContext
        for k in range(self.count):
            part = self.rows.where(F.col("block") == k).orderBy("item_id", "text").select("item_id", "text").collect()
            yield sc.broadcast((uuid.uuid4().hex, [tuple(r) for r in part]))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_error_rate: float = MAX_ERROR_RATE,
) -> DataFrame:
    """``doc_id, item_id, distance, budget``: every document and item that occurs in it within its budget.

    Null and blank texts match nothing; a null id is carried; repeated rows of documents give repeated rows,
    and so do items that share a text; extra columns are not read.
    """
    rows = picked(docs, doc_id=doc_id, text=doc_text)
    kinds = {"doc_id": rows.schema["doc_id"].dataType, "item_id": items.schema[item_id].dataType}
    schema = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items()) + ", distance int, budget int"
    out = None
    for block in Blocks(items, item_id, item_text):

        def make(block=block):
            matcher = _matcher(block, max_error_rate)

            def work(batch: pa.RecordBatch):
                found = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for number, distance in matcher.search(text):
                        budget = matcher.budgets[number]
                        found += [(key, item, distance, budget) for item in matcher.ids[number]]
                return list(zip(*found)) if found else None

            return work

        part = map_slices(rows, schema, make)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_error_rate: float = MAX_ERROR_RATE,
) -> DataFrame:
    """``docs``, all columns, without the rows in which an item occurs within its budget."""
    columns = docs.columns
    flag = unused(docs, "contaminated")
    at = columns.index(doc_text)
    for block in Blocks(items, item_id, item_text):

        def make(block=block):
            matcher = _matcher(block, max_error_rate)

            def work(batch: pa.RecordBatch):
                return [*batch.columns, [bool(matcher.search(t)) for t in batch.column(at).to_pylist()]]

            return work

        docs = map_slices(docs, struct_of(docs, f"`{flag}` boolean"), make).where(~F.col(flag)).drop(flag)
    return docs.select(*columns)
