"""Text to spans in one pass: windows, one batched scorer call at a time, votes, decoding and trimming, within the row.

A scorer takes some windows (their tokens, their number in the document and the place of their first token) and
returns, for each token, a tag (``O``, ``B-X``, ``I-X``, or null for a token that has none) and a confidence. Windows of
several documents share a call; a document that needs more windows than one call is scored piece by piece and stitched.
The steps are those of ``spans.windows``, ``spans.voted`` and ``spans.bio_decoded``, but rows are never regrouped: texts are
dealt to tasks once, and a task holds the tokens of a few documents and the windows of one call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.labels import OUTSIDE
from spanweave.operators.spans import TOKEN, trimmed

_SPANS = "array<struct<start:int,end:int,label:string,score:double>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))


@dataclass
class Window:
    """Tokens of one window, its number in the document, and the place of its first token."""

    tokens: list[str]
    number: int
    first: int


Scores = list[tuple[list[str | None], list[float]]]


@dataclass
class _Stitched:
    """A document's tokens and the votes for them so far."""

    at: list[tuple[int, int]]
    tags: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    open: int = 0


class Predictor:
    """``score`` maps a list of windows to a list of (tags, confidences). ``vote`` is ``max``, ``central`` or ``avg``."""

    def __init__(self, score: Callable[[list[Window]], Scores], body: int = 382, stride: int = 96, vote: str = "max", pattern: str = TOKEN, batch: int = 32):
        if vote not in ("max", "central", "avg"):
            raise ValueError(f"there is no vote called {vote}")
        self.score, self.body, self.step, self.vote, self.pattern, self.batch = score, body, max(1, body - stride), vote, pattern, batch

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, label, mean confidence) of every text, untrimmed, in order."""
        found = [self._begun(text) for text in texts]
        held: list[tuple[_Stitched, Window]] = []
        for text, document in zip(texts, found):
            for window in self._windows(text, document):
                held.append((document, window))
                if len(held) == self.batch:
                    self._take(held)
                    held = []
        self._take(held)
        return [self._decoded(document) for document in found]

    def _begun(self, text: str) -> _Stitched:
        at = [m.span() for m in re.finditer(self.pattern, text)]
        empty = (lambda: {}) if self.vote == "avg" else (lambda: None)
        return _Stitched(at, [None] * len(at), [empty() for _ in at])

    def _windows(self, text: str, document: _Stitched) -> Iterator[Window]:
        n = len(document.at)
        for k in range(max(0, -(-(n - self.body) // self.step)) + 1 if n else 0):
            first = k * self.step
            yield Window([text[a:b] for a, b in document.at[first : first + self.body]], k, first)

    def _take(self, held: list[tuple[_Stitched, Window]]) -> None:
        """One scorer call, and its votes."""
        if not held:
            return
        scores = self.score([w for _, w in held])
        if len(scores) != len(held):
            raise ValueError(f"the scorer answered {len(scores)} of {len(held)} windows")
        for (document, window), (tags, sure) in zip(held, scores):
            n = len(window.tokens)
            if len(tags) != n or len(sure) != n:
                raise ValueError(f"the scorer answered {len(tags)} of {n} tokens of a window")
            for k, (tag, p) in enumerate(zip(tags, sure)):
                i = window.first + k
                if self.vote == "avg":
                    total, count = document.keys[i].get(tag, (0.0, 0))
                    document.keys[i][tag] = (total + p, count + 1)
                    continue
                key = (p, -window.number) if self.vote == "max" else (min(k, n - k), p, -window.number)
                if document.keys[i] is None or key > document.keys[i]:
                    document.keys[i], document.tags[i] = key, (tag, p)

    def _decoded(self, document: _Stitched) -> list[tuple[int, int, str, float]]:
        if self.vote == "avg":
            means = [max(((total / count, tag or "", tag) for tag, (total, count) in key.items())) for key in document.keys]
            document.tags = [(tag, p) for p, _, tag in means]
        out, run, before = [], None, None
        for (start, end), (tag, p) in zip(document.at, document.tags):
            if tag is None or start == end:
                continue
            label = None if tag == OUTSIDE else tag[2:]
            if label is not None:
                if tag[:2] == "I-" and before == label:
                    run[1], run[3], run[4] = end, run[3] + p, run[4] + 1
                else:
                    run = [start, end, label, p, 1]
                    out.append(run)
            before = label
        return [(start, end, label, total / n) for start, end, label, total, n in out]


def _listed(found: list[list[tuple[int, int, str, float]]]) -> pa.Array:
    """The spans of every text as one array, made by columns."""
    columns = list(zip(*(span for spans in found for span in spans))) or [()] * len(_ARROW.value_type)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW.value_type)], fields=list(_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), structs)


def predicted(docs: DataFrame, predictor: Predictor, key: str = "doc_id", text: str = "text", trim: bool = True, rows: int = 64) -> DataFrame:
    """``key, start, end, label, score``: the predictor's spans of every document; trimmed ones that are empty go.

    Null and empty texts have none. Null and repeated keys are carried; other columns are not read. ``rows`` documents
    are tokenised at a time.
    """
    kind = docs.schema[key].dataType
    # A file's row group is read by one task; scoring takes far longer than a shuffle of texts, so all cores take part.
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).hint("repartition")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = predictor.spans(part.column(1).to_pylist())
                # The texts go back only where their spans are to be trimmed.
                yield pa.RecordBatch.from_arrays([part.column(0), *([part.column(1)] if trim else []), _listed(found)], names)

    names = ["key", *(["text"] if trim else []), "spans"]
    found = given.mapInArrow(run, f"key {kind.simpleString()}, {'text string, ' if trim else ''}spans {_SPANS}")
    if not trim:
        return found.select(F.col("key").alias(key), F.inline("spans"))
    whole = found.select(F.col("key").alias(key), "text", F.explode("spans").alias("s"))
    cut = whole.withColumn("cut", trimmed(F.col("text"), F.col("s.start"), F.col("s.end"), F.col("s.label")))
    return cut.where("cut IS NOT NULL").select(key, F.col("cut.start").alias("start"), F.col("cut.end").alias("end"), "s.label", "s.score")
