"""Texts in other letters, with a map of positions: longest matches of a table, and Hangul by the arithmetic of its syllables.

The table is the caller's. At each place the longest of its keys that stands there is replaced and skipped; other
characters stay, except Hangul syllables without a key of their own, which are spelt by their parts. What was replaced
is kept as edits (old and new bounds), so spans move forward and come back: a bound inside a replaced piece goes to the
piece's edge, outward.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The letters of initial consonants, vowels and final consonants, in the order of the Unicode standard,
#: as the Revised Romanization spells them letter by letter.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
FINALS = ["", *"k k ks n nj nh t l lk lm lb ls lt lp lh m p ps t t ng t t k t p t".split(" ")]
_FIRST, _LAST = 0xAC00, 0xD7A3

#: Texts, and their characters or spans, that are worked on at a time; a longer text is alone.
ROWS, CHARS = 4096, 1 << 20

Edit = tuple[int, int, int, int]


def syllable(c: str) -> str:
    """A Hangul syllable in Latin letters: its number is (initial * 21 + vowel) * 28 + final."""
    rest, final = divmod(ord(c) - _FIRST, 28)
    initial, vowel = divmod(rest, 21)
    return INITIALS[initial] + VOWELS[vowel] + FINALS[final]


class Transducer:
    """``table`` maps pieces of text to what is written for them; without ``hangul`` its syllables stay."""

    def __init__(self, table: dict[str, str], hangul: bool = True):
        if "" in table:
            raise ValueError("an empty key has no place in a text")
        self.table, self.hangul = table, hangul
        self.sizes: dict[str, list[int]] = {}
        for key in table:
            self.sizes.setdefault(key[0], []).append(len(key))
        self.sizes = {c: sorted(set(n), reverse=True) for c, n in self.sizes.items()}
        self._keys: _Keys | None = None

    def edits(self, points: np.ndarray, sizes: np.ndarray) -> tuple[Edits, np.ndarray]:
        """What :meth:`apply` replaces in texts that stand one after the other, and their new code points."""
        if self._keys is None:  # in the worker
            self._keys = _Keys({**({chr(c): syllable(chr(c)) for c in range(_FIRST, _LAST + 1)} if self.hangul else {}), **self.table})
        ends = np.cumsum(sizes)
        start, end, which = self._keys.found(points, ends)
        size = self._keys.sizes[which]
        shift = np.concatenate([[0], np.cumsum(size - (end - start))])
        row = np.searchsorted(ends, start, "right")
        old, new = ends - sizes, ends - sizes + shift[np.searchsorted(start, ends - sizes)]
        begin = start + shift[:-1]
        told = Edits(row, start - old[row], end - old[row], begin - new[row], begin + size - new[row])
        covered = np.zeros(len(points) + 1, np.int8)
        covered[start] += 1
        covered[end] -= 1
        out, put = np.empty(len(points) + shift[-1], np.uint32), _ranges(begin, size)
        copied = np.ones(len(out), bool)
        copied[put] = False
        out[copied] = points[np.cumsum(covered[:-1], dtype=np.int8) == 0]
        out[put] = self._keys.written[_ranges(self._keys.at[which], size)]
        return told, out

    def apply(self, text: str) -> tuple[str, list[Edit]]:
        """The new text, and (start, end, new start, new end) of every piece that was replaced, in order."""
        out, edits, at, new, copied = [], [], 0, 0, 0
        while at < len(text):
            c = text[at]
            said, size = None, 0
            for size in self.sizes.get(c, ()):
                piece = text[at : at + size]
                said = self.table.get(piece)
                if said is not None:
                    size = len(piece)  # less than asked for at the text's end
                    break
            if said is None and self.hangul and _FIRST <= ord(c) <= _LAST:
                said, size = syllable(c), 1
            if said is None:
                at += 1
                continue
            new += at - copied
            out += [text[copied:at], said]
            edits.append((at, at + size, new, new + len(said)))
            at = copied = at + size
            new += len(said)
        return "".join([*out, text[copied:]]), edits


class Edits(NamedTuple):
    """The edits of many texts, in order: the text of each, and its bounds in that text before and after."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    new_start: np.ndarray
    new_end: np.ndarray

    def moved(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """:func:`moved` for spans of many texts."""
        a, b, c, d = (self.new_start, self.new_end, self.start, self.end) if back else (self.start, self.end, self.new_start, self.new_end)
        if not len(a):
            return start, end
        place = (self.row << 32) + a

        def bound(p: np.ndarray, low: bool) -> np.ndarray:
            k = np.searchsorted(place, (row << 32) + p, "right") - 1
            known = (k >= 0) & (self.row[k] == row)
            inside = c[k] if low else np.where(p == a[k], c[k], d[k])
            return np.where(known, np.where(p >= b[k], p - b[k] + d[k], inside), p)

        return bound(start, True), bound(end, False)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin`` to ``begin + size`` of every range, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class _Keys:
    """The keys of a table as a tree in arrays, so that all places of many texts go down it together."""

    def __init__(self, table: dict[str, str]):
        steps: dict[tuple[int, int], int] = {}
        said = [-1]
        for number, key in enumerate(table):
            state = 0
            for c in key:
                state = steps.setdefault((state, ord(c)), len(said))
                if state == len(said):
                    said.append(-1)
            said[state] = number
        self.said = np.array(said, np.int64)
        self.first = np.zeros(0x110000, np.int32)
        for (state, c), to in steps.items():
            if not state:
                self.first[c] = to
        deep = sorted(((state << 21) | c, to) for (state, c), to in steps.items() if state)
        self.step, self.to = np.array([k for k, _ in deep], np.int64), np.array([to for _, to in deep], np.int64)
        self.more = np.zeros(len(said), bool)
        self.more[self.step >> 21] = True
        self.sizes = np.array([len(v) for v in table.values()], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.written = np.frombuffer("".join(table.values()).encode("utf-32-le"), "<u4")

    def found(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of the key for every piece that is replaced; ``ends`` of texts, over which no piece goes."""
        state = self.first[points]
        place = np.flatnonzero(state)
        state = state[place].astype(np.int64)
        which = self.said[state]
        size, depth, live = np.ones(len(place), np.int64), 1, np.flatnonzero(self.more[state])
        limit = np.zeros(len(place), np.int64)
        limit[live] = ends[np.searchsorted(ends, place[live], "right")]
        while len(live):
            live = live[place[live] + depth < limit[live]]
            step = (state[live] << 21) | points[place[live] + depth]
            k = np.minimum(np.searchsorted(self.step, step), len(self.step) - 1)
            hit = self.step[k] == step
            live, depth = live[hit], depth + 1
            state[live] = self.to[k[hit]]
            full = live[self.said[state[live]] >= 0]
            which[full], size[full] = self.said[state[full]], depth
            live = live[self.more[state[live]]]
        kept = which >= 0
        place, end, which = place[kept], (place + size)[kept], which[kept]
        taken = _taken(place, end)
        return place[taken], end[taken], which[taken]


def _taken(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Those of the pieces (by ``start``) that one after the other are taken from the left, each past the end of the one before."""
    n = len(start)
    taken = np.ones(n + 1, bool)
    # A piece past the ends of all before it is taken in any case; the others are reached from these, by ever longer jumps.
    taken[1:n] = start[1:] >= np.maximum.accumulate(end)[:-1]
    if not taken.all():
        jump = np.append(np.searchsorted(start, end), n)
        while not taken[reached := jump[taken]].all():
            taken[reached] = True
            jump = jump[jump]
    return np.flatnonzero(taken[:n])


def moved(edits: list[Edit], start: int, end: int, back: bool = False) -> tuple[int, int]:
    """A span's bounds in the new text, or (``back``) in the old one."""
    a, b, c, d = (2, 3, 0, 1) if back else (0, 1, 2, 3)

    def bound(p: int, low: bool) -> int:
        k = bisect_right(edits, p, key=lambda e: e[a]) - 1
        if k < 0:
            return p
        e = edits[k]
        if p >= e[b]:
            return p - e[b] + e[d]
        return e[c] if low or p == e[a] else e[d]

    return bound(start, True), bound(end, False)


def _slices(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``ROWS`` rows at most and of about ``CHARS`` by their ``sizes``."""
    size = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // CHARS
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for begin, end in zip(cuts, [*cuts[1:], batch.num_rows]):
        for at in range(begin, end, ROWS):
            yield batch.slice(at, min(ROWS, end - at))


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and how many each has."""
    held = [t or "" for t in texts]
    return np.frombuffer("".join(held).encode("utf-32-le"), "<u4"), np.array([len(t) for t in held], np.int64)


def _cuts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _lists(sizes: np.ndarray, **fields) -> pa.ListArray:
    """Arrays of structs, ``sizes`` of them in each row."""
    return pa.ListArray.from_arrays(pa.array(_cuts(sizes), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _moved_lists(spans: pa.ListArray, edits: Edits, back: bool = False) -> pa.ListArray:
    """A column of spans with its bounds moved; null bounds stay null."""
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    given = [flat.field(c) for c in ("start", "end")]
    old = [pc.fill_null(p, 0).to_numpy(zero_copy_only=False).astype(np.int64) for p in given]
    new = edits.moved(np.repeat(np.arange(len(sizes)), sizes), *old, back)
    start, end = (pc.if_else(pc.is_null(p), pa.scalar(None, pa.int32()), pa.array(q, pa.int32())) for p, q in zip(given, new))
    return _lists(sizes, start=start, end=end, label=flat.field("label"))


_NAMES = ("start", "end", "new_start", "new_end")


def transliterated(rows: DataFrame, transducer: Transducer, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """``key, text, spans, edits``: new texts with their spans (``start, end, label``) moved, in Arrow batches.

    A null text stays null, without edits; its spans stay as they are. Null span arrays are empty.
    """
    kind = rows.schema[key].dataType.simpleString()
    span = "struct<start:int,end:int,label:string>"
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].cast("string").alias("label"))), F.array().cast(f"array<{span}>")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column(1))):
                texts = part.column(1).to_pylist()
                points, sizes = _points(texts)
                edits, new = transducer.edits(points, sizes)
                said, count = new.tobytes().decode("utf-32-le"), np.bincount(edits.row, minlength=len(sizes))
                cuts = _cuts(sizes + np.bincount(edits.row, edits.new_end - edits.new_start - edits.end + edits.start, len(sizes)).astype(np.int64)).tolist()
                told = pa.array([None if t is None else said[a:b] for t, a, b in zip(texts, cuts, cuts[1:])], pa.string())
                changes = _lists(count, **{n: pa.array(getattr(edits, n), pa.int32()) for n in _NAMES})
                yield pa.RecordBatch.from_arrays([part.column(0), told, _moved_lists(part.column(2), edits), changes], ["key", "text", "spans", "edits"])

    found = given.mapInArrow(run, f"key {kind}, text string, spans array<{span}>, edits array<struct<start:int,end:int,new_start:int,new_end:int>>")
    return found.withColumnRenamed("key", key)


def restored(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, spans`` of :func:`transliterated` with their bounds in the old texts again."""
    kind, span = rows.schema[key].dataType.simpleString(), rows.schema["spans"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, pc.list_value_length(batch.column(1))):
                changes = part.column(2)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(changes).to_numpy(zero_copy_only=False))
                edits = Edits(row, *(changes.flatten().field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in _NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), _moved_lists(part.column(1), edits, True)], ["key", "spans"])

    return rows.select(F.col(key).alias("key"), "spans", "edits").mapInArrow(run, f"key {kind}, spans {span}").withColumnRenamed("key", key)


def runs_of(points: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of ``letters`` (true or false by code point) in texts that stand one after the other."""
    told = letters[points]
    begin, close = told.copy(), told.copy()
    begin[1:] &= ~told[:-1]
    close[:-1] &= ~told[1:]
    ends = np.cumsum(sizes)[sizes > 0]
    begin[ends[:-1]], close[ends - 1] = told[ends[:-1]], told[ends - 1]
    return np.flatnonzero(begin), np.flatnonzero(close) + 1


def moved_runs(rows: DataFrame, transducer: Transducer, letters: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n, starts, ends, said, old_starts, old_ends`` of every text with a run of ``letters``: how many there are,
    the sums of their bounds after :func:`transliterated`, the md5 of what stands there, joined by ``|``, and the sums of
    their bounds moved back as by :func:`restored`.

    A text is read once, and neither its spans nor its edits leave the task that reads it.
    """
    kind = rows.schema[key].dataType.simpleString()
    numbers = ("n", "starts", "ends", "old_starts", "old_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(0x110000, bool)
        one[[ord(c) for c in letters]] = True
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column(1))):
                points, sizes = _points(part.column(1).to_pylist())
                begin, close = runs_of(points, sizes, one)
                row = np.searchsorted(np.cumsum(sizes), begin, "right")
                old = (np.cumsum(sizes) - sizes)[row]
                edits, new = transducer.edits(points, sizes)
                start, end = edits.moved(row, begin - old, close - old)
                back = edits.moved(row, start, end, True)
                grown = np.bincount(edits.row, edits.new_end - edits.new_start - edits.end + edits.start, len(sizes)).astype(np.int64)
                at = _cuts(sizes + grown)[row]
                # What stands there, and a line after each.
                size = np.maximum(end - start, 0) + 1
                line = np.cumsum(size) - 1
                said = np.append(new, np.uint32(0))[_ranges(at + start, size)]
                said[line] = ord("|")
                told = said.tobytes().decode("utf-32-le")
                runs = _cuts(np.bincount(row, minlength=len(sizes)))
                kept = np.flatnonzero(np.diff(runs))
                cuts = np.append(0, line + 1)[runs].tolist()
                sums = {n: np.diff(_cuts(x)[runs])[kept] for n, x in zip(numbers, (np.ones(len(row), np.int64), start, end, *back))}
                md5 = pa.array([hashlib.md5(told[cuts[k] : cuts[k + 1] - 1].encode()).hexdigest() for k in kept.tolist()], pa.string())
                held = {**{n: pa.array(sums[n], pa.int64()) for n in numbers}, "said": md5}
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), *held.values()], ["key", *held])

    found = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long, starts long, ends long, old_starts long, old_ends long, said string")
    return found.select(F.col("key").alias(key), "n", "starts", "ends", "said", "old_starts", "old_ends")
