"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token is the one of greatest summed piece scores; its number of pieces is the
count. The distinct pre-tokens of a batch form a trie: each node holds the best score of the prefix that it
spells and the pieces behind it, computed once however many pre-tokens share the prefix, and each pre-token's
terminal node holds its count. Scores come from the vocabulary file's ranks (rank r scores ``-log(r + 2)``,
a Zipf prior), since the public rank files carry no probabilities.

Scale: a map over the documents without a shuffle. A task keeps one trie of at most ``TRIE_NODES`` prefixes (and one
word more) and the terminal counts of about ``CACHE_WORDS`` pre-tokens for all its documents.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from spanweave.llm.common import map_slices, picked, splitter

#: Words whose counts, and prefixes whose scores, a task keeps; beyond them it begins anew.
CACHE_WORDS, TRIE_NODES = 200_000, 400_000

_loaded: dict[str, dict[bytes, float]] = {}
#: By vocabulary, what a process has made of it.
_tails: dict[str, dict[bytes, float]] = {}


def scores(path: str) -> dict[bytes, float]:
    """Piece scores from a file of base64 pieces and ranks; read once in each process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            _loaded[path] = {base64.b64decode(piece): -math.log(int(rank) + 2) for piece, rank in pairs}
    return _loaded[path]


def tails(pieces: dict[bytes, float]) -> dict[bytes, float]:
    """The score of every piece, and minus infinity for what only ends one: a search backward stops where neither fits."""
    found: dict[bytes, float] = {}
    for piece in pieces:
        for k in range(1, len(piece)):
            found[piece[k:]] = -math.inf
    return found | pieces


def checked(pieces: dict[bytes, float]) -> dict[bytes, float]:
    """``pieces``; without all 256 bytes some word would have no segmentation."""
    missing = [b for b in range(256) if bytes([b]) not in pieces]
    if missing:
        raise ValueError(f"a byte-level vocabulary has all 256 bytes; {len(missing)} are missing, the first is {missing[0]}")
    return pieces


class Trie:
    """Prefixes of pre-tokens with their forward scores; node 0 is the empty prefix.

    The trie has ``DEPTH`` levels; the rest of a longer word, which hardly any other shares, is scored in a ring of as
    many scores as the longest piece has bytes, and is not kept.
    """

    DEPTH = 256

    def __init__(self, ends: dict[bytes, float], longest: int):
        self.ends, self.longest = ends, longest
        self.child: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def insert(self, word: bytes) -> int:
        """Add ``word``; returns the pieces of its best segmentation. Only prefixes not seen before are scored."""
        child, best, count, get = self.child, self.best, self.count, self.ends.get
        path = [0]
        node = 0
        for end, byte in enumerate(word[: self.DEPTH], 1):
            step = node << 8 | byte
            known = child.get(step)
            if known is None:
                top, pieces = -math.inf, 0
                for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
                    score = get(word[begin:end])
                    if score is None:
                        break
                    back = path[begin]
                    score += best[back]
                    if score > top or (score == top and count[back] + 1 < pieces):
                        top, pieces = score, count[back] + 1
                known = child[step] = len(best)
                best.append(top)
                count.append(pieces)
            node = known
            path.append(node)
        return count[node] if len(word) <= self.DEPTH else self._rest(word, path)

    def _rest(self, word: bytes, path: list[int]) -> int:
        """The count of a word beyond the trie's depth: the same recurrence over a ring."""
        size, get = self.longest + 1, self.ends.get
        best, count = [0.0] * size, [0] * size
        for k in range(max(0, self.DEPTH - self.longest), self.DEPTH + 1):
            best[k % size], count[k % size] = self.best[path[k]], self.count[path[k]]
        for end in range(self.DEPTH + 1, len(word) + 1):
            top, pieces = -math.inf, 0
            for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
                score = get(word[begin:end])
                if score is None:
                    break
                back = begin % size
                score += best[back]
                if score > top or (score == top and count[back] + 1 < pieces):
                    top, pieces = score, count[back] + 1
            best[end % size], count[end % size] = top, pieces
        return count[len(word) % size]


def token_counts(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for every row.

    Pre-tokens are the matches of ``pattern`` over the whole text; each is segmented as UTF-8 bytes. Of equally
    good segmentations the one with fewest pieces counts. Null texts have no tokens; a text without matches has
    none; repeated rows and null ids are carried; extra columns are not read. The vocabulary is read by the driver,
    and must have all 256 bytes (else a ``ValueError``), so that every word has a segmentation.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)

    pieces = checked(scores(vocabulary))
    longest = max(map(len, pieces))

    def make():
        split = splitter(pattern)
        known: dict[str, int] = {}
        if vocabulary not in _tails:
            _tails[vocabulary] = tails(pieces)
        ends = _tails[vocabulary]

        trie = Trie(ends, longest)

        def learn(words: Iterable[str]) -> None:
            nonlocal trie
            for word in words:
                if len(trie.best) > TRIE_NODES:
                    trie = Trie(ends, longest)
                known[word] = trie.insert(word.encode())

        def work(batch: pa.RecordBatch):
            if len(known) > CACHE_WORDS:
                known.clear()
            texts = [split(t or "") for t in batch.column(1).to_pylist()]
            learn({w for words in texts for w in words if w not in known})
            get = known.__getitem__
            return [batch.column(0), [len(words) for words in texts], [sum(map(get, words)) for words in texts]]

        return work

    return map_slices(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long", make, rows=64)
