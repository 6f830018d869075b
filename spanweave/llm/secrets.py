"""Secret scans: fixed rules, and a linear-chain conditional random field that adds spans.

Tokens are tagged as begin, inside or outside of a secret. A token's emission score sums weights of its own
shape, of the words before and after it and of its file (document), and tag pairs have transition weights; the
weights are fitted here by maximising the conditional likelihood (forward-backward, gradient steps) on generated
lines, never on a rule's own output. Viterbi decodes whole documents: where a token's outside score exceeds the
others by more than three transitions and the next token's turn from inside to begin could repay, every best path
is outside, so the path is exactly the one found by decoding the stretches between such tokens on their own.

Scale: a map over documents without shuffle or state beyond a bounded cache of word scores.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanweave.llm.common import map_slices, picked

#: Kinds in the order that ties of starts take.
KINDS = ("assign", "access", "hex", "crf")
#: The base rules: fixed patterns. Letters of ``assign`` match in either case, ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: What every match of ``assign`` begins with, in small letters; texts without any are not searched.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 8, 16

OUT, BEGIN, INSIDE = 0, 1, 2
#: Runs of letters, digits and joining marks, with ``=`` only where it pads their end; any other mark alone.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9+/_.=-]))?|[^\sA-Za-z0-9+/_.-]")
#: Parts of names that secrets have.
_HINT = re.compile("pass|pwd|secret|token|cred|auth|key", re.I)
DIM = 1 << 14
CACHE_WORDS = 200_000
#: No valid path goes from outside to inside.
_NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, in code points, ordered by start and kind."""
    low = text.lower()
    named = any(name in low for name in _NAMES)
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_ASSIGN] if named else []
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(maxsize=DIM)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


def _form(word: str) -> str:
    """All that the features of a token's form depend on; words of the same form share it.

    A word of cased letters only has a shape that follows from its case; any other word is its own form.
    """
    n = len(word)
    if n < 16 and word.isalpha():
        case = "a" if word.islower() else "A" if word.isupper() else "Aa" if word[0].isupper() and word[1:].islower() else ""
        if case and (word.isascii() or all(c.isupper() or c.islower() for c in word)):
            return f"{case}:{n.bit_length()}:{n > 12}:{word.isascii()}"
    return word


def _shape(word: str) -> list[str]:
    """Features of one token's form: the whole token decides each, and ``shape`` names at most eight runs of a kind."""
    n = len(word)
    digits, upper, lower = (sum(map(f, word)) for f in (str.isdigit, str.isupper, str.islower))
    kinds = (digits > 0) + (upper > 0) + (lower > 0)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:]))
    longest = max(map(len, re.split(r"[/._-]+", word)))
    squeezed = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in word))
    return [
        "bias",
        f"len={min(n.bit_length(), 7)}",
        f"kinds={kinds}",
        f"turns={min(turns, 6)}",
        f"long={n >= 16}:{kinds}:{turns > 2}",
        f"ascii={word.isascii()}",
        f"digit_share={0 if not n else round(4 * digits / n)}",
        f"shape={squeezed[:8]}",
        f"sep={sum(map(word.count, '+/_=.-')) > 0}:{n > 12}",
        f"path={word[:2] == '//'}:{min(word.count('/'), 3)}:{min(word.count('.'), 2)}",
        f"pieces={min(longest.bit_length(), 6)}:{kinds}",
    ]


def _hint(word: str) -> str:
    """The last part of a name that secrets' names have, wherever it stands in the word, and how the word goes on."""
    found = None
    for found in _HINT.finditer(word):
        pass
    return f"{found[0].lower()}:{'end' if found.end() == len(word) else 'mid'}:{'_' in word or word.isupper()}" if found else "none"


def _slots(word: str, lexicon: frozenset[str]) -> tuple[tuple[int, ...], ...]:
    """Feature slots of a token itself, and as the neighbour one, two and three before, and one after."""
    w = word.lower() if word.lower() in lexicon else "<other>"
    own = tuple(_slot(f"0:{f}") for f in (*_shape(word), f"w={w}"))
    near = [tuple(_slot(f"{k}:{f}") for f in (f"w={w}", f"hint={_hint(word)}", f"len={min(len(word).bit_length(), 6)}")) for k in (-1, -2, -3, 1)]
    return own, *near


def _odd(word: str) -> bool:
    return len(word) > 1 and not word.isalpha()


def _file_slot(odd: int, words: int) -> int:
    """One feature of the file: the share of tokens that plain prose has not, in coarse steps."""
    return _slot(f"file:{min(5, 20 * odd // max(1, words))}")


class _Numbers(dict):
    """The number of each word's form, learnt at first sight."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        self[word] = k = self.learn(word)
        return k


class Crf:
    def __init__(self, weights: np.ndarray, moves: np.ndarray, lexicon: frozenset[str]):
        """weights: DIM by 3; moves: 3 by 3, from tag to tag; lexicon: the words that have weights of their own."""
        self.weights, self.moves, self.lexicon = weights, moves, lexicon
        real = moves[moves > _NEVER / 2]
        self.margin = float(3 * (real.max() - real.min())) + 1e-6
        self.plain = float(2 * (real.max() - moves[OUT, OUT])) + 1e-6
        self.clear()

    def __getstate__(self):
        return self.weights, self.moves, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def clear(self) -> None:
        """Forget cached words: number of each word, number of each form, and the forms' scores."""
        self.number = _Numbers(self.learn)
        self.form: dict[str, int] = {}
        #: Scores by place (itself, one to three before, one after), tag and form.
        self.parts = np.zeros((5, 3, 256))
        self.odd = np.zeros(256, np.int64)

    def learn(self, word: str) -> int:
        form = word if word.lower() in self.lexicon or _HINT.search(word) else _form(word)
        k = self.form.get(form)
        if k is None:
            k = self.form[form] = len(self.form)
            if k == len(self.odd):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)], axis=2)
                self.odd = np.concatenate([self.odd, np.zeros_like(self.odd)])
            self.parts[:, :, k] = [self.weights[list(s)].sum(axis=0) for s in _slots(word, self.lexicon)]
            self.odd[k] = _odd(word)
        return k

    def _scores(self, words: list[str]) -> np.ndarray:
        """Scores of the three tags (rows) at every token."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        place = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        file = self.weights[_file_slot(int(self.odd.take(place).sum()), len(words))]
        out = np.empty((3, len(words)))
        for tag, row in enumerate(out):
            own, before, second, third, after = self.parts[:, tag]
            own.take(place, out=row)
            row += file[tag]
            row[1:] += before.take(place[:-1])
            row[2:] += second.take(place[:-2])
            row[3:] += third.take(place[:-3])
            row[:-1] += after.take(place[1:])
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the three tags (columns) at every token."""
        return self._scores(words).T

    def tag(self, words: list[str]) -> list[tuple[int, int]]:
        """(first, last) token of each span on the best path.

        A stretch of doubt is all outside, too, if each of its tokens prefers that by more than two transitions: a run
        of n other tags has at most n + 1 transitions to gain from.
        """
        if not words:
            return []
        scores = self._scores(words)
        out, begin, inside = scores
        own = out - np.maximum(begin, inside)
        sure = own.copy()
        sure[:-1] -= np.maximum(inside[1:] - begin[1:], 0)
        doubt = np.flatnonzero(sure <= self.margin)
        if not len(doubt):
            return []
        first = np.concatenate([[0], np.flatnonzero(np.diff(doubt) > 1) + 1])
        last = np.concatenate([first[1:] - 1, [len(doubt) - 1]])
        open_ = np.flatnonzero(np.minimum.reduceat(own[doubt], first) <= self.plain)
        found = []
        for a, b in zip(doubt[first[open_]].tolist(), (doubt[last[open_]] + 1).tolist()):
            found += [(a + i, a + j) for i, j in self._path(scores[:, a:b].T, a > 0, b < len(words))]
        return found

    def _path(self, scores: np.ndarray, left: bool, right: bool) -> list[tuple[int, int]]:
        """Viterbi over a stretch with outside on both sides, unless it is the text's edge."""
        best = scores[0] + (self.moves[OUT] if left else np.array([0, 0, _NEVER]))
        back = []
        for row in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        if right:
            best = best + self.moves[:, OUT]
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        tags.reverse()
        spans = []
        for i, t in enumerate(tags):
            if t == BEGIN:
                spans.append([i, i])
            elif t == INSIDE and spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
        return [(a, b) for a, b in spans]


#: Words of the field's lexicon: names that secrets have, and names and marks that other values have.
KEY_WORDS = ["auth_key", "private_key", "client_secret", "bearer", "credential", "access_key", "signing_key", "key", "token", "password", "secret", "api_key", "pwd", "passphrase", "passwd", "apikey", "auth", "credentials"]
PLAIN_WORDS = ["commit", "version", "id", "file", "name", "page", "url", "date", "size", "color", "path", "host", "phone", "user", "=", ":", "is", "@", '"', "'", "|", "$", ",", "(", ")"]


def lines(seed: int, count: int) -> list[tuple[list[str], list[int]]]:
    """Generated training lines: prose, code and settings, with and without a secret."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    sets = {
        "hex": "0123456789abcdef",
        "base64": letters + letters.upper() + digits + "+/",
        "upper": letters.upper() + digits,
        "mixed": letters + letters.upper() + digits + "_-",
    }
    keys, plain_keys = KEY_WORDS[:-4], PLAIN_WORDS[:14]
    syllables = ["the", "and", "ing", "er", "on", "re", "de", "la", "ti", "en", "st", "ou", "ment", "ver", "ein", "que", "os", "chen", "è", "ü", "ñ"]

    def word() -> str:
        w = "".join(rng.choices(syllables, k=rng.randint(1, 5)))
        style = rng.random()
        return w.upper() if style < 0.08 else w.capitalize() if style < 0.2 else w

    def mail() -> str:
        return f"@{rng.choice(['mail', 'smtp', 'web', word().lower()])}{rng.choice(['', str(rng.randint(1, 99))])}.{rng.choice(['example', word().lower()])}.{rng.choice(['com', 'org', 'net'])}"

    def prose() -> list[str]:
        out = []
        for _ in range(rng.randint(4, 14)):
            out.append(word())
            if rng.random() < 0.15:
                out.append(rng.choice([",", ":", "|", "!", "%", "#", "$", "*", "(", ")", "©"]))
            if rng.random() < 0.05:
                out.append(rng.choice([mail(), str(rng.randint(0, 99999)), f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", f"{word()}.{word()}.{word()}".lower(), "".join(rng.choices(digits, k=rng.choice([4, 10, 16])))]))
            if rng.random() < 0.05:
                out[-1] += "."
            if out[-1][0] == "@" and len(out[-1]) > 1:
                tail = out.pop()[1:]
                out += [f"{word().lower()}.{rng.randint(0, 99):02d}", "@", tail]
        return out

    def mixed(n: int) -> str:
        return "".join(rng.choices(sets["mixed"][:62], k=n))

    def path() -> str:
        """Addresses of pages and files, with names of all kinds in them."""
        parts = [rng.choice([word().lower(), mixed(rng.choice([8, 11, 20, 24])), str(rng.randint(1, 10**6)), f"{word()}-{word()}-{word()}".lower(), "files", "docs", "src"]) for _ in range(rng.randint(1, 4))]
        host = rng.choice([f"//{word().lower()}.{rng.choice(['com', 'org', 'io'])}/", f"//www.{word().lower()}.net/{word().lower()}/", "/usr/", "/home/", "src/", "./"])
        return host + "/".join(parts) + rng.choice(["", "", ".html", ".py", ".txt"])

    def name() -> str:
        """A name that ends as secrets' names do, with something before it."""
        end = rng.choice(["pass", "password", "pwd", "secret", "token", "key", "cred", "credentials", "auth_token", "access_key", "secret_key"])
        style = rng.choice([str.lower, str.upper, str.lower, str.title])
        return style(f"{word()}{rng.choice('_-_')}{end}" if rng.random() < 0.8 else end)

    def secret() -> str:
        kind = rng.choice(list(sets))
        if rng.random() < 0.2:
            return rng.choice([f"{word().lower()[:3]}_{mixed(rng.choice([20, 32, 36]))}", f"{mixed(20)}.{mixed(30)}.{mixed(22)}", f"{mixed(13)}/{mixed(7)}/{mixed(18)}", f"{mixed(11)}+{mixed(10)}/{mixed(9)}"])
        return "".join(rng.choices(sets[kind], k=rng.choice([16, 20, 24, 32, 40, 48, 64])))

    def plain() -> str:
        return rng.choice([word().lower(), path(), path(), f"{word()}_{word()}_{word()}".lower(), rng.choice(["true", "false", "none", "null", "12", "4096"]), f"{mixed(8)}-{mixed(4)}-{mixed(4)}-{mixed(4)}-{mixed(12)}".lower(), str(rng.randint(0, 10**6)), f"{word()}_{word()}".lower(), f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"{word()}/{word()}".lower(), f"2{rng.randint(100, 999)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"])

    made = []
    for _ in range(count):
        words, tags = prose(), []
        tags = [OUT] * len(words)
        if rng.random() < 0.6:
            hot = rng.random() < 0.6
            said = (name() if rng.random() < 0.5 else rng.choice(keys)) if hot or rng.random() < 0.4 else rng.choice(plain_keys)
            # What goes on after such a part names something else: its length, its path.
            said = said + rng.choice(["_length", "_path", "s_count", "_type", "_url", "board"]) if not hot and rng.random() < 0.3 else said
            lead = [said, rng.choice([":", "=", "is"])] if not hot or rng.random() < 0.9 else [rng.choice(["Bearer", "bearer", "token", "key"])]
            quote = [rng.choice(['"', "'"])] if rng.random() < 0.4 else []
            value = [secret()] if hot else [plain()]
            if hot and _HINT.search(said) and re.search("(?i)pass|pwd", said) and rng.random() < 0.5:
                value = [rng.choice([f"{word().lower()}{rng.randint(1, 99)}{word().lower()}{rng.randint(1, 99)}", f"{word().capitalize()}{rng.randint(100, 9999)}"]).ljust(8, "x")]
            marks = [BEGIN] if hot else [OUT]
            if hot and rng.random() < 0.15:
                value, marks = [*value, "|" if rng.random() < 0.5 else "$", secret()], [BEGIN, INSIDE, INSIDE]
            piece = lead + quote + value + quote
            mark = [OUT] * len(lead + quote) + marks + [OUT] * len(quote)
            at = rng.randint(0, len(words))
            words[at:at], tags[at:at] = piece, mark
        if rng.random() < 0.5:
            words, tags = ([], []) if rng.random() < 0.3 else (words, tags)
            piece = rng.choice([["https", ":", path()], ["http", ":", path()], ["see", "https", ":", path()], ["url", ":", "https", ":", path()], [path()], ["commit", mixed(7).lower()], ["from", f"{word()}.{word()}.{word()}".lower()]])
            at = rng.randint(0, len(words))
            while tags[at : at + 1] == [INSIDE] or tags[max(at - 1, 0) : at] == [BEGIN]:
                at = rng.randint(0, len(words))
            words[at:at], tags[at:at] = piece, [OUT] * len(piece)
        made.append((words, tags))
    return made


@lru_cache(maxsize=2)
def trained(seed: int = 7, count: int = 1_200, rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Crf:
    """Fit the field on generated lines: AdaGrad steps on the negative conditional log-likelihood, one line each."""
    weights, moves = np.zeros((DIM, 3)), np.zeros((3, 3))
    moves[OUT, INSIDE] = _NEVER
    square_w, square_m = np.full((DIM, 3), 1e-2), np.full((3, 3), 1e-2)
    data = lines(seed, count)
    lexicon = frozenset(KEY_WORDS) | frozenset(PLAIN_WORDS)
    order = random.Random(seed)
    entry = np.array([0, 0, _NEVER])
    for _ in range(rounds):
        order.shuffle(data)
        for words, tags in data:
            n, last = len(words), None
            slots = [_slots(w, lexicon) for w in words]
            rows = []
            file = _file_slot(sum(map(_odd, words)), n)
            for i in range(n):
                row = [*slots[i][0], file]
                row += slots[i - 1][1] if i else ()
                row += slots[i - 2][2] if i > 1 else ()
                row += slots[i - 3][3] if i > 2 else ()
                row += slots[i + 1][4] if i + 1 < n else ()
                rows.append(row)
            score = np.stack([weights[r].sum(axis=0) for r in rows])
            ahead, behind = np.empty((n, 3)), np.zeros((n, 3))
            ahead[0] = score[0] + entry
            for i in range(1, n):
                ways = ahead[i - 1][:, None] + moves
                top = ways.max(axis=0)
                ahead[i] = score[i] + top + np.log(np.exp(ways - top).sum(axis=0))
            for i in range(n - 2, -1, -1):
                ways = moves + score[i + 1] + behind[i + 1]
                top = ways.max(axis=1)
                behind[i] = top + np.log(np.exp(ways - top[:, None]).sum(axis=1))
            last = ahead[-1].max() + np.log(np.exp(ahead[-1] - ahead[-1].max()).sum())
            error = np.exp(ahead + behind - last)
            pairs = np.zeros((3, 3))
            for i in range(1, n):
                pairs += np.exp(ahead[i - 1][:, None] + moves + score[i] + behind[i] - last)
                pairs[tags[i - 1], tags[i]] -= 1
            error[np.arange(n), tags] -= 1
            for r, e in zip(rows, error):
                if np.abs(e).max() > 1e-4:
                    g = e + decay * weights[r]
                    square_w[r] += g * g
                    weights[r] -= rate * g / np.sqrt(square_w[r])
            pairs[OUT, INSIDE] = 0
            square_m += pairs * pairs
            moves -= rate * pairs / np.sqrt(square_m)
            moves[OUT, INSIDE] = _NEVER
    return Crf(weights, moves, lexicon)


def crf_spans(model: Crf, text: str) -> list[tuple[int, int, str]]:
    """(start, end, "crf") of the spans that the field finds, in code points."""
    spans = model.tag(_TOKEN.findall(text))
    if not spans:
        return []
    at = [m.span() for m in _TOKEN.finditer(text)]
    return [(at[a][0], at[b][1], "crf") for a, b in spans]


def all_spans(model: Crf, text: str) -> tuple[list, list]:
    """Base spans, and base plus field spans; a field span inside a base span is left out."""
    base = base_spans(text)
    begins, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))

    def inside(s: tuple[int, int, str]) -> bool:
        k = bisect_right(begins, s[0])
        return k > 0 and s[1] <= reach[k - 1]

    more = [s for s in crf_spans(model, text) if not inside(s)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans`` for every row.

    Base spans always stay; the field's spans are added. Null texts count as empty; repeated rows and null ids
    are carried; extra columns are not read.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    model = model or trained()
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"

    def make():
        def work(batch: pa.RecordBatch):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = all_spans(model, text or "")
                counts = [sum(s[2] == k for s in spans) for k in KINDS]
                out.append((key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return list(zip(*out)) if out else None

        return work

    return map_slices(rows, schema, make)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]", model: Crf | None = None) -> DataFrame:
    """``docs``, all columns, with every secret in ``text_col`` replaced by ``mark``; ``length_col`` follows the new text.

    Overlapping spans are replaced as one. Null texts stay null.
    """
    model = model or trained()
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, b, _ in all_spans(model, text)[1]:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def make():
        def work(batch: pa.RecordBatch):
            columns = list(batch.columns)
            texts = [clean(t) for t in batch.column(at).to_pylist()]
            columns[at] = texts
            if size is not None:
                columns[size] = [None if t is None else len(t) for t in texts]
            return columns

        return work

    return map_slices(docs, docs.schema, make)
