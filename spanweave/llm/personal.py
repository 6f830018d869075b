"""Personal data: fixed rules, and a linear-chain conditional random field over word shapes that adds spans.

The rules find mail and IP addresses, card and phone numbers. The field finds what no pattern of characters tells:
people's names, street addresses, phone numbers in local form, and identity numbers. A token's score for a tag
sums weights of its own form and of the forms up to four tokens before and two after it; a form is a token's shape
(case, length, digits) unless the token is in a short lexicon of cues. The weights are fitted by maximising the
conditional likelihood (forward-backward) on a small labelled table, by default one of generated lines.

Decoding is Viterbi's, in batches of numpy arrays. Most tokens need none: where "outside" beats every other tag by
more than two transitions and the rest of any run of other tags could repay, every best path is outside, so the paths
between such tokens are found on their own, many at a time, and are parts of the best path.

Scale: a map over documents without shuffle or state beyond a bounded cache of words; the forms are a few hundred.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, picked

#: Kinds in the order that ties of starts take: those of the rules, then those of the field.
BASE = ("email", "ip", "card", "phone")
FIELD = ("person", "address", "contact", "identity")
KINDS = BASE + FIELD
Span = tuple[int, int, str]

# -- rules -------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A number whose first digits do not lead to a match leads to none from any later digit, so it is tried once.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Around each @: the characters before it that the rule allows, from the last match's end on, and a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, "email"
        done = max(done, at + 1)
        at = text.find("@", done)


def _small(number: str) -> bool:
    digits = number.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def luhn(digits: str) -> bool:
    """Whether digits pass the check of card numbers."""
    return sum(int(d) for d in digits[-1::-2]) % 10 == -sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]) % 10


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the rules, in code points, by start and then kind."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# -- tokens and their forms --------------------------------------------------------------------------------------

#: Runs of letters, runs of digits, and any other mark alone.
TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
#: Cues: fixed words, by what they announce; a cue of several languages stands under each.
CUES = {
    "person": "name names named called mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra nom nombre llamo appelle heiße heisse signed sincerely regards dear author contact",
    "address": "street st road rd avenue ave lane ln drive boulevard blvd court way square straße strasse weg platz allee gasse rue chemin impasse quai calle avenida plaza paseo camino apt flat lives living live address adresse dirección wohnt habite vive",
    "contact": "phone phones telephone tel mobile cell fax call text sms whatsapp dial reach ring telefon telefonnummer handy rufnummer téléphone portable teléfono móvil llama",
    "identity": "ssn passport id identity licence license driver social security insurance tax taxpayer iban account member patient employee ausweis personalausweis reisepass steuernummer konto passeport carte identité sécurité sociale compte dni nie pasaporte cuenta identidad",
    "plain": "of no number nr num is are was to the on in from and or for my his her their me we i page version order section chapter isbn total price score table line step item amount build port code numéro número nummer es ist est der die das la le el de du von und et y",
}
LEXICON = frozenset(w for words in CUES.values() for w in words.split())
_KIND_OF = {w: kind for kind, words in reversed(CUES.items()) for w in words.split()}
#: Marks with forms of their own.
_MARKS = frozenset(".,:;()[]-/+@#'\"|=$€%&*!?_")
BEFORE, AFTER = 4, 2
CACHE_WORDS = 200_000


def form_of(word: str) -> str:
    """The form of a token: all that scores depend on. There are a few hundred."""
    low = word.lower()
    if low in LEXICON:
        return f"{'Aa'[word[0].islower()]}={low}"
    if word[0].isdigit():
        return f"9:{min(len(word), 20)}"
    if word[0].isalpha():
        case = "a" if word.islower() else "A" if word.isupper() else "Aa" if word[0].isupper() and word[1:].islower() else "aA"
        return f"{case}:{min(len(word), 12)}:{word.isascii()}"
    return word if word in _MARKS else "mark"


def again(words: list[str]) -> list[int]:
    """The places of words that equal the word before; their tokens have a form of their own."""
    return [k for k, same in enumerate(map(eq, words, islice(words, 1, None)), 1) if same]


def forms_of(text: str) -> list[str]:
    """The forms of a text's tokens; no token has white space in it."""
    words = text.split()
    found = [[form_of(w) for w in TOKEN.findall(word)] for word in words]
    for k in again(words):
        found[k] = ["again"] * len(found[k])
    return list(chain.from_iterable(found))


def _features(form: str) -> list[str]:
    """What a form tells: itself and coarser classes."""
    if form == "again":
        return [form]
    if "=" in form[1:]:
        case, _, low = form.partition("=")
        return [form, low, f"cue={_KIND_OF[low]}", f"case={case}"]
    if form[:2] == "9:":
        n = int(form[2:])
        return [form, "digits", f"digits={'1' if n < 2 else '2' if n < 3 else '3-5' if n < 6 else '6-9' if n < 10 else '10-'}"]
    if ":" in form[1:]:
        case, n, plain = form.split(":")
        return [form, "letters", f"case={case}", f"case={case}:{min(int(n), 3)}", f"ascii={plain}", f"size={int(n) // 3}"]
    return [form, "mark"]


def _tags() -> list[str]:
    return ["O"] + [f"{b}-{kind}" for kind in FIELD for b in "BI"]


TAGS = _tags()
_NEVER = -1e4
#: What no path may do: go inside a kind other than from its begin or inside.
_BARRED = np.array([[b[0] == "I" and a[1:] != b[1:] for b in TAGS] for a in TAGS])


# -- the field ---------------------------------------------------------------------------------------------------


class _Words(dict):
    """The forms of each word, learnt at first sight."""

    def __init__(self, learn: Callable[[str], tuple[int, ...]]):
        self.learn = learn

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = found = self.learn(word)
        return found


class Field:
    """Weights by place (four tokens before to two after), feature and tag, and between tags."""

    def __init__(self, features: list[str], weights: np.ndarray, moves: np.ndarray):
        self.features = {f: k for k, f in enumerate(features)}
        self.weights, self.moves = weights, moves
        real = moves[~_BARRED]
        self.spread = float(real.max() - real.min()) + 1e-4
        self.clear()

    def __getstate__(self):
        return list(self.features), self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def clear(self) -> None:
        """Forget words: the numbers of the forms of each one's tokens, and the forms' scores; 0 is between texts."""
        self.words = _Words(self._learn)
        self.forms = {"": 0}
        #: By place, tag and form: how far the tag exceeds "outside".
        self.parts = np.zeros((BEFORE + 1 + AFTER, len(TAGS), 1), np.float32)

    def _learn(self, word: str) -> tuple[int, ...]:
        return tuple([self._number(form_of(w)) for w in TOKEN.findall(word)])

    def _number(self, form: str) -> int:
        if form not in self.forms:
            self.forms[form] = len(self.forms)
            has = [self.features[f] for f in _features(form) if f in self.features]
            own = self.weights[:, has].sum(axis=1)
            self.parts = np.concatenate([self.parts, (own - own[:, :1])[:, :, None].astype(np.float32)], axis=2)
        return self.forms[form]

    def numbers(self, text: str) -> list[int]:
        """The numbers of the forms of a text's tokens; no token has white space, so words are looked up whole."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = text.split()
        found = list(map(self.words.__getitem__, words))
        for k in again(words):
            found[k] = (self._number("again"),) * len(found[k])
        return list(chain.from_iterable(found))

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        """How far all tags (rows) exceed "outside" at every token of a run that begins and ends between texts."""
        out = np.zeros((len(TAGS), len(numbers)), np.float32)
        for k, part in enumerate(self.parts):
            shift = k - BEFORE
            lo, hi = max(0, -shift), len(numbers) - max(0, shift)
            near = numbers[lo + shift : hi + shift]
            for row, of in zip(out[1:], part[1:]):
                row[lo:hi] += of.take(near)
        out[1:, numbers == 0] = _NEVER
        return out

    def paths(self, numbers: np.ndarray) -> np.ndarray:
        """The best tag of every token of a run that begins and ends between texts, where it is outside."""
        scores = self.scores(numbers)
        doubt = np.maximum(scores[1:].max(axis=0), -64.0).astype(np.float64)
        # What a run of other tags from a token on can gain over "outside" at most: a reversed sum less its least.
        gain = np.cumsum(doubt[::-1] + self.spread)
        gain = np.maximum(gain - np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]])), 0)[::-1]
        turn = np.maximum((scores[2::2] - scores[1::2]).max(axis=0), 0) + self.spread
        doubt[:-1] += np.minimum(gain[1:], turn[1:])
        open_ = np.flatnonzero((doubt >= -2 * self.spread) & (numbers > 0))
        tags = np.zeros(len(numbers), np.int8)
        if len(open_):
            scores = scores[:, open_].T.astype(np.float64)
            cuts = np.flatnonzero(np.diff(open_) > 1) + 1
            first = np.concatenate([[0], cuts])
            size = np.concatenate([cuts, [len(open_)]]) - first
            # A run of n other tags has n + 1 transitions to gain from: some token of it must be within two of "outside".
            hope = np.maximum.reduceat(scores[:, 1:].max(axis=1), first) >= -2 * self.spread
            first, size = first[hope], size[hope]
            order = np.argsort(size, kind="stable")
            found, at = np.zeros(len(open_), np.int8), 0
            while at < len(order):
                # Stretches of like length together: at most twice as long as the first, and a bounded table.
                least = int(size[order[at]])
                end = at + int(np.searchsorted(size[order[at:]], 2 * least, "right"))
                part = order[at : min(end, at + max(1, (1 << 16) // (2 * least)))]
                self._decode(scores, first[part], size[part], found)
                at += len(part)
            tags[open_] = found
        return tags

    def _decode(self, scores: np.ndarray, first: np.ndarray, size: np.ndarray, tags: np.ndarray) -> None:
        """Viterbi over stretches with outside on both sides, all at once; a finished one waits for the others."""
        longest = int(size.max())
        moves = self.moves
        best = scores[first] + moves[0]
        back = np.zeros((longest, len(first), len(TAGS)), np.int8)
        same = np.arange(len(TAGS), dtype=np.int8)
        for t in range(1, longest):
            on = t < size
            ways = best[:, :, None] + moves
            back[t] = np.where(on[:, None], ways.argmax(axis=1), same)
            best = np.where(on[:, None], ways.max(axis=1) + scores[np.minimum(first + t, len(scores) - 1)], best)
        tag = (best + moves[:, 0]).argmax(axis=1)
        rows = np.arange(len(first))
        for t in range(longest - 1, -1, -1):
            on = t < size
            tags[first[on] + t] = tag[on]
            tag = back[t][rows, tag]

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """(start, end, kind) of the field's spans in each text, in code points."""
        gap = [0] * BEFORE
        numbers, begins = list(gap), []
        for text in texts:
            begins.append(len(numbers))
            numbers += self.numbers(text)
            numbers += gap
        tags = self.paths(np.array(numbers, np.int64))
        found: list[list[Span]] = [[] for _ in texts]
        held: dict[int, list[tuple[int, int, str]]] = {}
        for i in np.flatnonzero(tags % 2 == 1).tolist():
            j, inside = i + 1, tags[i] + 1
            while tags[j] == inside:
                j += 1
            k = bisect_right(begins, i) - 1
            held.setdefault(k, []).append((i - begins[k], j - begins[k] - 1, FIELD[tags[i] // 2]))
        for k, spans in held.items():
            at = [m.span() for m in TOKEN.finditer(texts[k])]
            found[k] = [(at[a][0], at[b][1], kind) for a, b, kind in spans]
        return found


# -- the labelled table ------------------------------------------------------------------------------------------

#: Frames of labelled lines; a slot in braces is filled and, if it names a kind, labelled.
FRAMES = (
    "my name is {person} and i live at {address} .", "i am called {person} , phone {phone} .", "Dear {person} ,", "Mr. {person} {said} {prose}", "{prose} Mrs. {person} {prose}",
    "Name: {person} | Address: {address} | Tel: {phone}", "contact: {person} ( {phone} )", "signed , {person}", "Dr. {person} wrote {prose}", "{prose} call {phone} {prose}",
    "phone number is {phone} .", "Phone: {phone}", "mobile {phone} , fax {phone}", "tel. {phone}", "{prose} text me on {phone} {prose}", "ring {person} at {phone}",
    "SSN {identity} {prose}", "passport no. {identity} .", "social security number: {identity}",
    "driver license {identity} {prose}", "{prose} tax id {identity} {prose}", "IBAN {iban} {prose}", "account {iban} .", "patient id: {identity}", "{prose} lives at {address} {prose}",
    "address: {address}", "{prose} {address} , {prose}", "Ich heiße {person} und wohnt {address} .", "Herr {person} {prose}", "Frau {person} {prose}", "Telefon: {phone}", "Handy {phone} .",
    "Reisepass {identity} .", "Adresse: {address}", "je m'appelle {person} {prose}", "Madame {person} , {address}", "téléphone {phone} {prose}", "passeport {identity}", "habite {address} .",
    "me llamo {person} {prose}", "Señor {person} {prose}", "teléfono {phone} .", "DNI {identity} {prose}", "vive en {address} .", "nombre: {person}",
    "{prose}", "{prose} {prose}", "{prose} {prose}", "{prose} {prose}", "{prose} {prose}", "{prose} {prose} {prose}", "{many}", "{many} {many}", "{prose} at {prose} at {prose}", "At {prose} at {word} . {prose}", "{prose} {many} {prose}", "{many} {prose}", 'token = "{hex}" {prose}', "secret: {hex}", "TOKEN = {hex}", "{prose} {plain} {prose}", "{prose} {plain} {prose}", "{prose} {plain} , {plain} {prose}", "{Title} {Title} {Title}",
    "the name of the {word} is {prose}", "call the {word} {prose}", "the phone was {prose}", "{prose} in the street {prose}", "the passport of {prose}", "on the road to {prose}", "order {number} {prose}",
    "version {plain} of {prose}", "page {number} of {number}", "ISBN {isbn}", "call {word} ( {number} ) {prose}", "id of the {word} : {word}", "{word} | {word} | {plain} | {word}", "my {word} is {word} .",
    "{prose} {mail} {prose}", "{prose} {ip} {prose}", "{prose} {long} {prose}", "{prose} {international} {prose}", "score {number} - {number} .", "social security is {prose}", "at {word} dot {prose}",
)
_SYLLABLES = "the and ing er on re de la ti en st ou ment ver ein que os chen è ü ñ ka mi lo ra nu".split()


def labelled_lines(seed: int, count: int, frames: tuple[str, ...] = FRAMES) -> list[tuple[str, list[Span]]]:
    """(text, spans) of generated lines: frames filled with invented words and numbers."""
    rng = random.Random(seed)
    plain_words, cue_words = CUES["plain"].split() + ["at", "square", "contact"], sorted(LEXICON)

    def digits(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    def word() -> str:
        return "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))

    def name() -> str:
        return word().capitalize()

    def prose() -> str:
        said = [word() for _ in range(rng.randint(2, 9))]
        for k in range(len(said)):
            turn = rng.random()
            said[k] = rng.choice(plain_words if turn < 0.12 else cue_words) if turn < 0.15 else said[k]
            turn = rng.random()
            said[k] = said[k].capitalize() if turn < 0.15 else said[k].upper() if turn < 0.18 else said[k]
            if k and said[k - 1][-1] in ".!":
                said[k] = said[k].capitalize()
            said[k] += rng.choices(["", ".", ",", "!!", " |", ":", "%%%", "###"], [30, 4, 3, 1, 1, 1, 1, 1])[0]
        return " ".join(said)

    def many() -> str:
        said = rng.choice([word(), name(), rng.choice(plain_words).capitalize(), rng.choice(cue_words).capitalize(), rng.choice(plain_words)]) + rng.choice(["", "", ",", "."])
        return " ".join([said] * rng.choice([3, 6, 12]))

    def phone() -> str:
        return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}", f"0{digits(1)} " + " ".join(digits(2) for _ in range(4)), f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)}/{digits(6)}", digits(rng.choice([7, 9, 10]))])

    def address() -> str:
        kind, number = rng.choice(["Street", "St.", "Road", "Avenue", "Lane", "Drive", "Court", "Way", "Square"]), str(rng.randint(1, 999))
        line = rng.choice([f"{number} {name()} {kind}", f"{number} {name()} {name()} {kind}", f"{name()} {rng.choice(['Straße', 'Weg', 'Platz', 'Allee'])} {number}", f"{number}, rue {rng.choice(['de ', 'du ', ''])}{name()}", f"{rng.choice(['Calle', 'Avenida', 'Plaza'])} {name()} {number}"])
        return line + rng.choice(["", "", f", {digits(5)} {name()}"])

    def identity() -> str:
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{rng.choice('ABCXYZ')}{digits(rng.choice([6, 7, 8]))}", f"{rng.choice(['AB', 'QX', 'KL'])}{digits(6)}", digits(rng.choice([8, 9, 10, 11])), f"{digits(8)}{rng.choice('ABCXYZ')}"])

    fill: dict[str, Callable[[], str]] = {
        "person": lambda: " ".join(name() for _ in range(rng.choice([1, 2, 2, 2, 3]))) if rng.random() < 0.85 else f"{name()} {rng.choice('ABCDEFGH')}. {name()}",
        "phone": phone, "address": address, "identity": identity,
        "iban": lambda: f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)} " + " ".join(digits(4) for _ in range(rng.choice([4, 5]))),
        "prose": prose, "many": many, "hex": lambda: "".join(rng.choices(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), k=rng.choice([32, 40]))), "word": word, "Title": name, "said": lambda: rng.choice(["said", "wrote", "was", word()]), "number": lambda: digits(rng.randint(1, 6)),
        "plain": lambda: rng.choice([digits(rng.randint(1, 10)), f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)} %", f"{word()}_{word()}", f"({digits(4)})", f"{digits(3)}-{digits(3)}"]),
        "isbn": lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", "mail": lambda: f"{word()}.{digits(2)}@{word()}.com", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "long": lambda: digits(rng.choice([14, 15, 16, 16, 18])), "international": lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
    }
    kind_of = {"person": "person", "phone": "contact", "address": "address", "identity": "identity", "iban": "identity", "international": "contact"}
    made = []
    for k in range(count):
        text, spans = "", []
        for piece in re.split(r"(\{\w+\})", frames[k % len(frames)]):
            said = fill[piece[1:-1]]() if piece[:1] == "{" else piece
            if kind := kind_of.get(piece[1:-1]):
                spans.append((len(text), len(text) + len(said), kind))
            text += said
        made.append((text, spans))
    return made


def labelled_table(spark: SparkSession, seed: int = 11, count: int = 2_400) -> DataFrame:
    """``text, spans`` (start, end, kind; code points): the small table that the field learns from unless given another."""
    return spark.createDataFrame(labelled_lines(seed, count), "text string, spans array<struct<start:int,end:int,kind:string>>")


#: Rows of a labelled table that are learnt from: a bound of the sample, the first by text.
LABELLED_ROWS = 5_000


def trained(labelled: DataFrame) -> Field:
    """The field of a labelled table (``text, spans``), of which at most ``LABELLED_ROWS`` rows are read."""
    rows = labelled.where("text IS NOT NULL").orderBy("text").limit(LABELLED_ROWS).collect()
    return fitted(tuple((r.text, tuple(tuple(s) for s in r.spans or ())) for r in rows))


@lru_cache(maxsize=4)
def fitted(lines: tuple, seed: int = 7, rounds: int = 10, batch: int = 64, rate: float = 0.08, decay: float = 5e-4) -> Field:
    """Steps of Adam on the negative conditional log-likelihood of batches of labelled lines."""
    rows, marks = [], []
    for text, spans in lines:
        tokens = [(m[0], m.start()) for m in TOKEN.finditer(text)]
        tags = [0] * len(tokens)
        for start, end, kind in spans:
            inside = [k for k, (_, at) in enumerate(tokens) if start <= at < end]
            for k in inside:
                tags[k] = TAGS.index(f"{'B' if k == inside[0] else 'I'}-{kind}")
        if tokens:
            rows.append(forms_of(text))
            marks.append(tags)
    forms = {f: k + 1 for k, f in enumerate(sorted({f for r in rows for f in r}))}
    features = sorted({x for f in forms for x in _features(f)})
    number = {f: k for k, f in enumerate(features)}
    has = np.zeros((len(forms) + 1, len(features)))
    for f, k in forms.items():
        has[k, [number[x] for x in _features(f)]] = 1
    places, tags = BEFORE + 1 + AFTER, len(TAGS)
    weights, moves = np.zeros((places, len(features), tags)), np.where(_BARRED, _NEVER, 0.0)
    held = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    order, step = random.Random(seed), 0
    by_length = sorted(range(len(rows)), key=lambda k: (len(rows[k]), k))
    batches = [by_length[at : at + batch] for at in range(0, len(rows), batch)]
    for turn in range(rounds):
        order.shuffle(batches)
        for part in batches:
            size = np.array([len(rows[k]) for k in part])
            longest, many = int(size.max()), len(part)
            idx, gold = np.zeros((many, longest + BEFORE + AFTER), np.int64), np.zeros((many, longest), np.int64)
            for i, k in enumerate(part):
                idx[i, BEFORE : BEFORE + size[i]] = [forms[f] for f in rows[k]]
                gold[i, : size[i]] = marks[k]
            on = np.arange(longest) < size[:, None]
            parts = has @ weights
            score = sum(parts[k][idx[:, k : k + longest]] for k in range(places))
            ahead, behind = np.zeros((longest, many, tags)), np.zeros((longest, many, tags))

            def summed(ways: np.ndarray, axis: int) -> np.ndarray:
                top = ways.max(axis=axis)
                return top + np.log(np.exp(ways - np.expand_dims(top, axis)).sum(axis=axis))

            ahead[0] = score[:, 0] + moves[0]
            for t in range(1, longest):
                ahead[t] = np.where(on[:, t, None], summed(ahead[t - 1][:, :, None] + moves, 1) + score[:, t], ahead[t - 1])
            total = summed(ahead[-1] + moves[:, 0], 1)
            behind[-1] = moves[:, 0]
            for t in range(longest - 2, -1, -1):
                behind[t] = np.where(on[:, t + 1, None], summed(moves + (score[:, t + 1] + behind[t + 1])[:, None], 2), behind[t + 1])
            error = np.exp(ahead + behind - total[:, None]).transpose(1, 0, 2) * on[:, :, None]
            pairs = np.zeros((tags, tags))
            for t in range(1, longest):
                both = np.exp(ahead[t - 1][:, :, None] + moves + (score[:, t] + behind[t])[:, None] - total[:, None, None])
                pairs += (both * on[:, t, None, None]).sum(axis=0)
            # Transitions from and to the outside at both ends.
            pairs[0] += error[:, 0].sum(axis=0)
            pairs[:, 0] += error[np.arange(many), size - 1].sum(axis=0)
            np.subtract.at(error, (*np.nonzero(on), gold[on]), 1)
            edge = np.concatenate([np.zeros((many, 1), np.int64), gold, np.zeros((many, 1), np.int64)], axis=1)
            steps = np.arange(longest + 1) <= size[:, None]
            np.subtract.at(pairs, (edge[:, :-1][steps], edge[:, 1:][steps]), 1)
            grad = np.zeros((places, len(forms) + 1, tags))
            for k in range(places):
                np.add.at(grad[k], idx[:, k : k + longest][on], error[on])
            grads = [(has.T @ grad) / many + decay * weights, np.where(_BARRED, 0, pairs / many + decay * moves)]
            step += 1
            for p, g, (m, v) in zip((weights, moves), grads, held):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate / (1 + turn / 3) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(features, weights, moves)


# -- operators ---------------------------------------------------------------------------------------------------

#: Tokens that are decoded at a time, about: a batch ends with the text that passes it.
BATCH_CHARS = 200_000


def all_spans(field: Field, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Of each text its base spans, and base plus field spans; a field span that meets a base span is left out."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and chars < BATCH_CHARS:
            chars += len(texts[end])
            end += 1
        for text, more in zip(texts[at:end], field.spans(texts[at:end])):
            base = base_spans(text)
            if base and more:
                edges = sorted(base)
                reach = np.maximum.accumulate([b for _, b, _ in edges]).tolist()
                starts = [a for a, _, _ in edges]
                more = [s for s in more if (k := bisect_right(starts, s[1] - 1)) == 0 or reach[k - 1] <= s[0]]
            yield base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
        at = end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id``, counts of each kind, ``base_sha256, spans`` and ``found`` (start, end, kind) for every row.

    Base spans always stay; the field's are added. Null texts count as empty; repeated rows and null ids are carried;
    extra columns are not read; an empty table gives no rows.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    field = trained(labelled_table(docs.sparkSession) if labelled is None else labelled)
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string, found array<struct<start:int,end:int,kind:string>>"

    def make() -> Callable[[pa.RecordBatch], list | None]:
        def work(batch: pa.RecordBatch) -> list | None:
            out = []
            for base, spans in all_spans(field, [t or "" for t in batch.column(1).to_pylist()]):
                kinds = [s[2] for s in spans]
                told = [{"start": a, "end": b, "kind": kind} for a, b, kind in spans]
                out.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), told))
            return [batch.column(0), *zip(*out)] if out else None

        return work

    return map_slices(rows, schema, make)


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, with every span in ``text_col`` replaced by its kind in brackets; ``length_col`` follows.

    Overlapping spans are replaced as one, by the first one's kind. Null texts stay null.
    """
    field = trained(labelled_table(docs.sparkSession) if labelled is None else labelled)
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else None

    def make() -> Callable[[pa.RecordBatch], list]:
        def work(batch: pa.RecordBatch) -> list:
            columns = list(batch.columns)
            texts = batch.column(at).to_pylist()
            clean = []
            for text, (_, spans) in zip(texts, all_spans(field, [t or "" for t in texts])):
                out, done = [], 0
                for a, b, kind in spans:
                    if a >= done:
                        out += [(text or "")[done:a], f"[{kind.upper()}]"]
                    done = max(done, b)
                clean.append(None if text is None else "".join([*out, text[done:]]))
            columns[at] = clean
            if size is not None:
                columns[size] = [None if t is None else len(t) for t in clean]
            return columns

        return work

    return map_slices(docs, docs.schema, make)


def counts_by_kind(found: DataFrame) -> DataFrame:
    """``kind, n_docs, n_spans`` over the rows of :func:`scan`."""
    spans = found.select(F.monotonically_increasing_id().alias("row"), F.explode("found.kind").alias("kind"))
    return spans.groupBy("kind").agg(F.countDistinct("row").alias("n_docs"), F.count("*").alias("n_spans"))
