"""Quality classifier by hierarchical empirical Bayes.

Two document classifiers (low quality, toxic) turn words and shape features into log-odds evidence, relative to
the base rate of their training sample. Grouped aggregation then estimates a rate for every host and for every
path below it: a host's rate shrinks toward the corpus rate and a path's toward its host's, each by a prior
strength that the spread of the observed rates themselves gives (method of moments), so sparse sites keep close
to the prior. A document's posterior is its path's prior odds times its own evidence.

Scale: the classifiers are fitted on a bounded sample of labelled rows (``sample_rows``, the only bound);
evidence, host and path statistics cover every row. Groups are aggregated with map-side combining; their table
is broadcast only when it has at most ``BROADCAST_GROUPS`` rows and is joined by shuffle otherwise.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, picked, stored, struct_of, unused

SAMPLE_ROWS = 5_000
BROADCAST_GROUPS = 50_000
#: Words that occur in fewer sampled documents have no weight; at most so many words have one.
LEAST_DOCS, MOST_WORDS = 5, 2_000
TARGETS = ("low", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
#: A document is rejected where either posterior exceeds this.
THRESHOLD = 0.5
_EVIDENCE_BOUND = 30.0


#: Lengths of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6, 8)
_LATIN = [chr(i) for i in range(256)]
_UPPER, _LETTERS, _DIGITS = (np.array([f(c) for c in _LATIN]) for f in (str.isupper, str.isalpha, str.isdigit))
_LETTERS[255] = True  # and everything beyond
_MARKS = np.array([c in "#$%&*!@~^" for c in _LATIN])


def shape(text: str, words: list[str], distinct: int) -> list[float]:
    """Features of a text's form, none of which grows with its length; ``distinct`` is the number of different words."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(np.minimum(points, 255), minlength=256)
    n, many = max(1, len(text)), max(1, len(words))
    letters, lines = int(count[_LETTERS].sum()), text.split("\n")
    return [
        count[_UPPER].sum() / max(1, letters),
        (n - letters - count[32]) / n,
        count[_MARKS].sum() / n,
        text.count("!!") / many,
        count[_DIGITS].sum() / n,
        min(20.0, letters / many) / 20,
        distinct / many**0.9,
        sum(map(eq, words[1:], words)) / many,
        1 - len(set(lines)) / len(lines),
        count[124] / many,
        1.0 / (1 + len(words)),
    ]


def kinds(words: set[str]) -> list[set[str]]:
    """Word features by kind: the distinct words, and their beginnings of each length."""
    return [words, *({w[:n] for w in words if len(w) > n} for n in PREFIXES)]


@dataclass
class Linear:
    """A logistic model over word presence and shape features."""

    words: list[dict[str, float]]
    centre: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    bias: float
    base: float

    def evidence(self, found: list[set[str]], features: list[float]) -> float:
        """Log-odds of the class beyond the sample's base rate, from :func:`kinds` and :func:`shape`."""
        score = self.bias + float(np.clip((np.array(features) - self.centre) / self.scale, -20, 20) @ self.coefficients)
        for own, weights in zip(found, self.words):
            score += sum(map(weights.__getitem__, weights.keys() & own))
        return float(min(max(score - self.base, -_EVIDENCE_BOUND), _EVIDENCE_BOUND))


def fit(docs: list[tuple[str, list[float]]], labels: np.ndarray, rounds: int = 300, ridge: float = 2e-5) -> Linear:
    """Logistic regression over documents given as their words (joined by blanks) and shape features.

    Word features are chosen by the significance of their log-odds, not by frequency. Hashed counts first leave out
    what is too rare, so the names held are few.
    """
    n, positive = len(docs), labels.astype(float)
    share = min(max(positive.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    size = len(shape("", [], 0))
    if n == 0 or positive.min() == positive.max():
        return Linear([{} for _ in range(len(PREFIXES) + 1)], np.zeros(size), np.ones(size), np.zeros(size), base, base)
    features = np.array([f for _, f in docs])
    least = min(LEAST_DOCS, max(2, n // 40))
    rough = np.zeros(1 << 22, np.int32)
    slots = [np.fromiter((zlib.crc32(w.encode()) & 0x3FFFFF for w in word_features(words)), np.int64) for words, _ in docs]
    for own in slots:
        rough[np.unique(own)] += 1
    number: dict[str, int] = {}
    held = []
    for (words, _), own in zip(docs, slots):
        names = word_features(words)
        held.append(np.array([number.setdefault(w, len(number)) for w, c in zip(names, rough[own]) if c >= least], np.int64))
    total = np.bincount(np.concatenate(held), minlength=len(number)).astype(float)
    hit = np.bincount(np.concatenate(held), weights=np.repeat(positive, [len(h) for h in held]), minlength=len(number))
    z = (hit - total * share) / np.sqrt(np.maximum(total, 1) * share * (1 - share))
    names = list(number)
    strong = sorted((i for i in np.flatnonzero((np.abs(z) > 3.5) & (total >= least))), key=lambda i: (-abs(z[i]), names[i]))[:MOST_WORDS]
    words = {names[i]: k for k, i in enumerate(strong)}
    place = np.full(len(number), -1)
    place[strong] = np.arange(len(strong))
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    both = np.zeros((n, len(words) + size + 1), np.float32)
    for i, own in enumerate(held):
        at = place[own]
        both[i, at[at >= 0]] = 1
    both[:, len(words) : -1] = np.clip((features - centre) / scale, -20, 20)
    both[:, -1] = 1
    w = np.zeros(both.shape[1], np.float32)
    w[-1] = base
    fast, mean = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -30, 30)))
        g = both.T @ (p - positive).astype(np.float32) / n
        g[:-1] += ridge * w[:-1]
        mean += 0.1 * (g - mean)
        fast += 0.01 * (g * g - fast)
        w -= 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
    by_kind: list[dict[str, float]] = [{} for _ in range(len(PREFIXES) + 1)]
    for name, k in words.items():
        kind, _, word = name.partition(" ")
        by_kind[int(kind)][word] = float(w[k])
    k = len(words)
    return Linear(by_kind, centre, scale, w[k:-1].astype(float), float(w[-1]), base)


def word_features(words: str) -> list[str]:
    """Names of the word features of words joined by blanks: the kind's number and the word."""
    return [f"{k} {w}" for k, own in enumerate(kinds(set(words.split()))) for w in own]


def _parts(text: str | None) -> tuple[list[set[str]], list[float]]:
    words = _WORD.findall((text or "").lower())
    known = set(words)
    return kinds(known), shape(text or "", words, len(known))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, Linear]:
    """Fit both classifiers on at most ``sample_rows`` labelled documents, first in hash order of the id.

    Labels with nulls are not used; several labels of one id count as their worst, of several texts the one of
    least hash is used.
    """
    usable = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL")
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = picked(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic")
    found = found.agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", "least.text", "quality", "toxic")

    def make():
        def work(batch: pa.RecordBatch):
            words = [_WORD.findall(t.lower()) for t in batch.column(1).to_pylist()]
            shapes = [shape(t, w, len(set(w))) for t, w in zip(batch.column(1).to_pylist(), words)]
            return [batch.column(0), [" ".join(sorted(set(w))) for w in words], shapes, *batch.columns[2:]]

        return work

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, words string, features array<double>, quality int, toxic int"
    seen = map_slices(found.select("doc_id", "text", F.col("quality").cast("int"), F.col("toxic").cast("int")), schema, make)
    got = sorted((r.doc_id, r.words, r.features, r.quality, r.toxic) for r in seen.toLocalIterator())
    parts = [(r[1], r[2]) for r in got]
    return {
        "low": fit(parts, np.array([r[3] == 0 for r in got], bool)),
        "toxic": fit(parts, np.array([r[4] == 1 for r in got], bool)),
    }


def with_evidence(docs: DataFrame, models: dict[str, Linear], names: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` and the log-odds evidence of each target, in the columns that ``names`` gives."""
    at = docs.columns.index(text_col)

    def make():
        def work(batch: pa.RecordBatch):
            parts = [_parts(t) for t in batch.column(at).to_pylist()]
            return [*batch.columns, *([models[k].evidence(*p) for p in parts] for k in TARGETS)]

        return work

    return map_slices(docs, struct_of(docs, ", ".join(f"`{names[k]}` double" for k in TARGETS)), make)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_rates(evidence: DataFrame, host: str, path: str, bases: dict[str, float]) -> DataFrame:
    """``host, path, low_rate, toxic_rate``: shrunk rates of every path.

    A document counts by its probability under the corpus base rate, so labels are not needed here. Null hosts
    or paths form groups of their own.
    """
    chance = {k: 1 / (1 + F.exp(-(F.col(f"{k}_evidence") + F.lit(bases[k])))) for k in TARGETS}
    paths = evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(
        F.count("*").alias("n"), *(F.sum(chance[k]).alias(k) for k in TARGETS)
    )
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(f"host_{c}") for c in ("n", *TARGETS)))
    total = hosts.agg(*(F.sum(f"host_{c}").alias(c) for c in ("n", *TARGETS))).first()
    rate = {k: min(max((total[k] or 0.0) / max(1, total.n or 0), 1e-4), 1 - 1e-4) for k in TARGETS}
    spread = hosts.agg(
        *(F.sum(F.col("host_n") * F.pow(F.col(f"host_{k}") / F.col("host_n") - rate[k], 2)).alias(k) for k in TARGETS), F.count("*").alias("groups")
    ).first()
    hosts = hosts.select("host", *(shrunk(F.col(f"host_{k}"), F.col("host_n"), F.lit(rate[k]), strength(rate[k], spread[k], spread.groups, total.n)).alias(f"host_{k}_rate") for k in TARGETS))
    below = paths.join(hosts.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    inner = below.agg(
        *(F.sum(F.col("n") * F.pow(F.col(k) / F.col("n") - F.col(f"host_{k}_rate"), 2)).alias(k) for k in TARGETS), F.count("*").alias("groups")
    ).first()
    return below.select(
        "host", "path", *(shrunk(F.col(k), F.col("n"), F.col(f"host_{k}_rate"), strength(rate[k], inner[k], inner.groups, total.n)).alias(f"{k}_rate") for k in TARGETS)
    )


def strength(rate: float, spread: float | None, groups: int, rows: int | None) -> float:
    """Prior strength in rows, from the weighted squared deviations of group rates about the prior.

    Were all groups alike, the spread would be about ``groups * rate * (1 - rate)``; what exceeds that is the
    variance between groups, and the strength is the within-row variance over it.
    """
    if not groups or not rows:
        return 1.0
    within = rate * (1 - rate)
    between = max(((spread or 0.0) - groups * within) / rows, 1e-6)
    return min(max(within / between, 10.0), 1e5)


def shrunk(total: Column, n: Column, prior: Column, weight: float) -> Column:
    """A group's rate, pulled toward its prior as if the prior were ``weight`` rows."""
    return F.least(F.greatest((total + F.lit(weight) * prior) / (n + F.lit(weight)), F.lit(1e-4)), F.lit(1 - 1e-4))


def _posteriors(rows: DataFrame, rates: DataFrame, host: str, path: str, names: dict[str, str]) -> DataFrame:
    """``rows`` with the posterior of each target in the column of its evidence."""
    groups = rates.count()
    site = {c: unused(rows, f"site_{c}") for c in rates.columns}
    keyed = rates.select(*(F.col(c).alias(new) for c, new in site.items()))
    if groups <= BROADCAST_GROUPS:
        keyed = F.broadcast(keyed)
    both = rows.join(keyed, F.col(f"`{host}`").eqNullSafe(F.col(site["host"])) & F.col(f"`{path}`").eqNullSafe(F.col(site["path"])), "left")
    for k in TARGETS:
        both = both.withColumn(names[k], 1 / (1 + F.exp(-(F.col(names[k]) + _logit(F.coalesce(F.col(site[f"{k}_rate"]), F.lit(0.5)))))))
    return both.drop(*site.values())


def _rates(evidence: DataFrame, models: dict[str, Linear], host: str, path: str, names: dict[str, str]) -> DataFrame:
    """The shrunk rates of all sites, from rows with evidence."""
    rows = picked(evidence, host=host, path=path, **{f"{k}_evidence": names[k] for k in TARGETS})
    return stored(site_rates(rows, "host", "path", {k: m.base for k, m in models.items()}), "rates")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, low_posterior, toxic_posterior, keep`` for every row.

    ``host`` and ``path`` name the columns of a site and of the part of it a document is from. Null texts are
    judged as empty ones; labels with nulls are not used; without labels of both kinds a target's evidence is 0;
    repeated rows are judged alike; extra columns are not read.
    """
    models = train(docs, labels, id_col, text_col)
    names = {k: f"{k}_evidence" for k in TARGETS}
    rows = picked(docs, doc_id=id_col, text=text_col, host=host, path=path)
    evidence = stored(with_evidence(rows, models, names).drop("text"), "evidence")
    judged = _posteriors(evidence, _rates(evidence, models, "host", "path", names), "host", "path", names)
    low, toxic = (F.col(names[k]) for k in TARGETS)
    return judged.select("doc_id", low.alias("low_posterior"), toxic.alias("toxic_posterior"), ((low <= THRESHOLD) & (toxic <= THRESHOLD)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """``docs``, all columns, without the rows that the classifier rejects; rows as in :func:`classify`.

    The rows are written once with their evidence, so every text is scored once, and the text is not shuffled.
    """
    models = train(docs, labels, id_col, text_col)
    names = {}
    for k in TARGETS:
        names[k] = unused(docs, f"{k}_evidence")
    evidence = stored(with_evidence(docs, models, names, text_col), "evidence")
    judged = _posteriors(evidence, _rates(evidence, models, host, path, names), host, path, names)
    return judged.where(F.greatest(*(F.col(names[k]) for k in TARGETS)) <= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
