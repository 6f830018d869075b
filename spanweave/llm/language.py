"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Each text is cut into windows of ``STEPS`` bytes that run in lockstep through a forward and a backward gated
recurrent unit; both states at a byte give that byte's label probabilities, and a document's probability is the
mean over all its bytes. The network is trained here in numpy by backpropagation through time on a bounded
sample of labelled documents.

Scale: scoring is a map over documents; the weights are a few kilobytes. Training reads at most
``per_language`` documents of every label (the documented bound of the sample).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import map_slices, picked

STEPS = 64
HIDDEN = 8
BLOCK = 2048
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """labels; for each direction input rows (256, 3H) and recurrent weights (H, 3H); output (2H, L) and bias."""

    labels: list[str]
    inputs: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def _run(self, d: int, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, N, H) of direction ``d`` over byte rows (T, N), in the order of time."""
        hidden = self.out.shape[0] // 2
        gates, h = 2 * hidden, np.zeros((steps.shape[1], hidden), np.float32)
        w, u = self.inputs[d], self.state[d]
        states = np.empty((*steps.shape, hidden), np.float32)
        for t in range(len(steps) - 1, -1, -1) if d else range(len(steps)):
            x = w[steps[t]]
            zr = _sigmoid(x[:, :gates] + h @ u[:, :gates])
            z, r = zr[:, :hidden], zr[:, hidden:]
            rh = r * h
            n = 2 * _sigmoid(2 * (x[:, gates:] + rh @ u[:, gates:])) - 1
            if keep is not None:
                keep.append((t, h, z, r, n))
            h = n + z * (h - n)
            states[t] = h
        return states

    def probabilities(self, steps: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities (T, N, L) of every byte, and the states they come from."""
        both = np.concatenate([self._run(d, steps, None if keep is None else keep[d]) for d in (0, 1)], axis=2)
        scores = both @ self.out + self.bias
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True), both

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text (zeros for an empty one); the last window is filled with blanks, as in training."""
        sizes = np.array([len(t) for t in texts], np.int64)
        rows = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), rows)
        grid = np.full((len(owner), STEPS), 32, np.uint8)
        seen = np.full(len(owner), STEPS, np.int64)
        last = np.cumsum(rows)
        for k, t in enumerate(texts):
            if t:
                a, b = last[k] - rows[k], last[k]
                grid[a:b].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
                seen[b - 1] = len(t) - (rows[k] - 1) * STEPS
        total = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(owner), BLOCK):
            own = owner[at : at + BLOCK]
            p = self.probabilities(np.ascontiguousarray(grid[at : at + BLOCK].T))[0]
            inside = np.arange(STEPS)[:, None] < seen[at : at + BLOCK]
            sums = (p * inside[:, :, None]).sum(axis=0, dtype=np.float64)
            np.add.at(total, own, sums)
        return total / np.maximum(sizes, 1)[:, None]


def train(texts: list[bytes], labels: list[str], seed: int = 11, windows: int = 4096, rounds: int = 5, batch: int = 128, rate: float = 0.02) -> Network:
    """Fit a network on windows drawn evenly from the labels, by backpropagation through time and Adam steps."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    h, count = HIDDEN, len(names)
    net = Network(
        names,
        rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, count)).astype(np.float32),
        np.zeros(count, np.float32),
    )
    if not names:
        return net
    pools = [[t for t, k in zip(texts, labels) if k == name and t] for name in names]
    data, target = [], []
    for k, pool in enumerate(pools):
        for _ in range(-(-windows // count) if pool else 0):
            t = pool[rng.integers(len(pool))]
            at = int(rng.integers(max(1, len(t) - STEPS + 1)))
            data.append(np.frombuffer(t[at : at + STEPS].ljust(STEPS, b" "), np.uint8))
            target.append(k)
    if not data:
        return net
    data, target = np.stack(data), np.array(target)
    params = [net.inputs, net.state, net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads = _gradients(net, np.ascontiguousarray(data[pick].T), target[pick])
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _gradients(net: Network, steps: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over all bytes, back through both directions of time."""
    kept: list[list] = [[], []]
    p, both = net.probabilities(steps, kept)
    hidden = net.out.shape[0] // 2
    gates = 2 * hidden
    error = p.copy()
    error[:, np.arange(len(target)), target] -= 1
    error /= error.shape[0] * error.shape[1]
    g_out = np.einsum("tnh,tnl->hl", both, error)
    back = error @ net.out.T
    g_in, g_state = np.zeros_like(net.inputs), np.zeros_like(net.state)
    for d in (0, 1):
        u, carry = net.state[d], np.zeros((steps.shape[1], hidden), np.float32)
        for t, h, z, r, n in reversed(kept[d]):
            g = carry + back[t, :, d * hidden : (d + 1) * hidden]
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (h - n) * z * (1 - z)
            drh = dn @ u[:, gates:].T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            g_state[d][:, :gates] += h.T @ dzr
            g_state[d][:, gates:] += (r * h).T @ dn
            np.add.at(g_in[d], steps[t], np.concatenate([dzr, dn], axis=1))
            carry = g * z + drh * r + dzr @ u[:, :gates].T
    return [g_in, g_state, g_out, error.sum(axis=(0, 1))]


def held_out(id_col: str):
    """True where the document's fold (crc32 of the id as text, modulo 5) is the one kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled texts outside the held-out fold: the first ids of each label in hash order.

    Of repeated rows of an id and label the text of least hash is taken.
    """
    rows = picked(docs, doc_id=id_col, text=text_col, lang=lang_col)
    usable = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("lang", "doc_id").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    found = usable.join(F.broadcast(chosen.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi")
    least = found.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    got = sorted((r.lang, r.doc_id, r.text) for r in least.select("lang", "doc_id", "least.text").collect())
    return [t.encode() for _, _, t in got], [k for k, _, _ in got]


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or nothing was learned;
    repeated rows and null ids are carried; extra columns are not read.
    """
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", held_out("doc_id").alias("held_out"), "text")

    def make():
        def work(batch: pa.RecordBatch):
            texts = [t if t and _LETTER.search(t) else "" for t in batch.column(2).to_pylist()]
            if not net.labels:
                return [batch.column(0), batch.column(1), [UNKNOWN] * len(texts), [0.0] * len(texts)]
            p = net.documents([t.encode() for t in texts])
            best = p.argmax(axis=1)
            names = [net.labels[k] if t else UNKNOWN for k, t in zip(best, texts)]
            return [batch.column(0), batch.column(1), names, np.clip(p[np.arange(len(p)), best], 0, 1).tolist()]

        return work

    return map_slices(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double", make)


def detect_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> DataFrame:
    """Train on a bounded sample of every label's rows, at least 1,024 windows each, and label every row."""
    texts, labels = sample(docs, id_col, text_col, lang_col, per_language)
    return identify(docs, train(texts, labels, windows=1024 * max(4, len(set(labels)))), id_col, text_col)
