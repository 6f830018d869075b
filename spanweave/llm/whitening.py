"""Whitening of embeddings by their exact covariance.

Entries become whole numbers, ``floor(scale * c) + offset``. A task subtracts a shift, cuts what is left into digits of
16 bits, multiplies blocks of digits as doubles whose sums stay below 2**53, and adds the products as Python's whole
numbers, so sums and cross-products are exact at any size. Their scatter, n XᵀX - SSᵀ, is formed exactly as well (it
does not depend on the shift); only then is it turned into doubles and decomposed by ``eigh``. Components that are far
below the largest are decomposed again from the exact scatter seen through them, since one decomposition gives them an
error of the largest one's size.

Scale: a task sends its sums once, as digits of 32 bits that Spark adds up by place (one row a pair of dimensions and
digit, whatever the task's rows); vectors are never shuffled. The driver holds matrices of the dimension squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanweave.llm.common import map_slices, picked, release

SCALE, OFFSET, MOST = 64, 1_000_000, 32
#: Entries beyond this stop there, so that they stay whole numbers of 64 bits.
LIMIT = 1 << 61
#: Rows multiplied at a time: 2**20 products of two digits of 16 bits stay below 2**53.
BLOCK_ROWS, DIGIT = 1 << 12, 16
#: A component this far below the largest is decomposed again; a prime for ranks.
FAR, PRIME = 1e-7, (1 << 31) - 1


@dataclass
class Whitening:
    """n vectors, their exact sums less n shifts, and what their covariance decomposes into, largest first.

    ``values`` past the rank are zero: all vectors agree in those directions. ``error`` is the largest entry of the
    whitened vectors' covariance minus the identity, over the components ``most`` that have any spread.
    """

    n: int
    shift: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there, has entries, and only finite ones."""
    v = F.col(f"`{vector_col}`")
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))))


def whole(column: pa.Array, width: int, scale: int = SCALE, offset: int = OFFSET, shift: int = 0) -> np.ndarray:
    """The vectors of a list column as whole numbers less ``shift``, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(flat * scale), -float(LIMIT), float(LIMIT))
    return (scaled.astype(np.int64) + (offset - shift)).reshape(-1, width)


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits of 16 bits, lowest first, as doubles."""
    out = []
    while x.any() or not out:
        low = (x + (1 << DIGIT - 1) & (1 << DIGIT) - 1) - (1 << DIGIT - 1)
        out.append(low.astype(np.float64))
        x = x - low >> DIGIT
    return out


def cross(x: np.ndarray) -> np.ndarray:
    """The exact cross-products of the columns, as Python's whole numbers."""
    digits = _digits(x)
    total = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) << DIGIT * (i + j)
    return total


def scatter(rows: DataFrame, width: int, scale: int = SCALE, offset: int = OFFSET, shift: int = OFFSET) -> tuple[int, list[int], np.ndarray]:
    """n, the sums less n shifts, and n XᵀX - SSᵀ, all exact, of the one list column of ``rows``."""
    schema = T._parse_datatype_string("i int, j int, place int, digit long")
    arrow = to_arrow_schema(schema)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = whole(batch.column(0).slice(at, BLOCK_ROWS), width, scale, offset, shift)
                count += len(x)
                sums += sum(d.sum(axis=0).astype(np.int64).astype(object) << DIGIT * k for k, d in enumerate(_digits(x)))
                products += cross(x)
        if count:
            i = np.concatenate([upper[0], np.arange(width), [-1]])
            j = np.concatenate([upper[1], np.full(width, -1), [-1]])
            left, place = np.concatenate([products[upper], sums, np.array([count], object)]), 0
            while left.any():
                low = (left + (1 << 31) & (1 << 32) - 1) - (1 << 31)
                has = np.flatnonzero(low)
                columns = (i[has], j[has], np.full(len(has), place), low[has].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)
                left, place = left - low >> 32, place + 1
        release()

    added = rows.mapInArrow(run, schema).groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    n, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for i, j, place, digit in added.collect():  # the square of the width, times the digits of a number
        value = digit << 32 * place
        if i < 0:
            n += value
        elif j < 0:
            sums[i] += value
        else:
            products[i, j] += value
            if i != j:
                products[j, i] += value
    s = np.array(sums, object)
    return n, sums, n * products - np.outer(s, s)


def _rank(m: np.ndarray) -> int:
    """The rank of a matrix of whole numbers modulo a prime: the rank itself but for a chance of about 1e-9."""
    rows, rank = (m % PRIME).astype(np.int64), 0
    for k in range(rows.shape[1]):
        pivot = rank + np.flatnonzero(rows[rank:, k])[:1]
        if len(pivot):
            rows[[rank, pivot[0]]] = rows[[pivot[0], rank]]
            rows[rank] = rows[rank] * pow(int(rows[rank, k]), -1, PRIME) % PRIME
            rows[rank + 1 :] = (rows[rank + 1 :] - rows[rank + 1 :, k : k + 1] * rows[rank] % PRIME) % PRIME
            rank += 1
    return rank


def _through(m: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The matrix seen through some directions, from the whole numbers nearest to 2**60 times their entries."""
    whole = np.rint(directions * 2.0**60).astype(np.int64).astype(object)
    return whole.T @ m @ whole


def _eigen(m: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of an exact matrix over a whole number, largest first."""
    values, vectors = np.linalg.eigh((m / below).astype(np.float64))
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    far = int(np.count_nonzero(values >= FAR * values[0]))
    if 0 < far < len(values):
        values[far:], turn = _eigen(_through(m, vectors[:, far:]), below << 120)
        vectors[:, far:] = vectors[:, far:] @ turn
    return values, vectors


def decomposed(n: int, shift: int, sums: list[int], m: np.ndarray, most: int = MOST) -> Whitening:
    """The whitening of an exact scatter."""
    values, vectors = _eigen(m, n * n)
    rank = min(_rank(m), int(np.count_nonzero(values > 0)))
    values[rank:] = 0
    kept = min(rank, most)
    error = 0.0
    if kept:
        seen = (_through(m, vectors[:, :kept]) / (n * n << 120)).astype(np.float64)
        root = np.sqrt(values[:kept])
        error = float(np.abs(seen / root / root[:, None] - np.eye(kept)).max())
    return Whitening(n, shift, sums, values[:most], vectors[:, :most], float(sum(m.diagonal()) / (n * n)), error)


def width_of(rows: DataFrame) -> int:
    """The width that most vectors have, of equally frequent ones the larger; 0 where there is none."""
    most = rows.groupBy(F.size(rows.columns[0]).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return most["width"] if most else 0


def fitted(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET, shift: int | None = None, most: int = MOST) -> Whitening | None:
    """The whitening of all usable vectors of the width that most have; None where there is none."""
    rows = picked(usable(vectors, vector_col), v=vector_col)
    width = width_of(rows)
    if not width:
        return None
    shift = offset if shift is None else shift
    return decomposed(*_turned(scatter(rows.where(F.size("v") == width), width, scale, offset, shift), shift), most)


def _turned(found: tuple[int, list[int], np.ndarray], shift: int) -> tuple[int, int, list[int], np.ndarray]:
    return found[0], shift, found[1], found[2]


_OUT = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the exact sum of (n x - S)² over the dimensions, null if it takes more than 64 bits. Rows whose
    vector is null, empty, or holds a null or non-finite entry are left out, and so are those of another width than the
    model's. In directions without spread ``whitened`` is null and ``explained`` 0 (null if nothing has any spread).
    Null ids and repeated rows are carried; extra columns are not read; an empty table gives no rows.
    """
    rows = picked(usable(vectors, vector_col), vec_id=id_col, v=vector_col)
    schema = _OUT.format(kind=rows.schema["vec_id"].dataType.simpleString())
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, count = model.vectors.shape
    given = vectors.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], list | None]:
        model = given.value
        spread = model.values > 0
        turn = model.vectors[:, spread] / np.sqrt(model.values[spread])
        sums, room = np.array(model.sums, object), (1 << 63) // width
        explained = [v / model.trace if model.trace else None for v in model.values.tolist()]

        def work(batch: pa.RecordBatch) -> list | None:
            n = batch.num_rows
            y = whole(batch.column(1), width, scale, offset, model.shift)
            far = model.n * max(int(y.max()), -int(y.min()), 1) + max(abs(s) for s in model.sums)
            if far < 1 << 62 and far * far < room:
                centred = model.n * y - sums.astype(np.int64)
                deviation = pa.array((centred * centred).sum(axis=1))
            else:
                centred = model.n * y.astype(object) - sums
                deviation = pa.array([d if d < 1 << 63 else None for d in (centred * centred).sum(axis=1)], pa.int64())
            values = np.full((n, count), np.nan)
            values[:, spread] = (centred / model.n).astype(np.float64) @ turn
            each = pa.array(np.repeat(np.arange(n), count))
            return [
                batch.column(0).take(each),
                np.tile(np.arange(1, count + 1), n),
                np.full(n * count, model.n),
                deviation.take(each),
                pa.array(values.ravel(), from_pandas=True),
                explained * n,
                np.full(n * count, model.error),
            ]

        return work

    return map_slices(rows.where(F.size("v") == width), schema, make, BLOCK_ROWS)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """:func:`whitened` by the whitening of the same vectors."""
    return whitened(vectors, fitted(vectors, vector_col, most=most), id_col, vector_col)
