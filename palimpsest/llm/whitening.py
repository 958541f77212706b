"""Embedding whitening: principal components by a randomised range finder, and rows projected on them.

Entries are whole numbers, so counts, sums and deviations are exact. A pass over all rows centres each of them and adds
up x (x' B) for a basis B of some directions, which is the covariance times B but for the divisor; what a task has added
is one row a dimension, and Spark sums these by dimension, so that nothing but (dimensions x directions) numbers reaches
the driver, whatever the number of rows.

The range finder begins with a random basis of the wanted directions and OVERSAMPLING more, passes over the rows POWERS
times, each time with an orthonormal basis of what the last pass gave, and solves the small problem in that basis
(Rayleigh-Ritz). The residual |V q - e q| of each wanted component is taken from one pass more. Where one is above
RESIDUAL times the largest eigenvalue, or the gaps to the rest of the spectrum don't bear out that it is the vector to
double precision, the basis gets twice as many directions, until it has as many as there are dimensions; then one pass
gives the whole covariance and its eigenvectors are exact to rounding.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name

OVERSAMPLING = 8
POWERS = 4
#: A component stands when its residual, over its distance to the nearest other eigenvalue, is no more than this.
RESIDUAL = 1e-13
SEED = 11
#: An eigenvalue below this part of the largest one is rounding: the rows don't vary in its direction.
NOTHING = 1e-12
#: Each task holds the basis and its sums, dimensions x dimensions at most (128 MB each at this bound).
MOST_DIMS = 4096


@dataclass
class Model:
    """What whitened() needs: rows, exact sums a dimension, components (columns), their eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    directions: int  # of the last basis
    passes: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole numbers nearest to the means, and what is left of the means."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([(s - self.n * k) / self.n for s, k in zip(self.sums, near, strict=True)])


def whole(entry: Column) -> Column:
    """The contract's whole number of an entry."""
    return F.floor(F.lit(1024.0) * entry.cast("double")).cast("long") + F.lit(100_000).cast("long")


def finite(vector: Column) -> Column:
    """Whether the vector is there and all entries are numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _dims(vectors: DataFrame) -> int:
    """The length that most vectors have, of several such the largest; 0 without rows."""
    top = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension. Entries go as two halves of 32 bits, so a task's sums fit a long."""

    def add(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _matrix(b.column("x"), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "high": high, "low": low})

    per = vectors.mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low"))).collect()
    return (per[0].n if per else 0), [(int(r.high) << 32) + int(r.low) for r in sorted(per)]


def _products(vectors: DataFrame, centred: Callable[[np.ndarray], np.ndarray], basis: np.ndarray) -> np.ndarray:
    """Sum over all rows of c (c' basis), c the row as centred() makes it: dimensions x directions."""
    dims, m = basis.shape

    def add(batches):
        total = np.zeros((dims, m))
        for b in batches:
            c = centred(_matrix(b.column("x"), dims))
            total += c.T @ (c @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), *(pa.array(t) for t in total.T)], ["i", *(f"y{j}" for j in range(m))])

    made = vectors.mapInArrow(add, ", ".join(["i int", *(f"y{j} double" for j in range(m))]))
    rows = made.groupBy("i").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(m))).orderBy("i").collect()
    return np.array([[r[f"y{j}"] for j in range(m)] for r in rows])


def _trace(vectors: DataFrame, centred: Callable[[np.ndarray], np.ndarray], dims: int) -> float:
    def add(batches):
        yield pa.RecordBatch.from_pydict({"t": [sum((float((c * c).sum()) for c in (centred(_matrix(b.column("x"), dims)) for b in batches)), 0.0)]})

    return vectors.mapInArrow(add, "t double").agg(F.sum("t")).first()[0] or 0.0


def _ritz(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues in the basis, their vectors, and the vectors' images under V."""
    small = basis.T @ image
    e, u = np.linalg.eigh((small + small.T) / 2)
    u = u[:, ::-1]
    return e[::-1], basis @ u[:, :k], image @ u[:, :k]


def _stands(e: np.ndarray, q: np.ndarray, image: np.ndarray, k: int) -> bool:
    """Whether each of the k vectors is an eigenvector to RESIDUAL: its error is its residual over the gap beside it."""
    if len(e) <= k:
        return False
    far = np.linalg.norm(image - q * e[:k], axis=0)
    gaps = np.array([min(e[i] - e[i + 1], e[i - 1] - e[i] if i else np.inf) for i in range(k)])
    return bool(np.all((far <= RESIDUAL * gaps) | (e[:k] <= NOTHING * e[0])))


def fit(vectors: DataFrame, k: int = 8, seed: int = SEED) -> Model:
    """The first k components of all rows of vectors (x: array<long> without nulls, all of one length).

    Components have unit length, their entry of largest magnitude is positive. Directions in which rows don't vary are
    no components, so there may be fewer than k, and none for a single row or equal rows.
    """
    dims = _dims(vectors)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; whitening is made for {MOST_DIMS} at most")
    n, sums = _sums(vectors, dims) if dims else (0, [])
    model = Model(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0, 0)
    if not n:
        return model
    near, rest = model.centre()

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - near).astype(float) - rest

    model.trace = _trace(vectors, centred, dims) / n
    if not model.trace:
        return model
    rng, m = np.random.default_rng(seed), min(dims, k + OVERSAMPLING)
    basis = np.linalg.qr(rng.standard_normal((dims, m)))[0]
    while True:
        if m == dims:  # the whole space: one pass gives the covariance itself
            basis = np.eye(dims)
            image, model.passes = _products(vectors, centred, basis) / n, model.passes + 1
            e, q, at = _ritz(basis, image, k)
            break
        for _ in range(POWERS):
            basis, model.passes = np.linalg.qr(_products(vectors, centred, basis))[0], model.passes + 1
        image, model.passes = _products(vectors, centred, basis) / n, model.passes + 1
        e, q, at = _ritz(basis, image, k)
        if _stands(e, q, at, k):
            break
        grown = min(dims, 2 * m)
        basis = np.linalg.qr(np.hstack([image, rng.standard_normal((dims, grown - m))]))[0]
        m = grown
    some = e[:k] > NOTHING * e[0]
    q = q[:, some]
    model.components, model.values, model.directions = q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])]), e[:k][some], m
    return model


def _scores(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    (near, rest), turn = model.centre(), model.components / np.sqrt(model.values)

    def score(x: np.ndarray) -> np.ndarray:
        return ((x - near).astype(float) - rest) @ turn

    return score


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity. 0 without components."""
    k, dims, score = len(model.values), model.dims, _scores(model)
    if not k:
        return 0.0

    def add(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = score(_matrix(b.column("x"), dims))
            first, second = first + w.sum(0), second + w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(k * k + k), pa.int32()), "v": np.r_[first, second.ravel()]})

    v = np.array([r.v for r in vectors.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]) / model.n
    mean = v[:k]
    return float(np.abs(v[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2 a row: in longs where they must fit, else in whole numbers without bound."""
    low, high = (x.min(0), x.max(0)) if len(x) else ([], [])
    most = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(low, high, sums, strict=True)), default=0) if len(x) else 0
    if most * most * len(sums) < 2**63 and all(n * max(abs(int(a)), abs(int(b))) < 2**63 for a, b in zip(low, high, strict=True)) and all(abs(s) < 2**63 for s in sums):
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    y = n * x.astype(object) - np.array(sums, object)
    exact = [int(v) for v in (y * y).sum(1)]
    return pa.array([decimal.Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(df: DataFrame, vector: str, keep: list[str], k: int = 8, entry: Callable[[Column], Column] = whole) -> DataFrame:
    """keep, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component.

    vector is an array column; entry makes a whole number of each of its entries. Rows whose vector is null or holds a
    null, NaN or infinite entry are left out, as are those whose number of entries isn't the one that most rows have:
    entries are missing there, or have no dimension. Rows that repeat are rows of their own. Columns of keep must have
    other names than the results. Empty tables, a single row and equal rows have no component, so the result is empty;
    with fewer dimensions or directions of variation than k there are fewer components. deviation is a decimal of 38
    digits (null beyond). Whole numbers are cut at the range of longs.
    """
    made = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    if clash := made & {c.lower() for c in keep}:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    x = free_name(df.select(*keep), "x")
    rows = df.where(finite(F.col(vector))).select(*keep, F.transform(vector, entry).alias(x))
    vectors = rows.select(F.col(x).alias("x"))
    dims = _dims(vectors)
    rows, vectors = rows.where(F.size(x) == dims), vectors.where(F.size("x") == dims)
    model = fit(vectors, k)
    error = identity_error(vectors, model)
    score, n, sums, found, explained = _scores(model), model.n, model.sums, len(model.values), (model.values / model.trace if model.n else [])
    types = dict(df.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "component int", "n long", "deviation decimal(38,0)", "whitened double", "explained double", "identity_error double"])

    def run(batches):
        for b in batches:
            for at in range(0, len(b) if found else 0, 4096):
                part = b.slice(at, 4096)
                m = _matrix(part.column(x), dims)
                place = pa.array(np.repeat(np.arange(len(m)), found))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(place) for c in keep),
                        pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(m))),
                        pa.array(np.full(len(place), n)),
                        _deviation(m, n, sums).take(place),
                        pa.array(score(m).ravel()),
                        pa.array(np.tile(explained, len(m))),
                        pa.array(np.full(len(place), error)),
                    ],
                    [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
