"""Whitening of vectors: moments by Chan's merging, the covariance's eigenvectors, and a second pass that verifies them.

Each partition computes its count, its mean and its centred scatter, batch by batch; two such triples merge by Chan's
formula, in partitions and then pairwise in a treeReduce, so that nothing is ever summed about a far origin. A triple has
some d*d numbers, whatever the table's size. Sums are whole numbers and exact. The driver decomposes one d x d matrix.
The projected vectors go through the same moments again: their covariance must be the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, give_back, rows, tune

#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT, and components at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries beyond this have no exact whole number as a double.
LARGEST = float(1 << 52)
#: Eigenvalues up to this share of the greatest are rounding: along them all vectors are the same.
NOTHING = 1e-12

SCHEMA = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray


def moments(x: np.ndarray) -> Moments:
    """Count, mean, centred scatter and sums (exact for whole numbers) of the rows of a matrix."""
    mean = x.mean(0, dtype=np.float64)
    centred = x - mean
    return Moments(len(x), mean, centred.T @ centred, x.sum(0))


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's formula: the moments of two disjoint lists from those of each."""
    if a is None or b is None:
        return a or b
    n, delta = a.n + b.n, b.mean - a.mean
    return Moments(n, a.mean + delta * (b.n / n), a.scatter + b.scatter + np.outer(delta, delta) * (a.n * b.n / n), a.sums + b.sums)


class Whitening(NamedTuple):
    """What the tasks of the last pass get: d*d numbers at most."""

    n: int
    sums: np.ndarray
    projection: np.ndarray  # a column per component, divided by the root of its eigenvalue
    explained: np.ndarray
    live: int  # components along which vectors differ

    def whitened(self, x: np.ndarray) -> np.ndarray:
        # n*x - S is a whole number, so that the centred vector has no rounding but the division's.
        return ((self.n * x - self.sums) / self.n) @ self.projection


def fitted(m: Moments | None, components: int = COMPONENTS) -> Whitening | None:
    if m is None:
        return None
    value, vector = np.linalg.eigh(m.scatter / m.n)
    value, vector = value[::-1].clip(min=0), vector[:, ::-1]
    k, total = min(components, len(value)), float(np.trace(m.scatter)) / m.n
    live = int((value[:k] > NOTHING * max(value[0], 0)).sum()) if value[0] > 0 else 0
    root = np.where(np.arange(k) < live, np.sqrt(value[:k]), np.inf)
    return Whitening(m.n, m.sums, vector[:, :k] / root, value[:k] / total if total > 0 else np.zeros(k), live)


def whole(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, and their whole-number vectors: of `dims` entries, none null or not finite."""
    if not pa.types.is_list(vectors.type) and not pa.types.is_large_list(vectors.type):
        raise TypeError(f"vectors are arrays, not {vectors.type}")
    size = np.array([-1 if s is None else s for s in vectors.value_lengths().to_pylist()], np.int64)
    right = np.flatnonzero(size == dims)
    flat = vectors.take(pa.array(right)).flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls are NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * c)
        fine = (np.abs(x) < LARGEST).all(1)
    return right[fine], x[fine].astype(np.int64) + SHIFT


def exact_deviation(x: np.ndarray, w: Whitening) -> list[int]:
    """The sum of (n*x - S)^2 over the dimensions of each row; one that no long holds is an error, never a wrong value."""
    away = w.n * x - w.sums
    rough = (away.astype(np.float64) ** 2).sum(1)
    if len(x) and rough.max() < 2.0**62:
        return (away**2).sum(1).tolist()
    out = [sum(v * v for v in row) for row in away.tolist()]
    if max(out, default=0) >= 1 << 63:
        raise ArithmeticError("a deviation does not fit a long")
    return out


def _reduced(df: DataFrame, dims: int, transform) -> Moments | None:
    """The moments of transform(whole vectors) over all rows of `df` (vector)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = whole(column(batch, "vector"), dims)[1]
            if len(x):
                total = merged(total, moments(transform(x)))
        give_back()
        if total is not None:
            whole_sums = total.sums.dtype.kind == "i"
            parts = [[total.n], [total.mean.tolist()], [total.scatter.ravel().tolist()], [total.sums.tolist() if whole_sums else None]]
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.int64(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.int64())), strict=True)], names=["n", "mean", "scatter", "sums"])

    def unpacked(r) -> Moments:
        mean = np.array(r["mean"])
        return Moments(r["n"], mean, np.array(r["scatter"]).reshape(len(mean), -1), np.array(r["sums"] if r["sums"] is not None else [0.0]))

    parts = df.select("vector").mapInArrow(partial, "n long, mean array<double>, scatter array<double>, sums array<long>").rdd.map(unpacked)
    return parts.treeAggregate(None, merged, merged) if parts.getNumPartitions() else None


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Null vectors, those with null or non-finite entries, and entries too large for an exact whole number (2^52 / SCALE)
    take no part, nor do vectors of another length than most (of lengths as frequent the greater) or of none. Null ids and
    repeated rows are rows like any other. Where all vectors agree along a component (one vector, copies of one, fewer
    vectors than dimensions) there is nothing to scale: its whitened and explained values are 0, and identity_error is
    that of the other components (0 if there are none). Eigenvalues that are equal leave their components' directions
    open; they are the same for all rows. Extra columns are not read. An empty table: no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    common = own.filter("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common["d"] if common else 0
    w = fitted(_reduced(own, dims, lambda x: x), components) if dims else None
    if w is None:
        return spark.createDataFrame([], DDL)
    seen = _reduced(own, dims, w.whitened)
    off = (seen.scatter / seen.n - np.eye(len(w.explained)))[: w.live, : w.live]
    error, k = float(np.abs(off).max()) if w.live else 0.0, len(w.explained)

    def each(batch: pa.RecordBatch) -> dict:
        which, x = whole(column(batch, "vector"), dims)
        ids = column(batch, "vec_id").take(pa.array(which))
        n = len(which)
        again = pa.array(np.repeat(np.arange(n), k))
        return {
            "vec_id": ids.take(again),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), n),
            "n": np.full(n * k, w.n),
            "deviation": pa.array(exact_deviation(x, w), pa.int64()).take(again),
            "whitened": w.whitened(x).ravel(),
            "explained": np.tile(w.explained, n),
            "identity_error": np.full(n * k, error),
        }

    return own.mapInArrow(lambda it: rows(it, SCHEMA, each), DDL)
