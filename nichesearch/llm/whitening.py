"""Whitening of embeddings by a randomised range finder.

Entries become integers, x = floor(``SCALE`` c) + ``SHIFT``, so that counts and sums are exact.
The range of the covariance V of all vectors is sought by a random basis with ``OVERSAMPLE``
more columns than components: each pass over all centred rows multiplies V by the basis, which gives the
Rayleigh-Ritz values and vectors, their residuals, and, orthonormalised, the next basis.
Where residuals still fail after ``PASSES`` power passes, as with spectra that hardly fall,
the basis is expanded to the full dimension, in which one pass more makes Rayleigh-Ritz exact. A last
pass measures the covariance of what was whitened.

Rows are read in Spark's partitions; a task gives one small matrix, and they are added up in a tree. The driver
holds matrices of dimension x basis, never rows.

Defined cases: null vectors and those with null or non-finite entries are dropped; so are those
whose length is not the commonest (of equally common ones the greater); repeated rows and
null ids count like any; entries beyond 2^53 after scaling are held there; components whose
eigenvalue vanishes beside the first (constant or dependent dimensions) are left out; a deviation
over 2^63 - 1 is null; of equal eigenvalues any basis of their space may come; an empty table, or one
of empty or of equal vectors, gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS, OVERSAMPLE, PASSES = 32, 10, 4
#: Of a residual beside the first eigenvalue; of an eigenvalue beside the first under which a component is none.
TOLERANCE, VANISHED = 1e-12, 1e-12
_LIMIT = float(1 << 53)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _valid(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that count, and their dimension."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.filter(F.size("embedding") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """x-vectors as rows, in whole numbers."""
    c = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def _add(rows: DataFrame, d: int, f: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The sums of what ``f`` makes of parts of the rows: within a task, then in a tree of tasks."""

    def run(part: Iterator[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        total = None
        for (data,) in part:
            more = f(np.frombuffer(data, np.int64).reshape(-1, d))
            total = more if total is None else tuple(a + b for a, b in zip(total, more, strict=True))
        if total is not None:
            yield total

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(batch.column("embedding"), d).tobytes()], pa.binary())], names=["x"])

    parts = rows.select("embedding").mapInArrow(pack, "x binary").rdd.mapPartitions(run)
    none = f(np.zeros((0, d), np.int64))
    return parts.treeAggregate(none, *[lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))] * 2)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S, exact: halves of 32 bits are added as 64."""
    low, high, n = _add(rows, d, lambda x: ((x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0), np.array(len(x))))
    return int(n), [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def _times(rows: DataFrame, d: int, mean: np.ndarray, basis: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """V x basis, and V's trace."""

    def f(x: np.ndarray) -> tuple[np.ndarray, ...]:
        z = x - mean
        return z.T @ (z @ basis), np.array((z * z).sum())

    product, trace = _add(rows, d, f)
    return product / n, float(trace) / n


def _ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k first Ritz values and vectors, and the largest residual beside the first value."""
    inner = basis.T @ product
    values, u = np.linalg.eigh((inner + inner.T) / 2)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    vectors = basis @ u
    residual = np.linalg.norm(product @ u - vectors * values, axis=0).max(initial=0)
    return values, vectors, float(residual / max(values[0], 1e-300))


def fit(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 42) -> dict | None:
    """The model of valid rows (vec_id, embedding); None where nothing varies. ``expanded`` tells whether the full dimension was needed."""
    rows, d = _valid(rows)
    n, s = sums(rows, d) if d else (0, [])
    if not n:
        return None
    mean = np.array([t / n for t in s])
    k = min(components, d)
    width = min(d, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0] if width < d else np.eye(d)
    for _ in range(passes + 1):
        product, trace = _times(rows, d, mean, basis, n)
        values, vectors, residual = _ritz(basis, product, k)
        if not values[0] > 0 or residual <= TOLERANCE or width == d:
            break
        basis = np.linalg.qr(product)[0]
    if expanded := width < d and values[0] > 0 and residual > TOLERANCE:
        product, trace = _times(rows, d, mean, basis := np.eye(d), n)
        values, vectors, residual = _ritz(basis, product, k)
    there = values > VANISHED * max(values[0], 0)
    if not there.any():
        return None
    vectors = vectors[:, there] / np.linalg.norm(vectors[:, there], axis=0)
    model = {"n": n, "sums": s, "mean": mean, "vectors": vectors, "values": values[there], "explained": values[there] / trace, "residual": residual, "expanded": expanded, "dimension": d}
    project = vectors / np.sqrt(values[there])

    def spread(x: np.ndarray) -> tuple[np.ndarray, ...]:
        w = (x - mean) @ project
        return w.T @ w, w.sum(axis=0)

    second, first = _add(rows, d, spread)
    model["identity_error"] = float(np.abs(second / n - np.outer(first, first) / n**2 - np.eye(project.shape[1])).max())
    return model


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2; in 64 bits where they surely fit, else in Python's integers, null where no long holds them."""
    most = max((abs(n * int(v) - t) for bound in (x.max(axis=0), x.min(axis=0)) for v, t in zip(bound, s, strict=True)), default=0) if len(x) else 0
    if most * most * max(1, len(s)) < 1 << 63 and n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return ((n * x - np.array(s, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def whiten(rows: DataFrame, model: dict | None) -> DataFrame:
    """A row of ``SCHEMA`` for each valid row and component; map-only."""
    spark = rows.sparkSession
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    common.small_batches(spark)
    d, k, n = model["dimension"], len(model["values"]), model["n"]
    project = model["vectors"] / np.sqrt(model["values"])
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter((F.size("embedding") == d) & F.forall("embedding", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column("embedding"), d), batch.num_rows
            w = (x - model["mean"]) @ project
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x, n, model["sums"]), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(model["explained"], m)), pa.array(np.full(m * k, model["identity_error"])),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, SCHEMA)


def query(rows: DataFrame) -> DataFrame:
    """Fit on all valid rows, then whiten each."""
    common.small_batches(rows.sparkSession)
    return whiten(rows, fit(rows))
