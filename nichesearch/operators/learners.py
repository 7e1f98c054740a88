"""Learners that are fitted for all folds in the same passes over the data.

Rows are packed once, a NumPy block a partition, and stay where they are. A model leaves out the
rows of its fold (the last one none); each pass computes a step of all models and adds up
small arrays in a tree: gradients and curvature for Newton's method, histograms of gradients for
trees, loss and slope for maximum entropy. So the jobs of a fit do not grow with the number of folds, and
the driver holds arrays of models x features, never rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a partition of packed rows has at least, where there are so many.
ROWS = 20_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Block:
    """Rows of a partition: features, label, and the place of their fold among the models (-1: in none of them left out). Between passes it is a dictionary of its arrays."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    weight: np.ndarray
    state: Any = None  # of a learner that carries something from pass to pass

    def trains(self, model: int) -> np.ndarray:
        """Weights of the rows in a model's fit."""
        return self.weight * (self.fold != model)


def packed(rows: DataFrame, folds: Sequence[int | None], n: int, weight: str | None = None) -> RDD:
    """Blocks of rows (features, label, fold), without those that lack a feature where the learner can't; ``folds`` names the models."""
    place = {f: i for i, f in enumerate(folds) if f is not None}
    keep = rows.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, rest = [], []
        for batch in batches:
            if batch.num_rows:
                values = batch.column("features").flatten()
                xs.append(values.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))  # NULL becomes NaN
                rest.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold", "weight")])
        if xs:
            y, fold, w = (np.concatenate(c) for c in zip(*rest, strict=True))
            block = {"x": np.concatenate(xs), "y": y.astype(float), "fold": np.array([place.get(f, -1) for f in fold.tolist()], np.int32), "weight": w}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    parts = max(1, min(keep.rdd.getNumPartitions(), -(-n // ROWS)))
    return keep.coalesce(parts).mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def total(blocks: RDD, f: Callable[[Block], np.ndarray]) -> np.ndarray:
    """The sum of what ``f`` makes of each block."""
    parts = blocks.map(lambda arrays: f(Block(**arrays)))
    return parts.reduce(np.add) if parts.getNumPartitions() <= 16 else parts.treeReduce(np.add)


def total_of(rows: DataFrame, column: str, k: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of what ``f`` makes of arrays of ``k`` numbers, a batch at a time; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                more = f(batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k))
                out = more if out is None else out + more
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select(column).mapInArrow(run, "sums array<double>").rdd.map(lambda r: np.array(r[0]))
    return parts.treeReduce(np.add) if not parts.isEmpty() else None


# --- logistic regression


@dataclass
class Linear:
    """P(1) = sigmoid(intercept + coefficients . x)."""

    intercept: float
    coefficients: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + x @ np.array(self.coefficients))


def logistic(blocks: RDD, k: int, models: int, c: float = 1.0, max_iter: int = 100, tol: float = 1e-10) -> list[Linear]:
    """Newton's method on the summed log loss times C plus half the squared coefficients; the intercept is free. Steps are halved where they don't improve."""
    w = np.zeros((models, k + 1))
    free = np.r_[0.0, np.ones(k)]
    step, last, slope, curve = np.zeros_like(w), np.full(models, np.inf), None, None
    done = np.zeros(models, bool)
    for _ in range(max_iter):
        at = w + step

        def f(b: Block, at: np.ndarray = at) -> np.ndarray:
            a = np.column_stack([np.ones(len(b.y)), b.x])
            out = np.zeros((len(at), 1 + (k + 1) * (k + 2)))
            for m in range(len(at)):
                own, z = b.trains(m), a @ at[m]
                p = sigmoid(z)
                out[m, 0] = (own * (np.logaddexp(0, z) - b.y * z)).sum()
                out[m, 1 : k + 2] = a.T @ (own * (p - b.y))
                out[m, k + 2 :] = ((a * (own * p * (1 - p))[:, None]).T @ a).ravel()
            return out

        found = total(blocks, f)
        loss = c * found[:, 0] + 0.5 * (at[:, 1:] ** 2).sum(axis=1)
        better = loss <= last + 1e-12 * np.abs(loss)
        if slope is None:
            slope, curve = np.zeros((models, k + 1)), np.zeros((models, k + 1, k + 1))
        for m in np.flatnonzero(better & ~done):
            w[m], last[m] = at[m], loss[m]
            slope[m] = c * found[m, 1 : k + 2] + free * w[m]
            curve[m] = c * found[m, k + 2 :].reshape(k + 1, k + 1) + np.diag(free)
            step[m] = -np.linalg.lstsq(curve[m], slope[m], rcond=None)[0]
            done[m] = np.abs(step[m]).max() <= tol * max(1.0, np.abs(w[m]).max())
        step[~better] /= 2
        step[done] = 0
        if done.all():
            break
    return [Linear(float(v[0]), v[1:].tolist()) for v in w]


# --- gradient boosting

#: Bins of a feature, the first of which is for what is missing; trees after which rows carry their margins on.
BINS, CARRY = 64, 10


@dataclass
class Trees:
    """A sum of trees over binned features; nodes of a tree stand in the order of levels."""

    base: float
    edges: list[np.ndarray]
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))  # tree x inner node; -1: all go left
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))  # the last bin that goes left
    missing_left: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), bool))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Summed leaves of the trees from ``first`` on."""
        out = np.zeros(len(bins))
        for t in range(first, len(self.feature)):
            out += self.leaf[t][_fall(bins, self.feature[t], self.split[t], self.missing_left[t])]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.base + self.margin(binned(x, self.edges)))


def _fall(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, missing_left: np.ndarray) -> np.ndarray:
    """Where rows come to below a tree's inner nodes (all those of whole levels)."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(int(math.log2(len(feature) + 1))):
        own = bins[rows, np.maximum(feature[node], 0)]
        right = np.where(own == 0, ~missing_left[node], own > split[node]) & (feature[node] >= 0)
        node = 2 * node + 1 + right
    return node - len(feature)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins from 1 on, 0 where a value is missing."""
    out = np.stack([np.searchsorted(e, x[:, j], side="left") + 1 for j, e in enumerate(edges)], axis=1) if edges else np.zeros((len(x), 0))
    return np.where(np.isnan(x), 0, out).astype(np.uint8)


def quantile_edges(rows: DataFrame, k: int) -> list[np.ndarray]:
    """At most ``BINS`` - 2 edges of each feature, from one aggregation; an edge belongs to the bin below it."""
    places = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    value = lambda i: F.when(~F.isnan(F.get("features", F.lit(i))), F.get("features", F.lit(i)))
    found = rows.agg(*[F.percentile_approx(value(i), places, F.lit(10_000)).alias(str(i)) for i in range(k)]).first()
    return [np.unique(np.array(found[str(i)] or [], float)) for i in range(k)]


def boosted(blocks: RDD, edges: list[np.ndarray], models: int, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, ridge: float = 1.0, least: float = 1.0) -> list[Trees]:
    """Second-order boosting of the log loss: a pass a level of a tree, for all models together.

    A split gains G_l^2 / (H_l + ridge) + G_r^2 / (H_r + ridge) - G^2 / (H + ridge), where both sides have
    a curvature of ``least``; missing values go to the side where they gain more. Of equal gains
    the first feature and bin are taken. Margins are carried by the rows, anew every ``CARRY`` trees.
    """
    k = len(edges)
    counts = total(blocks, lambda b: np.array([[b.trains(m).sum(), (b.trains(m) * b.y).sum()] for m in range(models)]))
    trees = [Trees(float(np.log(p / (n - p))), edges) for n, p in counts]

    base = [t.base for t in trees]

    def begin(arrays: dict) -> dict:
        return arrays | {"x": binned(arrays["x"], edges), "state": np.tile(base, (len(arrays["y"]), 1))}

    own = blocks.map(begin).persist(StorageLevel.MEMORY_AND_DISK)
    carried = 0
    for n in range(n_estimators):
        if n - carried == CARRY:
            own, carried = _carry(own, trees, carried), n
        inner = 2**max_depth - 1
        feature, split, missing_left, leaf = np.full((models, inner), -1, np.int32), np.zeros((models, inner), np.int32), np.ones((models, inner), bool), np.zeros((models, 2**max_depth))
        for level in range(max_depth):
            first, nodes = 2**level - 1, 2**level
            above = (feature[:, :first], split[:, :first], missing_left[:, :first])
            hist = total(own, _histograms(trees, carried, above, nodes, k))
            for m in range(models):
                for node in range(nodes):
                    j, s, left, sums = _best(hist[m, node], ridge, least)
                    feature[m, first + node], split[m, first + node], missing_left[m, first + node] = j, s, left
                    if level == max_depth - 1:
                        leaf[m, 2 * node : 2 * node + 2] = [-learning_rate * g / (h + ridge) for g, h in sums]
        for m, t in enumerate(trees):
            for name, new in (("feature", feature[m]), ("split", split[m]), ("missing_left", missing_left[m]), ("leaf", leaf[m])):
                setattr(t, name, np.concatenate([getattr(t, name).reshape(-1, len(new)), new[None]]))
    own.unpersist()
    return trees


def _histograms(trees: list[Trees], carried: int, above: tuple[np.ndarray, ...], nodes: int, k: int) -> Callable[[Block], np.ndarray]:
    """Sums of slopes and curvatures by model, node, feature and bin."""

    def f(b: Block) -> np.ndarray:
        out = np.zeros((len(trees), nodes, k, BINS, 2))
        for m, t in enumerate(trees):
            p = sigmoid(b.state[:, m] + t.margin(b.x, carried))
            w = b.trains(m)
            node = _fall(b.x, *(x[m] for x in above)) if nodes > 1 else np.zeros(len(b.y), np.int64)
            for i, v in enumerate((w * (p - b.y), w * p * (1 - p))):
                for j in range(k):
                    out[m, :, j, :, i] = np.bincount(node * BINS + b.x[:, j], v, nodes * BINS).reshape(nodes, BINS)
        return out

    return f


def _best(hist: np.ndarray, ridge: float, least: float) -> tuple[int, int, bool, list[tuple[float, float]]]:
    """Feature, bin, side of the missing, and the sums of both sides, of the best split of a node; -1 where none gains."""
    whole = hist[0].sum(axis=0) if len(hist) else np.zeros(2)
    score = lambda g, h: g * g / (h + ridge)
    best = (-1, 0, True, [tuple(whole), (0.0, 0.0)])
    top = 1e-9
    below = np.cumsum(hist[:, 1:], axis=1)  # without the missing
    for left in (True, False):
        l = below + hist[:, :1] if left else below  # noqa: E741
        r = whole - l
        gain = np.where((l[..., 1] >= least) & (r[..., 1] >= least), score(l[..., 0], l[..., 1]) + score(r[..., 0], r[..., 1]) - score(*whole), -np.inf)
        if gain.size and gain.max() > top * (1 + 1e-12):
            top = gain.max()
            j, s = np.unravel_index(np.argmax(gain >= top * (1 - 1e-12)), gain.shape)  # the first of equal ones
            best = (int(j), int(s) + 1, left, [tuple(l[j, s]), tuple(r[j, s])])
    return best


def _carry(own: RDD, trees: list[Trees], carried: int) -> RDD:
    """Blocks whose margins hold all trees so far, checkpointed so that a lost executor costs one reading."""
    trees = [Trees(t.base, t.edges, t.feature.copy(), t.split.copy(), t.missing_left.copy(), t.leaf.copy()) for t in trees]

    def more(arrays: dict) -> dict:
        return arrays | {"state": arrays["state"] + np.stack([t.margin(arrays["x"], carried) for t in trees], axis=1)}

    new = own.map(more).persist(StorageLevel.MEMORY_AND_DISK)
    if own.context._jsc.sc().getCheckpointDir().isDefined():
        new.checkpoint()
    new.count()
    own.unpersist()
    return new


# --- out of fold


def predicted(rows: DataFrame, models: dict[int, Callable[[np.ndarray], np.ndarray]], column: str = "cv_prediction") -> DataFrame:
    """Adds each row's prediction by the model that left its fold out; NULL where there is none. Map-only."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            if batch.num_rows:
                x = batch.column(names.index("features")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                fold = batch.column(names.index("fold")).to_numpy(zero_copy_only=False)
                for f, model in models.items():
                    if (own := fold == f).any():
                        out[own] = model(x[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], names=[*names, column])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())]))
