"""Generalised additive models: a smooth curve of each predictor, by penalised B-splines.

The log-odds are an intercept and a sum of curves, each in a basis of ``BASIS`` cubic B-splines over the
predictor's range with a penalty on its second differences. Each pass over the data gives the weighted normal
equations of all models (penalised iteratively reweighted least squares); from them alone the driver chooses each curve's
smoothing, on a grid, by generalised cross-validation, and solves. After ``SETTLE`` passes the
smoothing stays, and the passes go on to the optimum of the penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import Block, sigmoid, total

BASIS, DEGREE = 10, 3
#: Smoothing that curves can have, and passes after which it is kept.
GRID, SETTLE = np.logspace(-2, 5, 15), 5


@dataclass
class Splines:
    """Columns of all predictors' bases, less their means, so that curves are apart from the intercept; predictors beyond the range count as at its end."""

    low: np.ndarray
    high: np.ndarray
    basis: int = BASIS
    mean: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.basis * len(self.low)

    def raw(self, x: np.ndarray) -> np.ndarray:
        span = np.where(self.high > self.low, self.high - self.low, 1.0)
        pieces = self.basis - DEGREE
        u = np.clip((np.where(np.isnan(x), self.low, x) - self.low) / span, 0, 1) * pieces
        out = np.zeros((len(x), x.shape[1], self.basis))
        cell = np.minimum(u.astype(np.int64), pieces - 1)
        t = u - cell
        cubic = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)  # a uniform cubic B-spline's four pieces
        rows, columns = np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :]
        for i, v in enumerate(cubic):
            out[rows, columns, cell + i] = v
        out[np.isnan(x)] = np.nan
        return out.reshape(len(x), self.width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), self.raw(x) - self.mean])

    def penalty(self, smoothing: np.ndarray) -> np.ndarray:
        """Of the second differences of each predictor's coefficients; a trace of ridge makes the centred bases solvable."""
        d = np.diff(np.eye(self.basis), 2, axis=0)
        out = np.zeros((1 + self.width, 1 + self.width))
        for j, s in enumerate(smoothing):
            at = slice(1 + j * self.basis, 1 + (j + 1) * self.basis)
            out[at, at] = s * d.T @ d + 1e-6 * np.eye(self.basis)
        return out


@dataclass
class Additive:
    splines: Splines
    coefficients: np.ndarray
    smoothing: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.splines(x) @ self.coefficients)


def splines(rows: DataFrame, k: int, basis: int = BASIS) -> Splines:
    from .maxent import ranges

    return Splines(*ranges(rows, k), basis)


def gcv(a: np.ndarray, b: np.ndarray, square: float, n: float, penalty: np.ndarray) -> float:
    """n RSS / (n - tr)^2 of the smoothed solution of a beta = b, where RSS = square - 2 beta . b + beta . a beta."""
    both = np.linalg.solve(a + penalty, np.column_stack([b, a]))
    beta, left = both[:, 0], n - np.trace(both[:, 1:])
    return n * max(square - 2 * beta @ b + beta @ a @ beta, 0.0) / left**2 if left > 0 else np.inf


def chosen(a: np.ndarray, b: np.ndarray, square: float, n: float, own: Splines, smoothing: np.ndarray) -> np.ndarray:
    """Each curve's best smoothing on the grid, the others' held, in two rounds."""
    smoothing = smoothing.copy()
    for _ in range(2):
        for j in range(len(smoothing)):
            tried = [gcv(a, b, square, n, own.penalty(np.r_[smoothing[:j], s, smoothing[j + 1 :]])) for s in GRID]
            smoothing[j] = GRID[int(np.argmin(tried))]
    return smoothing


def fit(blocks: RDD, own: Splines, models: int, smoothing: list[float] | None = None, max_iter: int = 60, tol: float = 1e-9) -> list[Additive]:
    """Models without their folds; ``smoothing`` states that of each curve, else it is chosen."""
    k = own.width
    sums = total(blocks, lambda b: np.r_[b.weight.sum(), b.weight @ own.raw(b.x)])
    own = Splines(own.low, own.high, own.basis, sums[1:] / sums[0])
    beta, step = np.zeros((models, k + 1)), np.zeros((models, k + 1))
    smooth = np.array([smoothing or [1.0] * len(own.low)] * models, float)
    last, done = np.full(models, np.inf), np.zeros(models, bool)
    for n in range(max_iter):
        at = beta + step

        def f(b: Block, at: np.ndarray = at) -> np.ndarray:
            x, out = own(b.x), np.zeros((len(at), 3 + (k + 1) * (k + 2)))
            for m in range(len(at)):
                w, eta = b.trains(m), x @ at[m]
                p = sigmoid(eta)
                v = np.maximum(p * (1 - p), 1e-10) * w
                z = eta + w * (b.y - p) / np.where(v > 0, v, 1.0)
                out[m] = np.r_[(w * (np.logaddexp(0, eta) - b.y * eta)).sum(), w.sum(), v @ (z * z), x.T @ (v * z), ((x * v[:, None]).T @ x).ravel()]
            return out

        found = total(blocks, f)
        for m in np.flatnonzero(~done):
            a, b = found[m, k + 4 :].reshape(k + 1, k + 1), found[m, 3 : k + 4]
            settled = n >= SETTLE or smoothing is not None
            loss = found[m, 0] + 0.5 * at[m] @ own.penalty(smooth[m]) @ at[m]
            if settled and n > SETTLE and loss > last[m] + 1e-12 * abs(loss):
                step[m] /= 2
                continue
            beta[m] = at[m]
            if not settled:
                smooth[m] = chosen(a, b, found[m, 2], found[m, 1], own, smooth[m])
            penalty = own.penalty(smooth[m])
            last[m] = found[m, 0] + 0.5 * beta[m] @ penalty @ beta[m]
            step[m] = np.linalg.solve(a + penalty, b) - beta[m]
            done[m] = settled and np.abs(step[m]).max() <= tol * max(1.0, np.abs(beta[m]).max())
        step[done] = 0
        if done.all():
            break
    return [Additive(own, beta[m], smooth[m]) for m in range(models)]


def curves(rows: DataFrame, model: Additive, k: int, points: int = 21) -> DataFrame:
    """(predictor, value, log_odds) of each fitted curve at equal steps over its range: ``points`` rows a predictor."""
    out = []
    for j in range(k):
        at = np.linspace(model.splines.low[j], model.splines.high[j], points)
        x = np.tile(model.splines.low, (points, 1))
        x[:, j] = at
        own = slice(1 + j * model.splines.basis, 1 + (j + 1) * model.splines.basis)
        values = model.splines(x)[:, own] @ model.coefficients[own]
        out += [(j, float(a), float(v)) for a, v in zip(at, values, strict=True)]
    return rows.sparkSession.createDataFrame(out, "predictor int, value double, log_odds double").orderBy(F.col("predictor"), F.col("value"))
