"""Maximum entropy: presences against a background, with feature classes and an L1 penalty.

The log density over the background is linear in expanded features; what is minimised is
ln(sum over the background of exp(w . f)) - mean over presences of w . f + sum of penalty_j |w_j|,
the same as a penalised Poisson point process. All rows of a fit are its background, the presences too.
Each pass over the data gives slope and curvature of all models; between passes the driver minimises the
quadratic model with the penalty by coordinate descent (proximal Newton), with halved steps where they don't improve.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import Block, total

#: Weight of the penalty by class of features.
CLASSES = {"linear": 1.0, "quadratic": 1.0, "hinge": 0.5, "threshold": 1.0}
KNOTS = 8


@dataclass
class Expansion:
    """Features from predictors, each between 0 and 1 over the range of the data."""

    low: np.ndarray
    high: np.ndarray
    classes: tuple[str, ...] = ("linear", "quadratic", "hinge")
    knots: int = KNOTS

    @property
    def weights(self) -> np.ndarray:
        """The class's part of each feature's penalty."""
        many = {"linear": 1, "quadratic": 1, "hinge": 2 * self.knots, "threshold": self.knots}
        return np.repeat([CLASSES[c] for c in self.classes], [many[c] * len(self.low) for c in self.classes]).astype(float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Predictors beyond the range of the data count as at its end (clamping)."""
        span = np.where(self.high > self.low, self.high - self.low, 1.0)
        u = np.clip((x - self.low) / span, 0, 1)
        at = np.arange(self.knots) / self.knots
        parts = []
        for c in self.classes:
            if c == "linear":
                parts.append(u)
            elif c == "quadratic":
                parts.append(u * u)
            else:
                for j in range(u.shape[1]):
                    v = u[:, j : j + 1]
                    if c == "threshold":
                        parts.append((v >= (at + 0.5 / self.knots)).astype(float))
                    else:
                        parts += [np.clip((v - at) / (1 - at), 0, 1), np.clip((1 - at - v) / (1 - at), 0, 1)]
        return np.concatenate(parts, axis=1)


def ranges(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each predictor, from one aggregation."""
    r = rows.agg(*[f(F.get("features", F.lit(i))).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(k)]).first()
    return tuple(np.array([r[f"{n}{i}"] if r[f"{n}{i}"] is not None else 0.0 for i in range(k)], float) for n in "lh")


@dataclass
class Maxent:
    """cloglog: 1 - exp(-exp(entropy + w . f - ln of the background's sum))."""

    expansion: Expansion
    w: np.ndarray
    log_sum: float
    entropy: float

    def link(self, x: np.ndarray) -> np.ndarray:
        return self.expansion(x) @ self.w - self.log_sum

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return -np.expm1(-np.exp(np.clip(self.entropy + self.link(x), -700, 50)))


def fit(blocks: RDD, expansion: Expansion, models: int, regularisation: float = 1.0, max_iter: int = 60, tol: float = 1e-9) -> list[Maxent]:
    """Models without their folds; penalties follow the spread of the features among a model's presences, divided by the root of their number."""
    k = len(expansion.weights)

    def presences(b: Block) -> np.ndarray:
        f, out = expansion(b.x), np.zeros((models, 1 + 2 * k))
        for m in range(models):
            own = b.trains(m) * b.y
            out[m] = np.r_[own.sum(), own @ f, own @ (f * f)]
        return out

    found = total(blocks, presences)
    n = found[:, :1]
    mean = found[:, 1 : k + 1] / n
    sd = np.sqrt(np.maximum(found[:, k + 1 :] / n - mean**2, 0))
    penalty = regularisation * expansion.weights * np.maximum(sd, 1e-3) / np.sqrt(n)
    w, step = np.zeros((models, k)), np.zeros((models, k))
    shift, last, done = np.zeros(models), np.full(models, np.inf), np.zeros(models, bool)
    slope, curve = np.zeros((models, k)), np.zeros((models, k, k))
    log_sum, entropy = np.zeros(models), np.zeros(models)
    for _ in range(max_iter):
        at = w + step

        def f(b: Block, at: np.ndarray = at, shift: np.ndarray = shift) -> np.ndarray:
            x, out = expansion(b.x), np.zeros((len(at), 2 + k + k * k))
            for m in range(len(at)):
                z = x @ at[m]
                e = b.trains(m) * np.exp(np.clip(z - shift[m], -700, 700))
                out[m] = np.r_[e.sum(), e @ z, e @ x, ((x * e[:, None]).T @ x).ravel()]
            return out

        found = total(blocks, f)
        loss = np.log(found[:, 0]) + shift - (mean * at).sum(axis=1) + (penalty * np.abs(at)).sum(axis=1)
        better = loss <= last + 1e-13 * np.maximum(1, np.abs(last))
        for m in np.flatnonzero(better & ~done):
            first = found[m, 2 : k + 2] / found[m, 0]
            w[m], last[m] = at[m], loss[m]
            log_sum[m] = np.log(found[m, 0]) + shift[m]
            entropy[m] = log_sum[m] - found[m, 1] / found[m, 0]
            shift[m] = log_sum[m]
            slope[m] = first - mean[m]
            curve[m] = found[m, k + 2 :].reshape(k, k) / found[m, 0] - np.outer(first, first) + 1e-10 * np.eye(k)
            step[m] = descend(slope[m], curve[m], w[m], penalty[m]) - w[m]
            done[m] = np.abs(step[m]).max(initial=0) <= tol * max(1.0, np.abs(w[m]).max(initial=0))
        step[~better] /= 2
        step[done] = 0
        if done.all():
            break
    return [Maxent(expansion, w[m], float(log_sum[m]), float(entropy[m])) for m in range(models)]


def descend(slope: np.ndarray, curve: np.ndarray, w: np.ndarray, penalty: np.ndarray, rounds: int = 2000, tol: float = 1e-12) -> np.ndarray:
    """The minimum of slope . (v - w) + (v - w) . curve (v - w) / 2 + penalty . |v|, by coordinates."""
    v, g = w.copy(), slope.copy()  # g: the slope at v
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(v)):
            a = curve[j, j]
            raw = v[j] - g[j] / a
            new = np.sign(raw) * max(abs(raw) - penalty[j] / a, 0.0)
            if new != v[j]:
                g += curve[:, j] * (new - v[j])
                moved = max(moved, abs(new - v[j]))
                v[j] = new
        if moved <= tol * max(1.0, np.abs(v).max(initial=0)):
            break
    return v


def from_params(rows: DataFrame, k: int, params: dict[str, Any]) -> Expansion:
    classes: Sequence[str] = params.get("classes", ("linear", "quadratic", "hinge"))
    if unknown := set(classes) - set(CLASSES):
        raise ValueError(f"unknown feature classes {sorted(unknown)}")
    return Expansion(*ranges(rows, k), tuple(classes), int(params.get("knots", KNOTS)))
