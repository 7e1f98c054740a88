"""Multivariate adaptive regression splines: products of hinges, grown in pairs and pruned.

Every step adds the pair t (x_j - c)+ and t (c - x_j)+ that lowers the squared error most, over all terms t that may be
multiplied, predictors j and knots c. One pass over the data gives, for all models, the inner products of every
candidate with the terms that are there and with the labels; the driver works out each pair's gain from these. A last
pass gives the products of all terms, from which the driver prunes backward by generalised cross-validation. So a fit is
a pass a step, and the driver holds candidates x terms numbers, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD

from .learners import Block, total

#: Pairs at most, knots of a predictor, and what a knot costs in the criterion for additive models and for products.
PAIRS, KNOTS, COSTS = 10, 15, {1: 2.0, 2: 3.0}
#: A step that lowers the squared error by a smaller part ends the growth.
LEAST = 1e-4
#: A term: hinges (predictor, knot, side), multiplied; the empty one is the intercept.
Term = tuple[tuple[int, float, int], ...]


def columns(x: np.ndarray, terms: Sequence[Term]) -> np.ndarray:
    out = np.ones((len(x), len(terms)))
    for i, term in enumerate(terms):
        for j, c, side in term:
            out[:, i] *= np.maximum(side * (x[:, j] - c), 0)
    return out


@dataclass
class Mars:
    terms: list[Term]
    coefficients: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The fitted share of presences, held between 0 and 1."""
        return np.clip(columns(x, self.terms) @ self.coefficients, 0, 1)


def knots(edges: list[np.ndarray], most: int = KNOTS) -> list[np.ndarray]:
    """At most ``most`` of each predictor's quantile edges, evenly chosen."""
    return [e[np.unique(np.round(np.linspace(0, len(e) - 1, min(most, len(e)))).astype(int))] if len(e) else e for e in edges]


def parents(terms: list[Term], degree: int) -> list[int]:
    return [i for i, t in enumerate(terms) if len(t) < degree]


def gains(gram: np.ndarray, by: np.ndarray, cross: np.ndarray, own: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How much each pair lowers the squared error: gram and by of the terms, cross (pair, side, term), own and labels (pair, side). Sides of a pair never overlap, so that their product is 0."""
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    rest = own[:, :, None] * np.eye(2) - np.einsum("pst,tu,pvu->psv", cross, inverse, cross)
    r = labels - cross @ (inverse @ by)
    scale = np.maximum(own.max(axis=1), 1e-300)[:, None, None]
    return np.einsum("ps,psv,pv->p", r, np.linalg.pinv(rest / scale, rcond=1e-9, hermitian=True) / scale, r)


def fit(blocks: RDD, at: list[np.ndarray], models: int, pairs: int = PAIRS, degree: int = 1) -> list[Mars]:
    """Models without their folds, grown and pruned."""
    k, q = len(at), max((len(c) for c in at), default=0)
    grown: list[list[Term]] = [[()] for _ in range(models)]
    growing = [k > 0 and pairs > 0] * models
    while any(growing):
        width = max(map(len, grown))
        most = max(len(parents(g, degree)) for g in grown)

        def f(b: Block, width: int = width, most: int = most) -> np.ndarray:
            out = np.zeros((models, 1 + width * (width + 1) + most * k * q * 2 * (width + 2)))
            for m, terms in enumerate(grown):
                if not growing[m]:
                    continue
                w, base = b.trains(m), columns(b.x, terms)
                gram = np.zeros((width, width + 1))
                gram[: len(terms), : len(terms)], gram[: len(terms), width] = (base * w[:, None]).T @ base, base.T @ (w * b.y)
                each = np.zeros((most, k, q, 2, width + 2))
                for p, i in enumerate(parents(terms, degree)):
                    for j in range(k):
                        if any(h[0] == j for h in terms[i]):
                            continue
                        for s, side in enumerate((1, -1)):
                            h = base[:, i : i + 1] * np.maximum(side * (b.x[:, j : j + 1] - at[j]), 0)
                            n = len(at[j])
                            each[p, j, :n, s, : len(terms)] = (h * w[:, None]).T @ base
                            each[p, j, :n, s, width], each[p, j, :n, s, width + 1] = w @ (h * h), (w * b.y) @ h
                out[m] = np.r_[w @ (b.y * b.y), gram.ravel(), each.ravel()]
            return out

        found = total(blocks, f)
        for m, terms in enumerate(grown):
            if not growing[m]:
                continue
            n = len(terms)
            gram = found[m, 1 : 1 + width * (width + 1)].reshape(width, width + 1)
            each = found[m, 1 + width * (width + 1) :].reshape(most * k * q, 2, width + 2)
            gain = gains(gram[:n, :n], gram[:n, width], each[:, :, :n], each[:, :, width], each[:, :, width + 1])
            left = found[m, 0] - gram[:n, width] @ np.linalg.pinv(gram[:n, :n], rcond=1e-12, hermitian=True) @ gram[:n, width]
            best = int(np.argmax(gain >= gain.max() * (1 - 1e-9)))  # the first of equal ones
            if gain[best] <= LEAST * max(left, 1e-300):
                growing[m] = False
                continue
            p, j, c = np.unravel_index(best, (most, k, q))
            parent = terms[parents(terms, degree)[p]]
            grown[m] = [*terms, *((*parent, (int(j), float(at[j][c]), side)) for side in (1, -1))]
            growing[m] = len(grown[m]) < 1 + 2 * pairs
    width = max(map(len, grown))

    def products(b: Block) -> np.ndarray:
        out = np.zeros((models, 2 + width * (width + 1)))
        for m, terms in enumerate(grown):
            w, base = b.trains(m), columns(b.x, terms)
            gram = np.zeros((width, width + 1))
            gram[: len(terms), : len(terms)], gram[: len(terms), width] = (base * w[:, None]).T @ base, base.T @ (w * b.y)
            out[m] = np.r_[w.sum(), w @ (b.y * b.y), gram.ravel()]
        return out

    found, out = total(blocks, products), []
    for m, terms in enumerate(grown):
        gram = found[m, 2:].reshape(width, width + 1)[: len(terms)]
        kept, beta = prune(gram[:, : len(terms)], gram[:, width], found[m, 1], found[m, 0], COSTS[min(degree, 2)])
        out.append(Mars([terms[i] for i in kept], beta))
    return out


def criterion(error: float, n: float, terms: int, cost: float) -> float:
    """Generalised cross-validation: what a model of so many terms is worth."""
    left = 1 - (terms + cost * (terms - 1) / 2) / n
    return error / n / left**2 if left > 0 else np.inf


def prune(gram: np.ndarray, by: np.ndarray, square: float, n: float, cost: float) -> tuple[list[int], np.ndarray]:
    """The best of the models on the way from all terms to the intercept, each step without the term that is missed least; and its coefficients."""

    def solved(own: list[int]) -> tuple[float, np.ndarray]:
        beta = np.linalg.pinv(gram[np.ix_(own, own)], rcond=1e-10, hermitian=True) @ by[own]
        return max(square - beta @ by[own], 0.0), beta

    own = list(range(len(by)))
    best, chosen = np.inf, own
    while True:
        error, _ = solved(own)
        if (value := criterion(error, n, len(own), cost)) <= best:
            best, chosen = value, own
        if len(own) == 1:
            break
        without = [[i for i in own if i != out] for out in own[1:]]
        errors = np.array([solved(s)[0] for s in without])
        own = without[int(np.flatnonzero(errors <= errors.min() + 1e-9 * square)[-1])]  # of terms that are missed as little, the last
    return chosen, solved(chosen)[1]
