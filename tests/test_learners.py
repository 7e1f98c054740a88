"""Learners against plain NumPy: optima by their conditions, trees by exhaustive search."""

import numpy as np
import pytest

from nichesearch.operators import algorithms, gam, learners, mars, maxent, stages
from pyspark.sql import functions as F

FEATURES = "record_id long, label int, features array<double>, fold int, weight double"


def sample(n=400, k=3, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, k)), 2)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x @ np.linspace(-1, 1.5, k) + x[:, 0] ** 2 / 2)))).astype(int)
    w = np.round(rng.random(n) + 0.1, 3)
    x[rng.random((n, k)) < missing] = np.nan
    return x, y, np.arange(n) % 4, w


def rows(spark, x, y, fold, w):
    return spark.createDataFrame([(i, int(y[i]), [None if np.isnan(v) else float(v) for v in x[i]], int(fold[i]), float(w[i])) for i in range(len(y))], FEATURES).repartition(3)


def test_every_fold_reaches_the_logistic_optimum(spark):
    x, y, fold, w = sample()
    for weight, used in ((None, np.ones(len(y))), ("weight", w)):
        blocks = learners.packed(rows(spark, x, y, fold, w), [0, 1, 2, 3, None], len(y), weight)
        for f, m in zip((0, 1, 2, 3, None), learners.logistic(blocks, 3, 5, c=0.7), strict=True):
            own = used * (fold != f)
            error = own * (m(x) - y)
            assert abs(error.sum()) < 1e-7 and np.allclose(0.7 * error @ x + m.coefficients, 0, atol=1e-7)


def test_separable_classes_have_a_finite_fit(spark):
    df = spark.createDataFrame([(i, int(i >= 20), [float(i), 1.0], i % 2, 1.0) for i in range(40)], FEATURES)
    scored, metrics, model, _ = algorithms.cross_validate(df, "logistic", {"C": 10.0}, 1)
    assert metrics["auc_mean"] == 1 and np.isfinite(model.coefficients).all()


def slow_tree(bins, y, margin, w, depth, k, rate):
    """Each split by trying all of them."""
    g, h = w * (1 / (1 + np.exp(-margin)) - y), w * (1 / (1 + np.exp(-margin))) * (1 - 1 / (1 + np.exp(-margin)))
    out, splits = np.zeros(len(y)), []
    nodes = [np.ones(len(y), bool)]
    for level in range(depth):
        below = []
        for node in nodes:
            best, top = None, 1e-9
            for missing_left in (True, False):
                for j in range(k):
                    for s in range(1, learners.BINS):
                        left = node & np.where(bins[:, j] == 0, missing_left, bins[:, j] <= s)
                        right = node & ~left
                        if min(h[left].sum(), h[right].sum()) < 1:
                            continue
                        gain = sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in (left, right)) - g[node].sum() ** 2 / (h[node].sum() + 1)
                        if gain > top * (1 + 1e-9):
                            top, best = gain, (j, s, missing_left, left, right)
            splits.append(best and best[:3])
            below += [best[3], best[4]] if best else [node, np.zeros(len(y), bool)]
        nodes = below
    for node in nodes:
        out[node] = -rate * g[node].sum() / (h[node].sum() + 1)
    return out, splits


@pytest.mark.parametrize("missing", [0.0, 0.15])
def test_trees_equal_exhaustive_search(spark, missing, monkeypatch):
    monkeypatch.setattr(learners, "CARRY", 2)
    x, y, fold, w = sample(300, 2, 3, missing)
    df = rows(spark, x, y, fold, w)
    edges = learners.quantile_edges(df, 2)
    assert all(len(e) <= learners.BINS - 2 for e in edges)
    blocks = learners.packed(df, [0, 1, None], len(y), "weight")
    models = learners.boosted(blocks, edges, 3, n_estimators=5, learning_rate=0.3, max_depth=2)
    bins = learners.binned(x, edges)
    for m, f in zip(models, (0, 1, None), strict=True):
        own = w * (fold != f)
        margin = np.full(len(y), np.log((own * y).sum() / (own * (1 - y)).sum()))
        assert m.base == pytest.approx(margin[0])
        for t in range(5):
            more, splits = slow_tree(bins, y, margin, own, 2, 2, 0.3)
            found = [(int(m.feature[t][i]), int(m.split[t][i]), bool(m.missing_left[t][i])) for i in range(3)]
            for a, b in zip(found, splits, strict=True):
                assert (a[0] == -1) if b is None else a[:2] == b[:2]
            margin = margin + more
        assert np.allclose(learners.sigmoid(margin), m(x), atol=1e-9)


def test_folds_are_scored_by_models_that_left_them_out(spark):
    x, y, fold, w = sample(200, 2, 5)
    other = y.copy()
    other[fold == 2] = 1 - other[fold == 2]  # labels of a fold don't move its own predictions
    for learner, params in (("gbm", {"n_estimators": 8}), ("logistic", {}), ("maxent", {}), ("gam", {"smoothing": [1.0, 1.0]}), ("mars", {"pairs": 3})):
        a, b = ({r.record_id: r.cv_prediction for r in algorithms.cross_validate(rows(spark, x, v, fold, w), learner, params, 1)[0].collect()} for v in (y, other))
        assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in range(200) if fold[i] == 2) and any(abs(a[i] - b[i]) > 1e-3 for i in range(200) if fold[i] != 2)


def test_jobs_do_not_grow_with_folds(spark):
    x, y, fold, w = sample(200, 2, 6)
    counts = []
    for folds in (2, 8):
        df = rows(spark, x, y, np.arange(200) % folds, w).cache()
        blocks = learners.packed(df, [*range(folds), None], 200)
        spark.sparkContext.setJobGroup(f"trees{folds}", "")
        learners.boosted(blocks, learners.quantile_edges(df, 2), folds + 1, n_estimators=4)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{folds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] <= 4 * 3 + 3


def test_maxent_satisfies_its_conditions(spark):
    """At the optimum the slope of every feature equals its penalty where it is used, and is within it elsewhere."""
    x, y, fold, w = sample(500, 2, 7)
    df = rows(spark, x, y, fold, w)
    for classes in (("linear",), ("linear", "quadratic", "hinge"), ("hinge", "threshold")):
        expansion = maxent.from_params(df, 2, {"classes": classes, "knots": 5})
        f = expansion(x)
        assert f.shape[1] == len(expansion.weights) and f.min() >= 0 and f.max() <= 1
        blocks = learners.packed(df, [1, None], len(y))
        for m, out in zip(maxent.fit(blocks, expansion, 2), (1, None), strict=True):
            own = fold != out
            z = f[own] @ m.w
            p = np.exp(z - z.max())
            assert m.log_sum == pytest.approx(np.log(p.sum()) + z.max()) and m.entropy == pytest.approx(-(p / p.sum()) @ np.log(p / p.sum()))
            there = f[own & (y == 1)]
            slope = p @ f[own] / p.sum() - there.mean(axis=0)
            penalty = expansion.weights * np.maximum(there.std(axis=0), 1e-3) / np.sqrt(len(there))
            used = m.w != 0
            assert used.any() and np.allclose(slope[used], -np.sign(m.w[used]) * penalty[used], atol=1e-7)
            assert (np.abs(slope[~used]) <= penalty[~used] + 1e-7).all()
            c = m(x)
            assert ((c >= 0) & (c <= 1)).all() and np.array_equal(np.argsort(c, kind="stable"), np.argsort(m.link(x), kind="stable"))
    assert algorithms.cross_validate(df, "maxent", {}, 1)[1]["auc_mean"] > 0.7
    with pytest.raises(ValueError, match="unknown"):
        maxent.from_params(df, 2, {"classes": ("cubic",)})


def test_weights_enter_fits_and_scores(spark):
    x, y, fold, w = sample(240, 2, 8)
    twice = np.r_[0:240, np.flatnonzero(y == 1)]
    df = rows(spark, x, y, fold, np.where(y == 1, 2.0, 1.0))
    weighted, metrics, model, _ = algorithms.cross_validate(df, "logistic", {}, 1, weight="weight")
    copied = rows(spark, x[twice], y[twice], fold[twice], np.ones(len(twice)))
    _, same, other, _ = algorithms.cross_validate(copied, "logistic", {}, 1)
    assert model.intercept == pytest.approx(other.intercept, abs=1e-6) and metrics["auc_mean"] == pytest.approx(same["auc_mean"], abs=1e-9)
    aucs = stages.auc(weighted.select("fold", "label", F.col("cv_prediction").alias("score")), ["fold"]).collect()
    assert metrics["auc_mean"] == pytest.approx(np.mean([r.auc for r in aucs]), abs=1e-9)  # all presences weigh alike


def test_density_ratios_equal_the_closed_form(spark):
    from nichesearch.operators import selection

    rng = np.random.default_rng(9)
    land, own = rng.normal(size=(400, 2)), rng.normal(loc=0.8, scale=0.7, size=(200, 2))
    landscape = spark.createDataFrame([(v.tolist(),) for v in land] + [([None, 1.0],)], "predictors array<double>").repartition(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)] + [(-1, [None, 2.0])], "record_id long, predictors array<double>").repartition(3)
    got = {r.record_id: r.weight for r in selection.density_ratio(df, landscape, 2, centres=50, width=0.8, ridge=0.05).collect()}
    at = np.array([r[0] for r in landscape.filter("predictors[0] is not null").orderBy(F.xxhash64(F.lit(42), "predictors"), "predictors").limit(50).collect()])
    phi = lambda x: np.array([[np.exp(-sum(((a - b) / s) ** 2 for a, b, s in zip(v, c, land.std(axis=0), strict=True)) / (2 * 0.64)) for c in at] for v in x])
    a = np.linalg.solve(sum(np.outer(p, p) for p in phi(own)) / 200 + 0.05 * np.eye(50), phi(land).mean(axis=0))
    want = np.maximum(0, phi(own) @ a)
    assert got.pop(-1) is None and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(200))
    far, near = own[:, 0] > 1.2, own[:, 0] < 0.2
    assert want[near].mean() > want[far].mean()  # what the landscape has more of weighs more
    assert selection.density_ratio(df.limit(0), landscape, 2).count() == 0


def test_additive_models_equal_a_dense_solution(spark):
    x, y, fold, w = sample(400, 2, 10)
    df = rows(spark, x, y, fold, w)
    blocks = learners.packed(df, [0, None], len(y), "weight")
    own = gam.splines(df, 2)
    assert np.allclose(own.raw(x).reshape(-1, 2, gam.BASIS).sum(axis=2), 1)  # the bases add up to one everywhere
    for m, f in zip(gam.fit(blocks, own, 2, [0.5, 20.0]), (0, None), strict=True):
        b, used, penalty = m.splines(x), w * (fold != f), m.splines.penalty(np.array([0.5, 20.0]))
        assert np.allclose(b.T @ (used * (m(x) - y)) + penalty @ m.coefficients, 0, atol=1e-6)
        beta = np.zeros(b.shape[1])
        for _ in range(60):  # Newton's steps on the penalised likelihood
            p = learners.sigmoid(b @ beta)
            beta -= np.linalg.solve((b * (used * p * (1 - p))[:, None]).T @ b + penalty, b.T @ (used * (p - y)) + penalty @ beta)
        assert np.allclose(m(x), learners.sigmoid(b @ beta), atol=1e-7)


def test_smoothing_follows_the_data(spark):
    """A wave keeps its wiggles, a straight line becomes one."""
    rng = np.random.default_rng(11)
    x = rng.uniform(-2, 2, size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2.5 * np.sin(3 * x[:, 0]) + x[:, 1])))).astype(int)
    df = rows(spark, x, y, np.arange(3000) % 3, np.ones(3000))
    m = gam.fit(learners.packed(df, [None], 3000), gam.splines(df, 2), 1)[0]
    assert m.smoothing[0] < m.smoothing[1] / 10
    found = np.array([(r.value, r.log_odds) for r in gam.curves(df, m, 2).filter("predictor = 0").collect()])
    assert np.corrcoef(found[:, 1], np.sin(3 * found[:, 0]))[0, 1] > 0.98
    b, ones = m.splines(x), np.ones(3000)
    p = m(x)
    v = p * (1 - p)
    z = b @ m.coefficients + (y - p) / v
    a, c, square = (b * v[:, None]).T @ b, b.T @ (v * z), v @ (z * z)
    beta = np.linalg.solve(a + m.splines.penalty(m.smoothing), c)
    root = np.sqrt(v)[:, None] * b
    hat = root @ np.linalg.solve(a + m.splines.penalty(m.smoothing), root.T)
    want = 3000 * (v * (z - b @ beta) ** 2).sum() / (3000 - np.trace(hat)) ** 2
    assert gam.gcv(a, c, square, ones.sum(), m.splines.penalty(m.smoothing)) == pytest.approx(want, rel=1e-8)
    assert algorithms.cross_validate(df, "gam", {}, 1)[1]["auc_mean"] > algorithms.cross_validate(df, "logistic", {}, 1)[1]["auc_mean"] + 0.1


def slow_growth(x, y, w, at, steps, degree):
    """Every pair tried by a dense least-squares fit."""
    terms, root = [()], np.sqrt(w)

    def error(own):
        base = mars.columns(x, own)
        beta = np.linalg.lstsq(base * root[:, None], y * root, rcond=1e-10)[0]
        return (base @ beta - y) ** 2 @ w

    for _ in range(steps):
        tried = []
        for t in terms:
            if len(t) >= degree:
                continue
            for j, cs in enumerate(at):
                if all(h[0] != j for h in t):
                    tried += [(error([*terms, (*t, (j, float(c), 1)), (*t, (j, float(c), -1))]), t, j, float(c)) for c in cs]
        _, t, j, c = min(tried, key=lambda v: v[0])
        terms = [*terms, (*t, (j, c, 1)), (*t, (j, c, -1))]
    return terms, error(terms)


@pytest.mark.parametrize("degree", [1, 2])
def test_growth_equals_exhaustive_search(spark, degree):
    x, y, fold, w = sample(250, 2, 12)
    df = rows(spark, x, y, fold, w)
    at = mars.knots(learners.quantile_edges(df, 2), 6)
    blocks = learners.packed(df, [1, None], len(y), "weight")
    found = mars.fit(blocks, at, 2, pairs=3, degree=degree)
    for m, f in zip(found, (1, None), strict=True):
        own = w * (fold != f)
        terms, error = slow_growth(x, y, own, at, 3, degree)
        assert set(m.terms) <= set(terms) and () in m.terms
        base = mars.columns(x, terms)
        kept, beta = mars.prune((base * own[:, None]).T @ base, base.T @ (own * y), own @ (y * y), own.sum(), mars.COSTS[degree])
        assert [terms[i] for i in kept] == m.terms and np.allclose(beta, m.coefficients, atol=1e-6)
        values = [mars.criterion(((mars.columns(x, sub) @ np.linalg.lstsq(mars.columns(x, sub) * np.sqrt(own)[:, None], y * np.sqrt(own), rcond=None)[0] - y) ** 2 @ own), own.sum(), len(sub), mars.COSTS[degree]) for sub in ([()], terms, m.terms)]
        assert values[2] <= min(values[:2]) + 1e-9


def test_planted_knots_are_recovered(spark):
    rng = np.random.default_rng(13)
    x = rng.uniform(0, 1, size=(4000, 3))
    share = 0.1 + 1.4 * np.maximum(x[:, 0] - 0.5, 0) + 0.6 * np.maximum(0.3 - x[:, 1], 0)
    y = (rng.random(4000) < share).astype(int)
    df = rows(spark, x, y, np.arange(4000) % 4, np.ones(4000))
    m = mars.fit(learners.packed(df, [None], 4000), mars.knots(learners.quantile_edges(df, 3), 15), 1)[0]
    near = lambda predictor, knot: any(j == predictor and abs(c - knot) < 0.15 for t in m.terms for j, c, _ in t)
    assert near(0, 0.5) and near(1, 0.3)
    assert {h[0] for t in m.terms for h in t} >= {0, 1} and np.corrcoef(m(x), share)[0, 1] > 0.97


def test_models_take_no_rows(spark):
    x, y, fold, w = sample(60, 2, 14)
    df = rows(spark, x, y, fold, w)
    blocks = learners.packed(df, [None], len(y))
    for fit in algorithms.LEARNERS.values():
        assert len(fit(df, blocks, 2, 1, {"n_estimators": 2, "pairs": 1})[0](x[:0])) == 0
