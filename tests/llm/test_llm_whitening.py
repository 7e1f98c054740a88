import math

import numpy as np
import pytest

from nichesearch.llm import whitening

VECTORS = "vec_id long, embedding array<float>, n long, component int, label string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 1, "x") for i, v in zip(ids, vectors, strict=True)], VECTORS)


def brute(vectors):
    """Components and values of exact whole numbers, by a dense solver."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    return x, s, z, values[::-1], vecs[:, ::-1]


def check(spark, vectors, components, tolerance=1e-7):
    x, s, z, values, vecs = brute(vectors)
    n = len(x)
    rows = whitening.query(table(spark, vectors)).collect()
    assert len(rows) == n * components
    for r in rows:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
        assert abs(abs(r["whitened"]) - abs(z[i] @ vecs[:, c] / math.sqrt(values[c]))) < tolerance
        assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    signs = {}
    for r in rows:
        w = z[r["vec_id"]] @ vecs[:, r["component"] - 1]
        if abs(w) > 1e-3:
            signs.setdefault(r["component"], set()).add(math.copysign(1, r["whitened"] * w))
    assert all(len(v) == 1 for v in signs.values())


def test_a_flat_spectrum_expands_to_the_full_dimension(spark):
    vectors = np.random.default_rng(1).normal(size=(150, 48))
    check(spark, vectors, 32)
    assert whitening.fit(table(spark, vectors))["expanded"]


def test_a_steep_spectrum_needs_the_random_basis_alone(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    vectors = rng.normal(size=(200, 60)) * np.r_[1000.0 / 1.6 ** np.arange(10), np.full(50, 1e-3)] @ basis.T
    model = whitening.fit(table(spark, vectors), components=4)
    assert not model["expanded"] and model["residual"] <= whitening.TOLERANCE
    _, _, _, values, vecs = brute(vectors)
    assert np.allclose(model["values"], values[:4], rtol=1e-10)
    assert np.allclose(np.abs((model["vectors"] * vecs[:, :4]).sum(axis=0)), 1, atol=1e-10)


def test_fewer_dimensions_than_components(spark):
    check(spark, np.random.default_rng(3).normal(size=(40, 5)), 5)


def test_rows_that_do_not_count(spark):
    good = np.random.default_rng(4).normal(size=(30, 4)).tolist()
    bad = [None, [1, 2, None, 4], [1, 2, float("nan"), 4], [float("inf"), 0, 0, 0], [], [1, 2, 3]]
    ids = [*range(30), *range(100, 106)]
    got = whitening.query(table(spark, good + bad, ids)).toPandas()
    assert set(got["vec_id"]) == set(range(30)) and set(got["n"]) == {30}
    _, _, z, values, vecs = brute(good)
    first = got[got["component"] == 1].set_index("vec_id")["whitened"]
    assert np.allclose(np.abs(first.loc[range(30)]), np.abs(z @ vecs[:, 0]) / math.sqrt(values[0]))


def test_repeated_rows_null_ids_and_ties_count(spark):
    vectors = np.random.default_rng(5).normal(size=(20, 3)).tolist() * 2
    got = whitening.query(table(spark, vectors, [*range(20), *[None] * 20])).toPandas()
    assert len(got) == 120 and set(got["n"]) == {40} and got["vec_id"].isna().sum() == 60
    square = [[1, 0], [-1, 0], [0, 1], [0, -1]]  # equal eigenvalues
    got = whitening.query(table(spark, square)).toPandas()
    assert got["identity_error"].max() < 1e-9 and len(got) == 8 and np.allclose(got["explained"], 0.5)


def test_vanishing_components_are_left_out(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(-50, 50, 40), rng.integers(-50, 50, 40)
    got = whitening.query(table(spark, np.c_[a, b, a + b, np.full(40, 7)])).toPandas()
    assert set(got["component"]) == {1, 2} and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1, 2]], [[1, 2], [1, 2]], [[float("nan")]]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.query(table(spark, vectors)).count() == 0


def test_great_entries_and_exact_deviations(spark):
    vectors = [[1e30, 0], [-1e30, 1], [3.0, 2], [5.5, 3]]
    got = whitening.query(table(spark, vectors)).toPandas()
    assert set(got["component"]) == {1}  # the second vanishes beside it
    assert got[got["deviation"].isna()]["vec_id"].tolist() == [0, 1] and len(got) == 4
    x = np.array([[1, 2], [3, 5]], np.int64)
    assert whitening.deviations(x, 2, [4, 7]) == [(2 - 4) ** 2 + (4 - 7) ** 2, (6 - 4) ** 2 + (10 - 7) ** 2]
    assert whitening.deviations(np.array([[10**6]], np.int64), 10**13, [0]) == [None]


def test_sums_are_exact(spark):
    vectors = [[2.0**40, -(2.0**40)]] * 50 + [[1.0, 1.0]]
    rows, d = whitening._valid(table(spark, vectors))
    n, s = whitening.sums(rows, d)
    assert (n, s) == (51, [50 * (2**46 + 10**6) + 64 + 10**6, 50 * (-(2**46) + 10**6) + 64 + 10**6])
