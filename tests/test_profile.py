import datetime

import numpy as np
import pytest

from nichesearch import MethodSpec, SdmContext, build_profile, default_registry, profile_context
from nichesearch.operators import profile_stats

from .fields import SIDE, layers


@pytest.fixture(scope="module")
def context(spark):
    def make(values=None, records=(), kind="presence_absence", dates=None):
        values = values or layers()
        names = tuple(values)
        cube = np.stack(list(values.values()))
        cells = [(r, c, [None if np.isnan(v) else float(v) for v in cube[:, r, c]]) for r in range(cube.shape[1]) for c in range(cube.shape[2])]
        grid = spark.createDataFrame(cells, "row int, col int, predictors array<double>").cache()
        rows = [(i, *r, dates[i] if dates else None) for i, r in enumerate(records)]
        occ = spark.createDataFrame(rows, "record_id long, row int, col int, label int, obs_date date")
        return SdmContext(grid, occ, names, cube.shape[1], cube.shape[2], kind, has_dates=dates is not None)

    return make


def scattered(n, side=SIDE, seed=1, label=lambda i: i % 2):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b), label(i)) for i, (a, b) in enumerate(rng.integers(0, side, (n, 2)))]


def test_volume_and_time(context):
    records = [(5, 5, 1), (5, 5, 1), (6, 6, 1), (7, 7, 0)]
    days = [datetime.date(y, 1, 1) for y in (2018, 2019, 2020, 2021)]
    p, _ = build_profile(context(records=records, dates=days))
    v = p.volume
    assert (v.n_records, v.n_unique_cells, v.n_presences, v.n_absences, v.prevalence, v.duplicate_fraction) == (4, 3, 3, 1, 0.75, 0.25)
    assert p.temporal.span_days == 1096 and p.temporal.first_date == "2018-01-01" and p.temporal.median_records_per_year == pytest.approx(4 / (1096 / 365.25))
    assert p.is_small_sample
    only, said = build_profile(context(records=records, kind="presence_only", dates=[None] * 4))
    assert only.volume.prevalence is None and only.temporal is None and "no_usable_dates" in {a.code for a in said}


def test_spacing_equals_brute_force_and_tells_clusters(spark):
    rng = np.random.default_rng(0)
    for cells in ({tuple(map(int, c)) for c in rng.integers(0, 60, (200, 2))}, {tuple(map(int, c)) for c in rng.integers(0, 6, (30, 2))} | {(59, 59), (0, 59)}, {(0, 0), (59, 59)}):
        x = np.array(sorted(cells), float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        df = spark.createDataFrame([(int(a), int(b)) for a, b in x], "row int, col int")
        s = profile_stats.spacing(df, 3600).first()
        assert s[0] == pytest.approx(d.min(1).mean()) and s[1] == pytest.approx(d.min(1).mean() / (0.5 * np.sqrt(3600 / len(x))))
        assert len(x) != 2 or s[1] > 0.8
    cluster = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "row int, col int")
    assert profile_stats.spacing(cluster, 3600).first()[1] < 0.8
    lone = spark.createDataFrame([(1, 1)], "row int, col int")
    assert tuple(profile_stats.spacing(lone, 3600).first()) == (0.0, 1.0)


def smooth(scale, seed=3):
    """Noise averaged over a square of 2 * scale + 1 cells."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(SIDE + 2 * scale, SIDE + 2 * scale))
    return np.lib.stride_tricks.sliding_window_view(v, (2 * scale + 1, 2 * scale + 1)).mean(axis=(2, 3))


def test_smoother_landscapes_have_longer_ranges_and_trends_none(context):
    rough, _ = build_profile(context({"a": smooth(0)}, scattered(100)))
    long, _ = build_profile(context({"a": smooth(6)}, scattered(100)))
    assert long.spatial.autocorrelation_range_cells > rough.spatial.autocorrelation_range_cells
    r, c = np.meshgrid(np.arange(SIDE), np.arange(SIDE), indexing="ij")
    trend, said = build_profile(context({"a": (r + c) * 1.0}, scattered(100)))
    assert not trend.spatial.autocorrelation_range_bounded and "autocorrelation_range_unbounded" in {a.code for a in said}
    assert trend.suggested_block_size() == 15 and trend.suggested_block_size(6) == 10


def test_shift_coverage_and_breadth(context):
    even, _ = build_profile(context(records=scattered(300)))
    corner, _ = build_profile(context(records=scattered(300, side=12)))
    assert corner.sampling.covariate_shift > even.sampling.covariate_shift + 0.3
    assert even.sampling.environmental_coverage > 0.95 > corner.sampling.environmental_coverage
    assert corner.environmental.niche_breadth < even.environmental.niche_breadth
    assert build_profile(context(records=[(1, 1, 1), (2, 2, 0)]))[0].environmental.niche_breadth is None


def test_collinearity(context):
    t = layers()["temp"]
    twin, _ = build_profile(context({"a": t, "b": t * 2 + 1e-6 * smooth(0)}, scattered(50)))
    free, _ = build_profile(context({"a": smooth(0), "b": smooth(0, 9), "flat": np.ones((SIDE, SIDE))}, scattered(50)))
    assert twin.environmental.max_abs_correlation > 0.99 and twin.environmental.max_vif > 100 and twin.environmental.effective_dimensionality < 1.1
    assert free.environmental.max_abs_correlation < 0.2
    m = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    values = np.linalg.eigvalsh(m)
    high, vif, dims = profile_stats.collinearity(m)
    assert (high, vif) == (0.5, pytest.approx(np.diag(np.linalg.inv(m)).max())) and dims == pytest.approx(values.sum() ** 2 / (values**2).sum())
    assert profile_stats.collinearity(np.ones((2, 2)))[1] == float("inf") and profile_stats.collinearity(np.eye(1)) == (0.0, 1.0, 1.0)


def test_nodata_records_are_left_out_and_counted(context):
    values = layers()
    values["temp"][:5] = np.nan
    p, said = build_profile(context(values, [(1, 1, 1), (2, 2, 0), (30, 30, 1), (31, 31, 1), (32, 2, 0)]))
    assert p.spatial.extent_cells == 55 * 60
    assert [a.message[:1] for a in said if a.code == "profile_excluded_nodata_records"] == ["2"]


def test_profilers_are_looked_up(context):
    registry = default_registry()
    assert profile_context(context(records=scattered(30)), registry)[0] is not None
    assert profile_context(context(records=scattered(30)), registry, MethodSpec("fancy")) == (None, [])
