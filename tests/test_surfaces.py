"""Models as artifacts, and surfaces through GeoTIFFs."""

import json

import numpy as np
import pytest

from nichesearch import ArtifactStore, CandidatePlan, MethodSpec, VirtualDataSource, execute_candidate
from nichesearch.operators import learners, surfaces
from nichesearch.plans import executor
from nichesearch.plans.builtin import extended_registry
from nichesearch.sources import rasters

from .fields import layers, npy, tiff
from .test_execution import method
from .test_learners import rows, sample


@pytest.mark.parametrize("kind", ["logistic", "gbm", "maxent", "gam", "mars"])
def test_models_survive_json(spark, kind):
    from nichesearch.operators import algorithms

    x, y, fold, w = sample(200, 2, 1, 0.1 if kind == "gbm" else 0.0)
    df = rows(spark, x, y, fold, w)
    blocks = learners.packed(df, [None], len(y))
    model = algorithms.LEARNERS[kind](df, blocks, 2, 1, {"n_estimators": 6, "classes": ("linear", "hinge", "threshold")})[0]
    text = json.dumps(surfaces.plain(model))
    back = surfaces.from_plain(json.loads(text))
    assert np.array_equal(back(x), model(x)) and json.dumps(surfaces.plain(back)) == text
    with pytest.raises(TypeError):
        surfaces.plain(object())
    with pytest.raises(ValueError):
        surfaces.from_plain({"kind": "other"})


def test_a_surface_is_read_back_as_it_was_written(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(45, 70))
    values[rng.random(values.shape) < 0.1] = np.nan
    values[:20, :20] = np.nan
    cells = [(r, c, None if np.isnan(values[r, c]) else float(values[r, c])) for r in range(45) for c in range(70) if not (r < 20 and c < 20)]
    cells += [(-1, 0, 1.0), (45, 0, 1.0), (3, 70, 1.0), (30, 30, -1e9)]  # outside, and a second value of a cell
    df = spark.createDataFrame(cells, "row int, col int, value double").repartition(5)
    rasters.write_surface(df, str(tmp_path / "s"), 45, 70, (0.5, 0.0, 10.0, 0.0, -0.5, 50.0), tile=20)
    found = np.full((45, 70), np.nan)
    for r in rasters.read_surface(spark, str(tmp_path / "s"), tile=20).collect():
        found[r.row, r.col] = np.nan if r.value is None else r.value
    values[30, 30] = values[30, 30] if values[30, 30] == values[30, 30] else -1e9
    assert np.array_equal(found, values, equal_nan=True)
    tiles = spark.read.parquet(str(tmp_path / "s" / "tiles")).collect()
    assert len(tiles) == 3 * 4 - 1
    one = next(t for t in tiles if (t.tile_row, t.tile_col) == (1, 2))
    head = rasters.decode("x.tif", (tmp_path / "s" / "layers" / one.file).read_bytes())
    assert head["transform"] == (0.5, 0.0, 30.0, 0.0, -0.5, 40.0) and head["crs"] == "EPSG:4326"


@pytest.mark.parametrize("algorithm", ["logistic", "gam"])
def test_the_models_of_a_run_score_its_grid(spark, tmp_path, algorithm):
    v = layers(0.05)
    v["temp"][3, 4] = np.nan
    paths = [tiff(tmp_path / f"{n}.tif", x) for n, x in v.items()]
    plan = CandidatePlan("c", VirtualDataSource(paths, (1.6, -0.9), n_presences=150, n_absences=150), method(algorithm))
    store = ArtifactStore(tmp_path / "store", spark)
    done = [execute_candidate(spark, plan, extended_registry(), store, run, resume=True) for run in ("one", "two")]
    assert not done[0].failed, done[0].failure_reason
    assert done[0].step_records[-1].artifacts == done[1].step_records[-1].artifacts  # read back with its model
    found = executor.predicted_surface(spark, store, done[1], str(tmp_path / "surface"))
    kept = json.loads(store.read_bytes(done[0].step_records[-1].artifacts[-1]))
    assert kept["predictors"] == ["temp", "precip"]
    z = (np.stack([v["temp"], v["precip"]], axis=-1) - kept["mean"]) / kept["sd"]
    want = surfaces.from_plain(kept["model"])(z.reshape(-1, 2)).reshape(60, 60)
    got = {(r.row, r.col): r.value for r in found.collect()}
    assert len(got) == 3600 and got.pop((3, 4)) is None
    assert all(x == pytest.approx(want[k], abs=1e-12) for k, x in got.items())
