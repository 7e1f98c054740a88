import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichesearch import ArtifactStore, CandidatePlan, MethodologySpec, MethodSpec, RealDataSource, VirtualDataSource, default_registry, execute_candidate, execute_run, load_data_source, profile_context, propose
from nichesearch.operators import algorithms, stages
from nichesearch.plans import digest, executor
from nichesearch.sources import rasters
from nichesearch.streaming import occurrences as stream

from .fields import layers, npy, table, tiff
from .test_search import Fake


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    return npy(tmp_path_factory.mktemp("flat"), layers(0.05))


@pytest.fixture(scope="module")
def species(flat):
    return VirtualDataSource(flat, (1.6, -0.9), n_presences=150, n_absences=150)


def method(algorithm="logistic", split="spatial_block", background=None, cleaning="drop_duplicate_cells", **params):
    return MethodologySpec(MethodSpec(cleaning), MethodSpec("full_extent"), MethodSpec("standardize"), MethodSpec(split, {"n_folds": 4, "block_size": 12}), MethodSpec(algorithm, params), background)


def test_a_candidate_runs_and_repeats(spark, tmp_path, species):
    store = ArtifactStore(tmp_path)
    run = lambda seed: execute_candidate(spark, CandidatePlan("c", species, method(), random_seed=seed), default_registry(), store, f"r{seed}")
    a, b, c = run(42), run(42), run(7)
    assert not a.failed and [s.stage for s in a.step_records] == ["data_source", "cleaning", "accessible_area", "predictors", "split", "algorithm"]
    assert 0.5 < a.metrics["auc_mean"] <= 1 and a.metrics["n_folds"] == 4 and a.metrics["n_scored_folds"] <= 4
    assert a.metrics == b.metrics != c.metrics
    assert a.metrics["n_records"] == a.step_records[1].metrics["n_records"]
    files = sorted(p.name for p in (tmp_path / "runs/r42/candidates/c/steps").iterdir() if p.suffix == ".json")
    assert files == ["00-data_source.json", "01-cleaning.json", "02-accessible_area.json", "03-predictors.json", "04-split.json", "05-algorithm.json"]
    assert [[x.digest for x in s.artifacts] for s in a.step_records[:2]] == [[x.digest for x in s.artifacts] for s in b.step_records[:2]]
    kept = store.read_table(spark, a.step_records[0].artifacts[1])
    assert kept.count() == 300


def test_a_real_twin_has_the_same_metrics(spark, tmp_path, species, flat):
    ctx, _ = load_data_source(spark, species, 42)
    rows = [(r.row, r.col, r.label) for r in ctx.occurrences.orderBy("record_id").collect()]
    path = table(tmp_path / "twin.csv", ("row", "col", "presence"), rows)
    twin = RealDataSource(path, flat, "presence_absence")
    real, _ = load_data_source(spark, twin, 42)
    assert sorted((r.row, r.col, r.label) for r in real.occurrences.collect()) == sorted(rows)
    result = execute_candidate(spark, CandidatePlan("t", twin, method()), default_registry(), ArtifactStore(tmp_path), "r")
    own = execute_candidate(spark, CandidatePlan("v", species, method()), default_registry(), ArtifactStore(tmp_path), "r")
    assert result.metrics["auc_mean"] == pytest.approx(own.metrics["auc_mean"], abs=1e-9)


def test_gaps_crashes_and_backlog(spark, tmp_path, species):
    registry = default_registry()
    registry.register(Fake("broken", "cleaning", "explode"))
    biased = species.replace(sampling_bias="roads")
    plans = [CandidatePlan("a", species, method("maxent")), CandidatePlan("b", species, method(cleaning="explode")), CandidatePlan("c", biased, method())]
    plans += [CandidatePlan("d", species, method("maxent"))]
    plans += [plans[0].replace(candidate_id="e", unsupported_steps=(plans_gap := registry.resolve("split", MethodSpec("x")).gap,))]
    store = ArtifactStore(tmp_path)
    result = execute_run(spark, plans, registry, store, run_id="r")
    a, b, c, d, e = result.candidates
    assert all(x.failed for x in result.candidates) and a.step_records[-1].backend == "<unresolved>"
    assert "cleaning/explode raised RuntimeError: broken" == b.failure_reason and not c.step_records and not e.step_records
    ranked = {(r.code, r.requested_value): r.n for r in executor.backlog(executor.gaps_table(spark, result)).collect()}
    assert ranked == {("unsupported_algorithm", "maxent"): 2, ("unsupported_sampling_bias", "roads"): 1, ("unsupported_split", "x"): 1} and plans_gap
    manifest = json.loads((tmp_path / "runs/r/manifest.json").read_text())
    assert result.manifest.is_reproducible and manifest["run_id"] == "r" and (tmp_path / "runs/r/result.json").exists()


def test_presence_only_with_background(spark, tmp_path, flat):
    source = VirtualDataSource(flat, (1.6, -0.9), occurrence_type="presence_only", n_presences=60)
    plan = CandidatePlan("p", source, method(background=MethodSpec("random", {"n_background": 9000})))
    result = execute_candidate(spark, plan, default_registry(), ArtifactStore(tmp_path), "r")
    assert not result.failed and result.metrics["n_background"] == 3600
    assert "background_capped_by_extent" in {a.code for s in result.step_records for a in s.assumptions}


def test_from_profile_to_run(spark, tmp_path, species):
    registry = default_registry()
    ctx, _ = load_data_source(spark, species, 42)
    profile, _ = profile_context(ctx, registry)
    plans, _, gaps = propose(species, registry, profile=profile, max_candidates=1)
    result = execute_run(spark, plans, registry, ArtifactStore(tmp_path), run_id="r")
    assert not gaps and len(result.candidates) == 1 and not result.candidates[0].failed


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    w = np.zeros(3)
    a = np.column_stack([np.ones(300), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([0, 1, 1]), a.T @ (p - y) + np.array([0, 1, 1]) * w)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), i % 3) for i in range(300)], "record_id long, label int, features array<double>, fold int")
    scored, metrics, model, _ = algorithms.cross_validate(df, "logistic", {}, 1)
    assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-6)
    assert metrics["n_scored_folds"] == 3 and scored.filter("cv_prediction is null").isEmpty()
    _, boosted, _, _ = algorithms.cross_validate(df, "gbm", {"n_estimators": 5}, 1)
    assert boosted["auc_mean"] > 0.7


def test_single_class_folds_are_skipped(spark):
    rows = [(i, int(i % 2 == 0 and i % 3 != 0), [float(i % 7)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, label int, features array<double>, fold int")
    scored, metrics, _, said = algorithms.cross_validate(df, "logistic", {}, 1)
    assert metrics["n_scored_folds"] == 2 and said[0].code == "folds_skipped_single_class" and scored.filter("cv_prediction is null").count() == 20
    with pytest.raises(ValueError):
        algorithms.cross_validate(df.withColumn("label", F.lit(1)), "logistic", {}, 1)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    assert stages.auc(df).first()["auc"] == pytest.approx(want)
    assert stages.auc(df.filter("label = 1")).first()["auc"] is None


def test_folds_are_balanced_blocks_whole_and_duplicates_first(spark):
    rows = [(i, i // 7 % 20, i % 7 * 3, i % 2) for i in range(280)]
    occ = spark.createDataFrame(rows, "record_id long, row int, col int, label int")
    sizes = [r["count"] for r in stages.random_kfold(occ, 3, 1).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    blocks = stages.spatial_block_folds(occ, 5, 3, 1)
    assert blocks.groupBy("block_row", "block_col").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    kept = stages.drop_duplicate_cells(occ.unionByName(occ.withColumn("record_id", F.col("record_id") + 1000)))
    assert kept.agg(F.max("record_id")).first()[0] < 1000 and kept.count() == occ.select("row", "col", "label").distinct().count()


def test_digests_and_store(spark, tmp_path):
    d = digest.digest_obj
    assert d({"a": 1, "b": 2}) == d({"b": 2, "a": 1}) and d(1) != d(1.0) != d("1.0") and d(np.zeros(4)) != d(np.zeros((2, 2))) != d(np.zeros((2, 2), "f4"))
    with pytest.raises(TypeError):
        d(object())
    store = ArtifactStore(tmp_path)
    a, b = store.put_bytes("x", b"data", "text/plain"), store.put_bytes("y", b"data", "text/plain")
    assert a.digest == b.digest and len([p for p in (tmp_path / "artifacts").iterdir() if p.suffix != ".crc"]) == 1 and store.read_bytes(a) == b"data"
    assert store.put_json("j", {"a": 1}).path.endswith(".json") and store.put_array("z", np.arange(3)).digest != store.put_array("z", np.arange(4)).digest
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert digest.digest_table(df) == digest.digest_table(df.orderBy(F.desc("id")).select("x", "id")) != digest.digest_table(df.filter("id > 0"))
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert digest.digest_files(spark, str(tmp_path / "f.bin")).first()["sha256"] == digest.digest_file(tmp_path / "f.bin") == digest.digest_bytes(b"abc")


def test_occurrences_as_a_stream(spark, tmp_path):
    grid = rasters.read_predictors(spark, [tiff(tmp_path / "t.tif", layers()["temp"])])
    (tmp_path / "in").mkdir()
    table(tmp_path / "in" / "a.csv", ("lon", "lat", "presence", "date"), [(10.5, 49.5, "1", "2020-01-05"), ("x", 1, "1", ""), (11.5, 48.5, "maybe", "2020-01-06")])
    table(tmp_path / "in" / "b.csv", ("lon", "lat", "presence", "date"), [(99, 9, "0", "2020-01-05"), (12.5, 49.5, "0", "2021-06-01")])
    parsed = stream.read_stream(spark, str(tmp_path / "in"), ["lon", "lat", "presence", "date"], grid, "EPSG:4326")
    q = stream.running_losses(parsed).writeStream.outputMode("complete").format("memory").queryName("losses").start()
    m = stream.monthly(parsed).writeStream.outputMode("append").format("memory").queryName("monthly").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    m.processAllAvailable()
    assert tuple(spark.table("losses").first()) == (5, 1, 1, 0, 1)
    assert sum(r.n for r in spark.table("monthly").collect()) == 2
    q.stop()
    m.stop()


def test_selection_and_the_boyce_index(spark, species):
    from nichesearch import CandidateResult, RunManifest, RunResult
    from nichesearch.operators import selection

    done = [CandidateResult(CandidatePlan(i, species, method()), metrics={"auc_mean": m, "auc_sd": s}) for i, m, s in (("a", 0.8, 0.1), ("b", 0.82, 0.3), ("c", 0.8, 0.1))]
    run = RunResult(RunManifest("r", "spatial_transfer", "d", "now"), (*done, CandidateResult(done[0].plan, failed=True)))
    chosen = selection.select(run)
    assert chosen.selected == "a" and chosen.candidates[0].score.total == pytest.approx(0.75) and chosen.candidates[3].score is None
    assert selection.select(RunResult(run.manifest)).selected is None
    good = spark.createDataFrame([(int(j < i), (i + 0.5) / 10) for i in range(10) for j in range(10)], "label int, score double")
    assert selection.boyce(good).first()[0] == pytest.approx(1.0)
    bad = good.withColumn("score", 1 - F.col("score"))
    assert selection.boyce(bad).first()[0] == pytest.approx(-1.0)


def test_infinity_survives_json():
    from nichesearch.profile import EnvironmentalProfile

    assert json.loads(EnvironmentalProfile(2, 1.0, math.inf, 1.0, None).to_json())["max_vif"] == "Infinity"


def test_first_records_of_cells_are_found_without_a_sort(spark):
    """By aggregation, with the row that a window gives; columns of other types take the window still."""
    rows = [(i * 7919 % 1000, i % 5, i % 3, i % 2, None if i % 4 else 19000 + i) for i in range(400)]
    occ = spark.createDataFrame(rows, "record_id long, row int, col int, label int, day int").withColumn("obs_date", F.date_from_unix_date("day")).drop("day")
    kept = stages.drop_duplicate_cells(occ)
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    want = stages.drop_duplicate_cells(occ.withColumn("more", F.array("row"))).drop("more")
    assert kept.columns == occ.columns and sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))


def test_row_digests_are_sums_of_marks(spark):
    """Negative marks and empty tables too: the digest is that of exact decimal sums."""
    for df in (spark.range(-500, 500).withColumn("x", F.col("id") * 3), spark.range(0), spark.range(1)):
        columns = sorted(df.schema.fields, key=lambda f: f.name)
        marks = [F.xxhash64(F.lit(seed), *[digest._mark(F.col(f.name), f.dataType, seed) for f in columns]) for seed in ("first", "second")]
        sums = df.agg(F.count("*"), *[F.sum(m.cast("decimal(38,0)")) for m in marks]).first()
        assert digest.digest_table(df) == digest.digest_obj([sorted(df.dtypes), [str(v) for v in sums]])
