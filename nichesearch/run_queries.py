"""Registered queries that go through files: sources, profile, proposal, execution, artifacts.

The driver's grid and occurrences are written as rasters and a CSV into the shared folder and
read back by the library's own readers.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries
from .functions import files
from .functions.caching import hold, scope
from .operators import algorithms, learners, maxent, selection, stages
from .plans import cards, digest, executor, priors, proposer
from .plans.builtin import default_registry, profile_context
from .plans.store import ArtifactStore
from .queries import _NICHE, _RANGE, _SHIFT, _USABLE, BETA, BLOCK, FOLDS, INTERCEPT, SEED, SIDE, TRANSFORM, K, _R, _u, query, six
from .schema import CandidatePlan, MethodologySpec, MethodSpec, RealDataSource, RunResult, UnsupportedDataSource, VirtualDataSource
from .sources import loader, rasters


def _fixture(spark: SparkSession, sf: str) -> str:
    """A folder with p1 and p2 as .npy and .tif, and the occurrences as CSV in world coordinates."""
    if not files.exists(spark, folder := _written(spark, sf)):  # the shared folder was emptied
        _written.cache_clear()
        folder = _written(spark, sf)
    return folder


@lru_cache(maxsize=8)
def _written(spark: SparkSession, sf: str) -> str:
    folder = files.shared_folder(spark, "fixture")
    values = np.full((K, SIDE, SIDE), np.nan)
    for r in queries.grid(spark, sf).toLocalIterator():  # at most SIDE * SIDE cells
        values[:, r["row"], r["col"]] = [math.nan if v is None else v for v in r["predictors"]]
    for name, layer in zip(("p1", "p2"), values, strict=True):
        files.save(spark, f"{folder}/{name}.npy", rasters.npy_bytes(layer))
        files.save(spark, f"{folder}/{name}.tif", rasters.tiff_bytes(layer, TRANSFORM))
    status = F.when(F.col("label") == 1, "PRESENT").otherwise("absent")
    world = queries.occ(spark, sf).select((10 + F.col("col") + F.lit(0.5)).alias("decimalLongitude"), (50 - F.col("row") - F.lit(0.5)).alias("decimalLatitude"), status.alias("occurrenceStatus"), F.col("obs_date").cast("string").alias("eventDate"))
    world.write.option("header", True).csv(f"{folder}/occurrences")
    world.select("decimalLongitude", F.lit(1).alias("northing")).limit(1).write.option("header", True).csv(f"{folder}/odd")
    return folder


def _layers(folder: str, suffix: str) -> tuple[str, ...]:
    return f"{folder}/p1{suffix}", f"{folder}/p2{suffix}"


def _real(spark: SparkSession, sf: str, **more) -> RealDataSource:
    folder = _fixture(spark, sf)
    return RealDataSource(**({"occurrences_path": f"{folder}/occurrences", "predictor_paths": _layers(folder, ".tif"), "occurrence_type": "presence_absence"} | more))


def _stack(grid: rasters.Grid) -> DataFrame:
    return grid.cells.select("row", "col", *[F.get("predictors", F.lit(i)).alias(n) for i, n in enumerate(grid.names)])


_EVERY_CELL = f'SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS col, p1, p2 FROM range({SIDE}) r(i) CROSS JOIN range({SIDE}) c(i) LEFT JOIN grid ON grid."row" = r.i AND grid.col = c.i'


@query(_EVERY_CELL)
def npy_stack(spark, sf):
    return _stack(rasters.read_predictors(spark, _layers(_fixture(spark, sf), ".npy")))


@query(_EVERY_CELL)
def geotiff_stack(spark, sf):
    return _stack(rasters.read_predictors(spark, _layers(_fixture(spark, sf), ".tif")))


@query(f"SELECT true AS georeferenced, '1.0,0.0,10.0,0.0,-1.0,50.0' AS transform, 'EPSG:4326' AS crs, 'p1,p2' AS names, CAST({SIDE} AS INT) AS height, CAST({SIDE} AS INT) AS width")
def grid_header(spark, sf):
    g = rasters.read_predictors(spark, _layers(_fixture(spark, sf), ".tif"))
    return spark.createDataFrame([(g.is_georeferenced, ",".join(map(str, g.transform)), g.crs, ",".join(g.names), *g.shape)], "georeferenced boolean, transform string, crs string, names string, height int, width int")


@query('SELECT "row", col, label, CAST(obs_date AS VARCHAR) AS obs_date, count(*) AS n FROM occ GROUP BY ALL')
def load_real_source(spark, sf):
    context, _ = loader.load_data_source(spark, _real(spark, sf), SEED)
    return context.occurrences.groupBy("row", "col", "label", F.col("obs_date").cast("string").alias("obs_date")).agg(F.count("*").alias("n"))


@query(
    _NICHE
    + f"""SELECT "row", col, 1 AS label FROM (SELECT "row", col FROM niche WHERE s > 0 ORDER BY -ln({_u("presence", "\"row\" || ':' || col")}) / s, "row", col LIMIT 150)
UNION ALL SELECT "row", col, 0 FROM (SELECT "row", col FROM niche WHERE 1 - s > 0 ORDER BY -ln({_u("absence", "\"row\" || ':' || col")}) / (1 - s), "row", col LIMIT 120)"""
)
def load_virtual_source(spark, sf):
    source = VirtualDataSource(_layers(_fixture(spark, sf), ".npy"), BETA, INTERCEPT, n_presences=150, n_absences=120)
    return loader.load_data_source(spark, source, SEED)[0].occurrences.select("row", "col", "label")


_GAPS = [
    ("absent occurrences", "missing_occurrence_file", "occurrence_format"),
    ("absent raster", "unreadable_raster", "predictor_format"),
    ("biased sampling", "unsupported_sampling_bias", "sampling_bias"),
    ("half georeferenced", "mixed_predictor_georeferencing", "predictor_format"),
    ("no transform", "ungeoreferenced_predictors", "occurrence_format"),
    ("odd columns", "unrecognised_occurrence_columns", "occurrence_format"),
    ("odd suffix", "unsupported_predictor_format", "predictor_format"),
]


@query(f"SELECT * FROM {queries._values(_GAPS)} AS g(case_name, code, feature)")
def source_gaps(spark, sf):
    """The typed gap of every source that can't be loaded."""
    folder = _fixture(spark, sf)
    cases = {
        "absent occurrences": _real(spark, sf, occurrences_path=f"{folder}/nowhere.csv"),
        "absent raster": _real(spark, sf, predictor_paths=(f"{folder}/p3.tif",)),
        "biased sampling": VirtualDataSource(_layers(folder, ".npy"), BETA, sampling_bias="roads"),
        "half georeferenced": _real(spark, sf, predictor_paths=(f"{folder}/p1.npy", f"{folder}/p2.tif")),
        "no transform": _real(spark, sf, predictor_paths=_layers(folder, ".npy")),
        "odd columns": _real(spark, sf, occurrences_path=f"{folder}/odd"),
        "odd suffix": _real(spark, sf, predictor_paths=(f"{folder}/p1.asc",)),
    }
    rows = []
    for name, source in cases.items():
        try:
            loader.load_data_source(spark, source, SEED)
        except UnsupportedDataSource as e:
            rows.append((name, e.gap.code, e.gap.feature))
    return spark.createDataFrame(rows, "case_name string, code string, feature string")


# --- profile and proposal, measured on what was read

_MEASURED = (
    _RANGE
    + _SHIFT.removeprefix("")
    + f""", cells1 AS (SELECT DISTINCT "row", col FROM occ),
near AS (SELECT a."row", a.col, min(sqrt((a."row" - b."row") ** 2 + (a.col - b.col) ** 2)) AS d FROM cells1 a JOIN cells1 b ON a."row" <> b."row" OR a.col <> b.col GROUP BY 1, 2),
facts AS (SELECT (SELECT count(*) FROM cells1) AS n_cells, (SELECT count(*) FROM valid) AS extent,
  (SELECT avg(d) / (0.5 * sqrt((SELECT count(*) FROM valid) / count(*))) FROM near) AS nni, (SELECT (abs(a1 - m1) / s1 + abs(a2 - m2) / s2) / 2 FROM l, a) AS moved,
  (SELECT {_R} FROM land) AS r, (SELECT least(greatest(1, ceil(reach)), {max(1, SIDE // 4)}) FROM found) AS block)"""
)


@lru_cache(maxsize=8)
def _profile(spark: SparkSession, sf: str):
    with scope():
        context, _ = loader.load_data_source(spark, _real(spark, sf), SEED)
        return profile_context(context, default_registry(), seed=SEED)


_PATHS = [
    ("volume.n_records", "(SELECT count(*) FROM occ)"),
    ("volume.n_unique_cells", "n_cells"),
    ("volume.n_presences", "(SELECT sum(label) FROM occ)"),
    ("volume.n_absences", "(SELECT sum(1 - label) FROM occ)"),
    ("volume.prevalence", "(SELECT avg(label) FROM occ)"),
    ("volume.duplicate_fraction", "1 - n_cells / (SELECT count(*) FROM occ)"),
    ("spatial.extent_cells", "extent"),
    ("spatial.extent_rows", str(SIDE)),
    ("spatial.extent_cols", str(SIDE)),
    ("spatial.occupied_cells", "n_cells"),
    ("spatial.coverage_fraction", "n_cells / extent"),
    ("spatial.nearest_neighbour_index", "nni"),
    ("spatial.autocorrelation_range_cells", "(SELECT reach FROM found)"),
    ("sampling.covariate_shift", "moved"),
    ("sampling.max_univariate_shift", "(SELECT greatest(abs(a1 - m1) / s1, abs(a2 - m2) / s2) FROM l, a)"),
    ("environmental.n_predictors", "2"),
    ("environmental.max_abs_correlation", "abs(r)"),
    ("environmental.max_vif", "1 / (1 - r * r)"),
    ("environmental.effective_dimensionality", "4 / (2 + 2 * r * r)"),
    ("environmental.niche_breadth", "(SELECT (n1 / s1 + n2 / s2) / 2 FROM l, a)"),
    ("temporal.n_dated_records", "(SELECT count(obs_date) FROM occ)"),
    ("temporal.span_days", "(SELECT max(obs_date) - min(obs_date) FROM occ)"),
]


@query(_MEASURED + " " + " UNION ALL ".join(f"SELECT '{p}' AS path, round(CAST({x} AS DOUBLE), 6) AS value FROM facts" for p, x in _PATHS))
def measured_profile(spark, sf):
    """The whole profile of the source that was read back."""
    facts = priors.facts_table(spark, {"": _profile(spark, sf)[0]})
    rows = facts.select(F.ltrim("path", F.lit(".")).alias("path"), six("num", "value"))
    return rows.filter(F.col("path").isin([p for p, _ in _PATHS]))


@query(_MEASURED + " SELECT n_cells < 50 AS is_small_sample, nni < 0.8 AS is_spatially_clustered, CAST(block AS INT) AS block_size, (SELECT count(*) FROM occ) - (SELECT count(*) FROM sampled) AS n_excluded FROM facts")
def profile_flags(spark, sf):
    p, said = _profile(spark, sf)
    lost = [int(a.message.split()[0]) for a in said if a.code == "profile_excluded_nodata_records"]
    return spark.createDataFrame([(p.is_small_sample, p.is_spatially_clustered, p.suggested_block_size(), sum(lost))], "is_small_sample boolean, is_spatially_clustered boolean, block_size int, n_excluded long")


_WEIGHED = (
    _MEASURED
    + """, w AS (SELECT block, CASE WHEN n_cells < 50 THEN 1.0 ELSE 0 END AS logistic, CASE WHEN n_cells < 50 THEN -1.0 ELSE 0 END + CASE WHEN n_cells >= 300 THEN 0.7 ELSE 0 END + CASE WHEN 1 / (1 - r * r) > 10 THEN 0.5 ELSE 0 END AS gbm,
CASE WHEN nni < 0.8 THEN 1.5 ELSE 0 END + CASE WHEN moved > 0.5 THEN 1.0 ELSE 0 END + 1.5 AS spatial_block, 0.0 AS random_kfold FROM facts),
plans AS (SELECT 'logistic+spatial_block' AS candidate_id, logistic + spatial_block AS weight, CAST(block AS INT) AS block_size FROM w UNION ALL SELECT 'logistic+random_kfold', logistic + random_kfold, NULL FROM w
UNION ALL SELECT 'gbm+spatial_block', gbm + spatial_block, CAST(block AS INT) FROM w UNION ALL SELECT 'gbm+random_kfold', gbm + random_kfold, NULL FROM w)"""
)


def _proposed(spark: SparkSession, plans: list[CandidatePlan]) -> DataFrame:
    rows = [(p.candidate_id, i + 1, p.methodology.split.params.get("block_size")) for i, p in enumerate(plans)]
    return spark.createDataFrame(rows, "candidate_id string, place long, block_size int")


@query(_WEIGHED + " SELECT candidate_id, row_number() OVER (ORDER BY weight DESC, candidate_id) AS place, block_size FROM plans")
def propose_from_profile(spark, sf):
    """Plans proposed from the measured profile, with parameters that follow from it."""
    return _proposed(spark, proposer.propose(_real(spark, sf), default_registry(), profile=_profile(spark, sf)[0], random_seed=SEED, spark=spark)[0])


@query(
    _WEIGHED
    + f""", drawn AS (SELECT * FROM plans ORDER BY -ln({_u('candidate', 'candidate_id')}) / exp(weight - (SELECT max(weight) FROM plans)), candidate_id LIMIT 2)
SELECT candidate_id, row_number() OVER (ORDER BY weight DESC, candidate_id) AS place, block_size FROM drawn"""
)
def propose_from_profile_budgeted(spark, sf):
    return _proposed(spark, proposer.propose(_real(spark, sf), default_registry(), profile=_profile(spark, sf)[0], max_candidates=2, random_seed=SEED, spark=spark)[0])


@query(
    _WEIGHED
    + """ SELECT stage, method, weight FROM w, LATERAL (VALUES ('cleaning', 'drop_duplicate_cells', 0.0), ('accessible_area', 'full_extent', 0.0), ('predictors', 'standardize', 0.0),
('split', 'random_kfold', random_kfold), ('split', 'spatial_block', spatial_block), ('algorithm', 'gbm', gbm), ('algorithm', 'logistic', logistic)) AS v(stage, method, weight0), LATERAL (SELECT CAST(round(weight0, 6) AS DOUBLE) AS weight)"""
)
def explain_from_profile(spark, sf):
    rows = proposer.explain(default_registry(), _profile(spark, sf)[0], spark=spark)
    return spark.createDataFrame([(s, m, round(w, 6)) for s, m, w, _ in rows], "stage string, method string, weight double")


# --- rules over what was measured

#: Every comparison that a rule can make, over facts of the profile; the last one's fact is missing.
_ASKED = [
    ("fewer", queries._CELLS, "<", 3000.0), ("at most", queries._CELLS, "<=", 3503.0), ("more", queries._CELLS, ">", 3000.0), ("at least", queries._CELLS, ">=", 3503.0), ("equal", "profile.environmental.n_predictors", "==", 2.0),
    ("unequal", "profile.environmental.n_predictors", "!=", 2.0), ("there", queries._NNI, "not_null", None), ("missing", queries._NNI, "is_null", None), ("no fact", "profile.volume.nothing", "!=", 1.0),
]
_RULED = (
    _MEASURED
    + f""", pf(path, num, str) AS (SELECT '{queries._CELLS}', CAST(n_cells AS DOUBLE), NULL FROM facts UNION ALL SELECT '{queries._VIF}', 1 / (1 - r * r), NULL FROM facts UNION ALL SELECT '{queries._NNI}', nni, NULL FROM facts
UNION ALL SELECT '{queries._SHIFTED}', moved, NULL FROM facts UNION ALL SELECT 'profile.environmental.n_predictors', 2.0, NULL UNION ALL SELECT 'objective', NULL, 'spatial_transfer'),
methods AS (SELECT * FROM {queries._values(queries._METHODS)} AS m(stage, method)),
rules AS (SELECT * FROM {queries._values(queries._RULES)} AS r(prior_id, stage, method, log_weight, path, op, txt, number)),
ap AS (SELECT prior_id, stage, method, log_weight, coalesce(CASE op WHEN '<' THEN num < number WHEN '<=' THEN num <= number WHEN '>' THEN num > number WHEN '>=' THEN num >= number WHEN '==' THEN coalesce(num = number, str = txt) END, false) AS applies FROM rules LEFT JOIN pf USING (path)),
we AS (SELECT stage, method, coalesce(sum(log_weight), 0) AS weight, coalesce(string_agg(prior_id, ',' ORDER BY prior_id), '') AS prior_ids FROM methods LEFT JOIN (SELECT * FROM ap WHERE applies) USING (stage, method) GROUP BY 1, 2),
space AS (SELECT concat_ws('+', e.method, d.method) AS candidate_id, a.weight + b.weight + c.weight + d.weight + e.weight AS weight FROM
(SELECT * FROM we WHERE stage = 'cleaning') a, (SELECT * FROM we WHERE stage = 'accessible_area') b, (SELECT * FROM we WHERE stage = 'predictors') c, (SELECT * FROM we WHERE stage = 'split') d, (SELECT * FROM we WHERE stage = 'algorithm') e)
"""
)


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return priors.facts_table(spark, {"profile": _profile(spark, sf)[0], "objective": "spatial_transfer"})


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    applied = priors.applicable(priors.conditions_table(spark, priors.DEFAULT_PRIORS), _facts(spark, sf))
    return priors.weights(proposer._methods(spark, default_registry(), "presence_absence"), applied)


def _space(spark: SparkSession, sf: str) -> DataFrame:
    return proposer.enumerate_space(_weights(spark, sf), list(proposer.REQUIRED))


@query(_RULED + "SELECT prior_id, applies FROM ap")
def prior_conditions(spark, sf):
    return priors.applicable(priors.conditions_table(spark, priors.DEFAULT_PRIORS), _facts(spark, sf)).select("prior_id", "applies")


@query(
    _RULED
    + f"""SELECT prior_id, CASE op WHEN 'is_null' THEN num IS NULL WHEN 'not_null' THEN num IS NOT NULL ELSE coalesce(CASE op WHEN '<' THEN num < number WHEN '<=' THEN num <= number WHEN '>' THEN num > number WHEN '>=' THEN num >= number WHEN '==' THEN num = number ELSE num <> number END, false) END AS applies
FROM {queries._values(_ASKED)} AS a(prior_id, path, op, number) LEFT JOIN pf USING (path)"""
)
def rule_operators(spark, sf):
    """Every operator of a condition, over measured facts and a missing one."""
    rules = tuple(priors.Prior(i, "algorithm", "gbm", 1.0, "", (priors.Condition(p, op, v),)) for i, p, op, v in _ASKED)
    return priors.applicable(priors.conditions_table(spark, rules), _facts(spark, sf)).select("prior_id", "applies")


@query(_RULED + "SELECT stage, method, round(weight, 6) AS weight FROM we")
def prior_weights(spark, sf):
    return _weights(spark, sf).select("stage", "method", six("weight", "weight"))


@query(_RULED + "SELECT stage, method, round(weight, 6) AS weight, prior_ids FROM we")
def explain_priors(spark, sf):
    return _weights(spark, sf).select("stage", "method", six("weight", "weight"), "prior_ids")


@query(_RULED + "SELECT candidate_id, round(weight, 6) AS weight, row_number() OVER (ORDER BY weight DESC, candidate_id) AS place FROM space")
def propose_candidates(spark, sf):
    place = F.row_number().over(Window.orderBy(F.desc("weight"), "candidate_id")).cast("long")  # a handful of candidates
    return _space(spark, sf).select("candidate_id", six("weight", "weight"), place.alias("place"))


@query(_RULED + f"SELECT candidate_id FROM space ORDER BY -ln({_u('candidate', 'candidate_id')}) / exp(weight - (SELECT max(weight) FROM space)), candidate_id LIMIT 2")
def propose_budgeted(spark, sf):
    return proposer.draw_candidates(_space(spark, sf), 2, SEED).select("candidate_id")


@query(_WEIGHED + " SELECT candidate_id, row_number() OVER (ORDER BY weight DESC, candidate_id) AS place, block_size, CAST((SELECT least(10000, greatest(1000, extent)) FROM facts) AS INT) AS n_background FROM plans")
def propose_presence_only(spark, sf):
    """Plans for presences alone have a background stage, whose size follows from the extent."""
    plans = proposer.propose(_real(spark, sf, occurrence_type="presence_only"), default_registry(), profile=_profile(spark, sf)[0], random_seed=SEED, spark=spark)[0]
    rows = [(p.candidate_id, i + 1, p.methodology.split.params.get("block_size"), p.methodology.background.params["n_background"]) for i, p in enumerate(plans)]
    return spark.createDataFrame(rows, "candidate_id string, place long, block_size int, n_background int")


# --- execution and artifacts


def _plan(name: str, source, algorithm: str) -> CandidatePlan:
    split = MethodSpec("spatial_block", {"n_folds": FOLDS, "block_size": BLOCK})
    return CandidatePlan(name, source, MethodologySpec(MethodSpec("drop_duplicate_cells"), MethodSpec("full_extent"), MethodSpec("standardize"), split, MethodSpec(algorithm)), random_seed=SEED)


def _executed(spark: SparkSession, sf: str) -> tuple[str, RunResult]:
    """One candidate that runs, one with a gap, one whose source has a gap; the store's folder."""
    if not files.exists(spark, _run(spark, sf)[0]):
        _run.cache_clear()
    return _run(spark, sf)


@lru_cache(maxsize=8)
def _run(spark: SparkSession, sf: str) -> tuple[str, RunResult]:
    source = _real(spark, sf)
    plans = [_plan("a", source, "logistic"), _plan("b", source, "maxent"), _plan("c", source.replace(occurrences_path="nowhere.csv"), "logistic")]
    root = files.shared_folder(spark, "store")
    return root, executor.execute_run(spark, plans, default_registry(), ArtifactStore(root, spark), run_id="run", random_seed=SEED, resume=True)


_STEPS = [
    ("a", 0, "data_source", "real", "spark-source-loader", 2, 0),
    ("a", 1, "cleaning", "drop_duplicate_cells", "spark-clean-duplicates", 1, 0),
    ("a", 2, "accessible_area", "full_extent", "spark-area-full-extent", 1, 0),
    ("a", 3, "predictors", "standardize", "spark-predictors-standardise", 1, 0),
    ("a", 4, "split", "spatial_block", "spark-split-spatial-block", 1, 0),
    ("a", 5, "algorithm", "logistic", "spark-logistic", 2, 0),
    ("b", 0, "data_source", "real", "spark-source-loader", 2, 0),
    ("b", 1, "cleaning", "drop_duplicate_cells", "spark-clean-duplicates", 1, 0),
    ("b", 2, "accessible_area", "full_extent", "spark-area-full-extent", 1, 0),
    ("b", 3, "predictors", "standardize", "spark-predictors-standardise", 1, 0),
    ("b", 4, "split", "spatial_block", "spark-split-spatial-block", 1, 0),
    ("b", 5, "algorithm", "maxent", "<unresolved>", 0, 1),
]


@query("SELECT * FROM (VALUES " + ", ".join(map(str, _STEPS)) + ") AS s(candidate_id, place, stage, method, backend, n_artifacts, n_gaps)")
def run_steps(spark, sf):
    """The step records of a run, read back from its folder."""
    root, _ = _executed(spark, sf)
    steps = spark.read.option("multiLine", True).json(f"{root}/runs/run/candidates/*/steps/*.json").select("*", F.regexp_extract("_metadata.file_name", r"^(\d+)-", 1).cast("int").alias("place"))
    return steps.select("candidate_id", "place", "stage", "method", "backend", F.size("artifacts").alias("n_artifacts"), F.size("unsupported_steps").alias("n_gaps"))


@query("SELECT * FROM (VALUES ('a', false, NULL), ('b', true, 'unsupported_algorithm'), ('c', true, 'missing_occurrence_file')) AS c(candidate_id, failed, gap)")
def run_outcomes(spark, sf):
    rows = [(c.plan.candidate_id, c.failed, c.plan.unsupported_steps[0].code if c.plan.unsupported_steps else None) for c in _executed(spark, sf)[1].candidates]
    return spark.createDataFrame(rows, "candidate_id string, failed boolean, gap string")


@query("SELECT * FROM (VALUES ('unsupported_algorithm', 'algorithm', 'maxent', 1), ('missing_occurrence_file', 'occurrence_format', NULL, 1)) AS g(code, feature, requested_value, n)")
def run_backlog(spark, sf):
    return executor.backlog(executor.gaps_table(spark, _executed(spark, sf)[1])).withColumn("n", F.col("n").cast("int"))


@query(
    _USABLE
    + f""" SELECT metric, CAST(value AS DOUBLE) AS value FROM (VALUES ('n_records', (SELECT count(*) FROM clean)), ('n_dropped', (SELECT count(*) FROM occ) - (SELECT count(*) FROM clean)), ('n_predictors', {K}),
('n_folds', {FOLDS}), ('n_blocks', (SELECT count(*) FROM ublocks)), ('n_scored_folds', (SELECT count(*) FROM scorable WHERE ok))) AS m(metric, value)"""
)
def run_metrics(spark, sf):
    """Metrics of the candidate that ran: those of later stages replace those of earlier ones."""
    found = _executed(spark, sf)[1].candidates[0].metrics
    return spark.createDataFrame([(k, v) for k, v in found.items() if not k.startswith("auc")], "metric string, value double")


@query("SELECT 'run' AS run_id, 'spatial_transfer' AS objective, true AS is_reproducible, true AS has_versions, 42 AS random_seed")
def run_manifest(spark, sf):
    root, _ = _executed(spark, sf)
    m = spark.read.option("multiLine", True).json(f"{root}/runs/run/manifest.json")
    versions = F.col("package_versions.pyspark").isNotNull()
    return m.select("run_id", "objective", ((F.length("data_digest") == 64) & versions).alias("is_reproducible"), versions.alias("has_versions"), F.col("random_seed").cast("int").alias("random_seed"))


@query(_USABLE + " SELECT fold, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS n_presences, ok AS scored, ok AS auc_is_share_of_pairs FROM scorable")
def run_folds(spark, sf):
    """The folds of the scored table that the run kept; each AUC is held against its definition, the share of ordered pairs."""
    root, result = _executed(spark, sf)
    kept = spark.read.parquet(f"{root}/{result.candidates[0].step_records[-1].artifacts[0].path}")
    rows = kept.select("fold", "label", F.col("cv_prediction").alias("score"))
    sides = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("n_presences"), F.collect_list(F.when(F.col("label") == 1, F.col("score"))).alias("ones"), F.collect_list(F.when(F.col("label") == 0, F.col("score"))).alias("zeros"))  # a fold of a fixture
    right = F.aggregate("ones", F.lit(0.0), lambda a, x: a + F.aggregate("zeros", F.lit(0.0), lambda b, y: b + F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)))
    share = F.try_divide(right, F.size("ones").cast("double") * F.size("zeros"))
    aucs = stages.auc(rows, ["fold"]).select("fold", "auc")
    return sides.join(aucs, "fold").select("fold", "n", F.col("n_presences").cast("long").alias("n_presences"), (F.size("ones") > 0).alias("scored"), (F.abs(share - F.col("auc")) < 1e-9).alias("auc_is_share_of_pairs"))


@query("""SELECT 'bytes' AS kind, n_name AS content, sha256(n_name) AS digest, true AS written_once FROM nation
UNION ALL SELECT 'json', x, sha256(x), true FROM (SELECT '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS x FROM nation)""")
def artifact_files(spark, sf):
    """A nation's name as a file, and its record as JSON, by the digest of their bytes; each is put twice and read back."""
    store = ArtifactStore(files.shared_folder(spark, "store"), spark)
    rows = []
    for r in spark.read.parquet(f"{sf}/nation.parquet").collect():  # 25 rows
        for kind, put in (("bytes", lambda n, r=r: store.put_bytes(n, r["n_name"].encode(), "text/plain")), ("json", lambda n, r=r: store.put_json(n, {"name": r["n_name"], "key": r["n_nationkey"]}))):
            one, two = put("one"), put("two")
            rows.append((kind, store.read_bytes(one).decode(), one.digest, one.path == two.path))
    return spark.createDataFrame(rows, "kind string, content string, digest string, written_once boolean")


@query("SELECT sha256(n_name) AS sha256 FROM nation")
def file_digest(spark, sf):
    """Files, a nation each, hashed where they are read."""
    folder = files.shared_folder(spark, "file")
    for r in spark.read.parquet(f"{sf}/nation.parquet").collect():  # 25 rows
        files.save(spark, f"{folder}/{r['n_nationkey']}.txt", r["n_name"].encode())
    return digest.digest_files(spark, folder).select("sha256")


@query("""SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS n_values, count(DISTINCT (l_linestatus, l_returnflag)) AS n_digests, count(DISTINCT (l_returnflag, l_linestatus)) AS n_in_any_order, 2 * count(DISTINCT l_quantity) AS n_by_type FROM lineitem""")
def canonical_digests(spark, sf):
    """As many digests as values, whatever the order of keys; numbers and their text have different ones."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    flags = [(r[0], r[1]) for r in line.select("l_returnflag", "l_linestatus").distinct().collect()]  # a few
    sizes = [r[0] for r in line.select("l_quantity").distinct().collect()]  # 50 at most
    one, two = ({digest.digest_obj(dict(order)) for order in pairs} for pairs in ([(("flag", f), ("status", s)) for f, s in flags], [(("status", s), ("flag", f)) for f, s in flags]))
    by_type = {digest.digest_obj(x) for q in sizes for x in (q, str(q))}
    return spark.createDataFrame([(len(flags), len(one), len(one | two), len(by_type))], "n_values long, n_digests long, n_in_any_order long, n_by_type long")


@query("SELECT name, count(o_orderkey) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o.*, name, CASE WHEN (o_orderkey % 2 = 0) = (name = 'even') THEN o_custkey END AS v FROM orders o, (VALUES ('even'), ('odd')) AS n(name)) WHERE v IS NOT NULL GROUP BY name")
def artifact_nulls(spark, sf):
    """Two tables that differ in where NULLs are only: both are kept, and each is read back as it was put."""
    store = ArtifactStore(files.shared_folder(spark, "store"), spark)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = []
    for name, rest in (("even", 0), ("odd", 1)):
        kept = store.put_table("orders", orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == rest, F.col("o_custkey")).alias("v")))
        parts.append(store.read_table(spark, kept).filter("v is not null").agg(F.lit(name).alias("name"), F.count("o_orderkey").alias("n"), F.sum("o_orderkey").alias("total")))
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, true AS same_in_any_order, true AS differs_by_a_row FROM lineitem")
def artifact_table(spark, sf):
    """A table by the digest of its rows, read back."""
    store = ArtifactStore(files.shared_folder(spark, "store"), spark)
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    kept = store.put_table("line", line)
    same = store.put_table("again", line.repartition(3).select("l_quantity", "l_linenumber", "l_orderkey")).path == kept.path
    other = digest.digest_table(line.unionByName(line.limit(1))) != kept.digest
    return store.read_table(spark, kept).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"), F.lit(same).alias("same_in_any_order"), F.lit(other).alias("differs_by_a_row"))


_RERUN = """SELECT run_id, stage, reused, CAST(CASE WHEN stage = 'data_source' THEN CASE WHEN run_id = '5 presences' THEN n1 ELSE n END ELSE CASE WHEN run_id = '5 presences' THEN m1 ELSE m END END AS BIGINT) AS n_records
FROM (SELECT count(*) AS n, sum(label) AS n1 FROM occ), (SELECT count(*) AS m, sum(label) AS m1 FROM clean), (SELECT unnest(['data_source', 'cleaning', 'accessible_area', 'predictors']) AS stage),
LATERAL (VALUES ('1 first', false), ('2 again', true), ('3 other split', true), ('4 record outside', stage <> 'data_source'), ('5 presences', false)) AS r(run_id, reused)"""


@query(_RERUN)
def rewind(spark, sf):
    """Which steps were read back: of a first run; of the same again; of one with another split; of one whose file has a record more, outside of the extent, so that what was read from it is the same; of one whose file holds the presences alone."""
    root = files.shared_folder(spark, "store")
    store, source = ArtifactStore(root, spark), _real(spark, sf)
    grown, ones = (f"{files.shared_folder(spark, name)}/occurrences" for name in ("grown", "ones"))
    world = spark.read.option("header", True).csv(source.occurrences_path)
    world.unionByName(world.limit(1).withColumn("decimalLongitude", F.lit("-40.0"))).write.option("header", True).csv(grown)
    world.filter("occurrenceStatus = 'PRESENT'").write.option("header", True).csv(ones)
    plan = _plan("a", source, "none")
    other = plan.replace(methodology=MethodologySpec(*[getattr(plan.methodology, s) for s in ("cleaning", "accessible_area", "predictors")], MethodSpec("random_kfold", {"n_folds": FOLDS}), MethodSpec("none")))
    for run, p in (("1 first", plan), ("2 again", plan), ("3 other split", other), ("4 record outside", plan.replace(data_source=source.replace(occurrences_path=grown))), ("5 presences", plan.replace(data_source=source.replace(occurrences_path=ones)))):
        executor.execute_run(spark, [p], default_registry(), store, run_id=run, random_seed=SEED, resume=True)
    steps = executor.lineage(spark, store).filter("place < 4")
    counts = spark.read.option("multiLine", True).json(f"{root}/runs/*/candidates/a/steps/*.json").select("metrics.n_records", "stage", F.regexp_extract(F.url_decode("_metadata.file_path"), r"/runs/([^/]+)/", 1).alias("run_id"))
    last = F.coalesce("n_records", F.last("n_records", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("place")))  # a handful of steps
    return steps.join(counts, ["run_id", "stage"]).select("run_id", "stage", "reused", last.cast("long").alias("n_records"))


@query(f"SELECT * FROM ({_EVERY_CELL}) WHERE \"row\" BETWEEN 12 AND 20 AND col BETWEEN 55 AND 59")
def raster_window(spark, sf):
    """A part of a stack: the blocks that it meets are read, and no others."""
    return _stack(rasters.read_predictors(spark, _layers(_fixture(spark, sf), ".tif"), (12, 20, 55, 70)))


@query(_USABLE + " SELECT label, count(*) AS n FROM usable WHERE label = 1 GROUP BY label UNION ALL SELECT 0, count(*) FROM (SELECT * FROM (" + _EVERY_CELL + ") ORDER BY md5('42:background:' || \"row\" || ':' || col), \"row\", col LIMIT 700) WHERE p1 IS NOT NULL AND p2 IS NOT NULL")
def run_presence_only(spark, sf):
    """Presences alone, from file to scored table: records by label, the background among them."""
    folder = _fixture(spark, sf)
    ones = f"{files.shared_folder(spark, 'ones')}/occurrences"
    spark.read.option("header", True).csv(f"{folder}/occurrences").filter("occurrenceStatus = 'PRESENT'").write.option("header", True).csv(ones)
    plan = _plan("p", _real(spark, sf, occurrences_path=ones, occurrence_type="presence_absence"), "logistic")
    plan = plan.replace(data_source=plan.data_source.replace(occurrence_type="presence_only"), methodology=MethodologySpec(*[getattr(plan.methodology, s) for s in ("cleaning", "accessible_area", "predictors", "split", "algorithm")], MethodSpec("random", {"n_background": 700})))
    root = files.shared_folder(spark, "store")
    result = executor.execute_run(spark, [plan], default_registry(), ArtifactStore(root, spark), run_id="only", random_seed=SEED)
    scored = spark.read.parquet(f"{root}/{result.candidates[0].step_records[-1].artifacts[0].path}")
    return scored.filter("cv_prediction between 0 and 1").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT 'no_usable_occurrences' AS code, count(*) AS n_records FROM occ")
def unusable_occurrences(spark, sf):
    """A file none of whose records has coordinates is a gap, not an empty result."""
    bad = f"{files.shared_folder(spark, 'bad')}/occurrences"
    raw = spark.read.option("header", True).csv(f"{_fixture(spark, sf)}/occurrences").withColumn("decimalLongitude", F.lit("n/a"))
    raw.write.option("header", True).csv(bad)
    try:
        loader.load_data_source(spark, _real(spark, sf, occurrences_path=bad), SEED)
        code = "none"
    except UnsupportedDataSource as e:
        code = e.gap.code
    return spark.read.option("header", True).csv(bad).agg(F.lit(code).alias("code"), F.count("*").alias("n_records"))


@query("SELECT spelling, CAST(NOT same AS INT) AS n_said, CASE WHEN same THEN n ELSE 0 END AS n_records FROM (SELECT count(*) AS n FROM occ), (VALUES ('EPSG:4326', true), (' epsg:4326', true), ('EPSG:3857', false)) AS s(spelling, same)")
def crs_spellings(spark, sf):
    """Coordinates are moved where the systems differ, not where their names are spelled differently; degrees taken for metres lie outside."""
    rows = []
    for crs in ("EPSG:4326", " epsg:4326", "EPSG:3857"):
        with scope():
            context, said = loader.load_data_source(spark, _real(spark, sf, crs=crs), SEED)
            rows.append((crs, sum(a.code == "reprojected_occurrences" for a in said), context.occurrences.count()))
    return spark.createDataFrame(rows, "spelling string, n_said int, n_records long")


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    g = queries.grid(spark, sf)
    rows = stages.standardise(queries._clean(spark, sf), g, *stages.layer_stats(g, K)).filter("features is not null")
    return hold(stages.spatial_block_folds(rows, BLOCK, FOLDS, SEED).select("record_id", "label", "features", "fold"))


@query('SELECT "row", col, p1 IS NOT NULL AND p2 IS NOT NULL AS has_value, true AS is_models FROM grid')
def prediction_surface(spark, sf):
    """The run's model over the whole grid, through GeoTIFFs: each cell's value is held against the model's formula over the grid that was given."""
    root, result = _executed(spark, sf)
    store, candidate = ArtifactStore(root, spark), result.candidates[0]
    found = executor.predicted_surface(spark, store, candidate, files.shared_folder(spark, "surface"))
    kept = json.loads(store.read_bytes(candidate.step_records[-1].artifacts[-1]))
    g = queries.grid(spark, sf)
    z = stages.scaled("predictors", *stages.layer_stats(g, K))
    want = 1 / (1 + F.exp(-(F.lit(kept["model"]["intercept"]) + sum(F.lit(c) * F.get(z, F.lit(i)) for i, c in enumerate(kept["model"]["coefficients"])))))
    both = found.join(g.select("row", "col", want.alias("want")), ["row", "col"])
    return both.select("row", "col", F.col("value").isNotNull().alias("has_value"), ((F.abs(F.col("value") - F.col("want")) < 1e-9) | (F.col("value").isNull() & F.col("want").isNull())).alias("is_models"))


_FITS = _USABLE + "SELECT fold, CAST((SELECT sum(n) FROM sides) - n AS BIGINT) AS n, CAST((SELECT sum(p) FROM sides) - p AS BIGINT) AS n_presences, true AS is_optimum FROM sides"


@query(_FITS)
def logistic_optimum(spark, sf):
    """Each fold's coefficients are held against the conditions of the optimum, by an aggregation over the rows that it was fitted to."""
    rows = _folded(spark, sf)
    blocks = learners.packed(rows, [*range(FOLDS), None], rows.count())
    out = []
    for fold, m in enumerate(learners.logistic(blocks, K, FOLDS + 1)[:-1]):
        x = [F.get("features", F.lit(i)) for i in range(K)]
        error = 1 / (1 + F.exp(-(F.lit(m.intercept) + sum(F.lit(c) * v for c, v in zip(m.coefficients, x, strict=True))))) - F.col("label")
        slopes = [F.sum(error), *[F.sum(error * v) + F.lit(c) for c, v in zip(m.coefficients, x, strict=True)]]
        flat = F.greatest(*map(F.abs, slopes)) < 1e-5
        out.append(rows.filter(F.col("fold") != fold).agg(F.lit(fold).alias("fold"), F.count("*").alias("n"), F.sum("label").alias("n_presences"), flat.alias("is_optimum")))
    return reduce(DataFrame.unionByName, out)


@query(_FITS)
def maxent_optimum(spark, sf):
    """Maximum entropy with linear and quadratic features: at each fold's optimum a feature's mean under the model differs from its presences' by its penalty where it is used, by less elsewhere."""
    rows = _folded(spark, sf)
    blocks = learners.packed(rows, [*range(FOLDS), None], rows.count())
    expansion = maxent.from_params(rows, K, {"classes": ("linear", "quadratic")})
    u = [(F.get("features", F.lit(i)) - F.lit(float(expansion.low[i]))) / F.lit(float(expansion.high[i] - expansion.low[i])) for i in range(K)]
    f, out = [*u, *[v * v for v in u]], []
    for fold, m in enumerate(maxent.fit(blocks, expansion, FOLDS + 1)[:-1]):
        e = F.exp(sum(F.lit(float(w)) * v for w, v in zip(m.w, f, strict=True)))
        ok = F.lit(True)
        for w, v in zip(m.w.tolist(), f, strict=True):
            one = F.when(F.col("label") == 1, v)
            penalty = F.greatest(F.stddev_pop(one), F.lit(1e-3)) / F.sqrt(F.sum("label"))
            slope = F.sum(e * v) / F.sum(e) - F.avg(one)
            ok = ok & ((F.abs(slope + penalty * float(np.sign(w))) < 1e-6) if w else (F.abs(slope) <= penalty + 1e-6))
        out.append(rows.filter(F.col("fold") != fold).agg(F.lit(fold).alias("fold"), F.count("*").alias("n"), F.sum("label").alias("n_presences"), ok.alias("is_optimum")))
    return reduce(DataFrame.unionByName, out)


@query(_USABLE + " SELECT fold, label, count(*) AS n FROM ufolded GROUP BY 1, 2")
def stage_chain(spark, sf):
    """Source, cleaning, predictors and split one after the other, through their backends."""
    registry = default_registry()
    context, _ = loader.load_data_source(spark, _real(spark, sf), SEED)
    plan = _plan("chain", _real(spark, sf), "logistic")
    context = context.with_(grid=hold(context.grid), occurrences=hold(context.occurrences))
    for stage, spec in plan.methodology.steps()[:-1]:
        context = registry.resolve(stage, spec).backend.run(spec, context, SEED).context
    return context.occurrences.groupBy("fold", "label").agg(F.count("*").alias("n"))


@query("SELECT candidate_id, stage, true AS named, true AS linked FROM (VALUES " + ", ".join(map(str, _STEPS)) + ") AS s(candidate_id, place, stage, method, backend, n_artifacts, n_gaps)")
def step_cards(spark, sf):
    """A page for each step, put into the store and read back."""
    root, result = _executed(spark, sf)
    store = ArtifactStore(root, spark)
    steps = [r for c in result.candidates for r in c.step_records]
    pages = [store.read_bytes(a).decode() for a in cards.put_cards(store, result)]
    rows = [(r.candidate_id, r.stage, f"<h1>{r.candidate_id}: {r.stage}</h1>" in page, all(a.digest in page for a in r.artifacts)) for r, page in zip(steps, pages, strict=True)]
    return spark.createDataFrame(rows, "candidate_id string, stage string, named boolean, linked boolean")


@query("SELECT * FROM (VALUES ('nowhere.csv', 0, 0), ('p1.tif', 1, 64), ('p2.tif', 1, 64)) AS f(file, n_files, digest_length)")
def run_provenance(spark, sf):
    """Digests of the files that the run read; the folder of occurrences has as many parts as Spark wrote, and is left out."""
    told = cards.provenance(spark, _executed(spark, sf)[1])
    rows = [(p.rsplit("/", 1)[-1], len(x), max(map(len, x), default=0)) for p, x in told["files"].items() if not p.endswith("/occurrences")]
    return spark.createDataFrame(rows, "file string, n_files int, digest_length int")


_EXTENDED = ("gam", "mars", "maxent")


@query(_USABLE + f"SELECT learner, fold, label, count(*) AS n, ok AS scored FROM ufolded JOIN scorable USING (fold), (SELECT unnest([{', '.join(f"'{x}'" for x in _EXTENDED)}]) AS learner) GROUP BY ALL")
def extended_cv(spark, sf):
    """Cross-validation by the learners beyond the default ones: records by fold and label, and whether each has a probability."""
    rows = _folded(spark, sf)
    parts = [algorithms.cross_validate(rows, x, {}, SEED)[0].select(F.lit(x).alias("learner"), "fold", "label", F.coalesce(F.col("cv_prediction").between(0, 1), F.lit(False)).alias("scored")) for x in _EXTENDED]
    return reduce(DataFrame.unionByName, parts).groupBy("learner", "fold", "label", "scored").agg(F.count("*").alias("n"))


@query(_USABLE + "SELECT fold, count(*) AS n, true AS has_weights, ok AS scored FROM ufolded JOIN scorable USING (fold) GROUP BY fold, ok")
def weighted_cv(spark, sf):
    """Logistic regression with the landscape's density ratio as weights, in fits and scores."""
    g = queries.grid(spark, sf)
    placed = stages.gather(queries._clean(spark, sf), g).filter(stages.complete("predictors"))
    weighed = selection.density_ratio(placed, g, K, seed=SEED).select("record_id", (F.col("weight") + 0.01).alias("weight"))
    scored = algorithms.cross_validate(_folded(spark, sf).join(weighed, "record_id"), "logistic", {}, SEED, weight="weight")[0]
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.bool_and(F.col("weight") > 0).alias("has_weights"), F.bool_and(F.col("cv_prediction").between(0, 1)).alias("scored"))
