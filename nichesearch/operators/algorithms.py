"""Learners under cross-validation: all folds, and the model of all rows, in the same passes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.caching import hold
from ..schema import Assumption
from . import gam, learners, mars, maxent, stages

Model = Callable[[np.ndarray], np.ndarray]


def _logistic(rows: DataFrame, blocks: RDD, k: int, models: int, params: dict[str, Any]) -> list[Model]:
    return learners.logistic(blocks, k, models, float(params.get("C", 1.0)), int(params.get("max_iter", 1000)))


def _boosted(rows: DataFrame, blocks: RDD, k: int, models: int, params: dict[str, Any]) -> list[Model]:
    edges = learners.quantile_edges(rows, k)
    return learners.boosted(blocks, edges, models, int(params.get("n_estimators", 100)), float(params.get("learning_rate", 0.1)), int(params.get("max_depth", 3)))


def _maxent(rows: DataFrame, blocks: RDD, k: int, models: int, params: dict[str, Any]) -> list[Model]:
    return maxent.fit(blocks, maxent.from_params(rows, k, params), models, float(params.get("regularisation", 1.0)))


def _additive(rows: DataFrame, blocks: RDD, k: int, models: int, params: dict[str, Any]) -> list[Model]:
    return gam.fit(blocks, gam.splines(rows, k, int(params.get("basis", gam.BASIS))), models, params.get("smoothing"))


def _splines(rows: DataFrame, blocks: RDD, k: int, models: int, params: dict[str, Any]) -> list[Model]:
    at = mars.knots(learners.quantile_edges(rows, k), int(params.get("knots", mars.KNOTS)))
    return mars.fit(blocks, at, models, int(params.get("pairs", mars.PAIRS)), int(params.get("degree", 1)))


LEARNERS = {"logistic": _logistic, "gbm": _boosted, "maxent": _maxent, "gam": _additive, "mars": _splines}


def cross_validate(rows: DataFrame, learner: str, params: dict[str, Any], seed: int, weight: str | None = None) -> tuple[DataFrame, dict[str, float], Any, list[Assumption]]:
    """Rows (record_id, label, features, fold) with cv_prediction; auc metrics; the final model.

    Folds with one class on either side are skipped and counted; their predictions are NULL. A
    ``weight`` column enters the fits and the AUCs of the folds. The learners draw nothing: the seed changes no result.
    """
    from . import selection

    data = hold(rows)
    counts = {r["fold"]: (r["n"], r["p"]) for r in data.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    n, p = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    both = lambda n, p: 0 < p < n
    skipped = [f for f, (own, ones) in sorted(counts.items()) if not (both(own, ones) and both(n - own, p - ones))]
    scorable = [f for f in sorted(counts) if f not in skipped]
    if not scorable:
        raise ValueError("no fold has both classes in and out; nothing can be scored")
    blocks = learners.packed(data, [*scorable, None], n, weight)
    try:
        *models, final = LEARNERS[learner](data, blocks, len(data.first()["features"]), len(scorable) + 1, params)
    finally:
        blocks.unpersist()
    scored = hold(learners.predicted(data, dict(zip(scorable, models, strict=True))))
    used = scored.filter(F.col("fold").isin(scorable)).select("fold", "label", F.col("cv_prediction").alias("score"), *([F.col(weight).alias("weight")] if weight else []))
    aucs = selection.weighted_auc(used, ["fold"]).withColumnRenamed("weighted_auc", "auc") if weight else stages.auc(used, ["fold"])
    m = aucs.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"), F.count("auc").alias("n")).first()
    said = [Assumption("folds_skipped_single_class", f"{len(skipped)} of {len(counts)} folds have one class only", "split")] if skipped else []
    return scored, {"auc_mean": m["mean"], "auc_sd": m["sd"], "n_scored_folds": float(m["n"])}, final, said
