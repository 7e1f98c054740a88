"""Rules that weigh methods by facts about the data; a rule never excludes a method."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Record

OPS = ("<", "<=", ">", ">=", "==", "!=", "is_null", "not_null")


@dataclass(frozen=True)
class Condition(Record):
    path: str
    op: str
    value: float | int | str | bool | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class Prior(Record):
    prior_id: str
    stage: str
    method: str
    log_weight: float
    rationale: str
    conditions: tuple[Condition, ...] = ()
    source: str | None = None


_CELLS, _VIF = "profile.volume.n_unique_cells", "profile.environmental.max_vif"
# The rules (id, stage, method, log weight, path, operator, value) and why.
_RULES = [
    ("small_sample_favours_simple_models", "algorithm", "logistic", 1.0, _CELLS, "<", 50, "few cells can't carry a flexible response"),
    ("small_sample_penalises_boosting", "algorithm", "gbm", -1.0, _CELLS, "<", 50, "trees memorise few cells"),
    ("ample_data_favours_flexible_models", "algorithm", "gbm", 0.7, _CELLS, ">=", 300, "many cells show responses that aren't linear"),
    ("collinear_predictors_favour_trees", "algorithm", "gbm", 0.5, _VIF, ">", 10, "trees bear collinear predictors better than coefficients do"),
    ("clustered_sampling_requires_spatial_blocks", "split", "spatial_block", 1.5, "profile.spatial.nearest_neighbour_index", "<", 0.8, "clustered records leak between random folds"),
    ("covariate_shift_requires_spatial_blocks", "split", "spatial_block", 1.0, "profile.sampling.covariate_shift", ">", 0.5, "a sample unlike the landscape must extrapolate"),
    ("spatial_transfer_requires_spatial_blocks", "split", "spatial_block", 1.5, "objective", "==", "spatial_transfer", "blocks estimate transfer to new places"),
    ("interpolation_tolerates_random_folds", "split", "random_kfold", 0.5, "objective", "==", "interpolation", "random folds estimate what interpolation does"),
]
DEFAULT_PRIORS = tuple(Prior(i, s, m, w, why, (Condition(p, op, v),)) for i, s, m, w, p, op, v, why in _RULES)


def facts_table(spark: SparkSession, facts: dict[str, Any]) -> DataFrame:
    """(path, num, str): every number and string that a dotted path leads to; what is missing has no row."""
    rows: list[tuple[str, float | None, str | None]] = []

    def walk(path: str, x: Any) -> None:
        if dataclasses.is_dataclass(x):
            x = {f.name: getattr(x, f.name) for f in dataclasses.fields(x)}
        if isinstance(x, dict):
            for name, value in x.items():
                walk(f"{path}.{name}" if path else name, value)
        elif isinstance(x, str):
            rows.append((path, None, x))
        elif x is not None:
            rows.append((path, float(x), None))

    walk("", facts)
    return spark.createDataFrame(rows, "path string, num double, str string")


def conditions_table(spark: SparkSession, priors: tuple[Prior, ...]) -> DataFrame:
    """(prior_id, stage, method, log_weight, place, path, op, number, text): a row a condition, one with NULL path where there is none."""
    rows = []
    for p in priors:
        for i, c in enumerate(p.conditions or (None,)):
            number = float(c.value) if c and isinstance(c.value, (int, float)) else None
            rows.append((p.prior_id, p.stage, p.method, float(p.log_weight), i, c.path if c else None, c.op if c else None, number, c.value if c and isinstance(c.value, str) else None))
    return spark.createDataFrame(rows, "prior_id string, stage string, method string, log_weight double, place int, path string, op string, number double, text string")


def applicable(conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """Rules of which every condition holds for facts (path, num, str): SQL's three-valued logic with unknown taken for false, so that a missing fact is only null."""
    both = conditions.join(facts, "path", "left")
    known = F.col("num").isNotNull() | F.col("str").isNotNull()
    equal = F.coalesce(F.col("num") == F.col("number"), F.col("str") == F.col("text"), F.lit(False))
    holds = (
        F.when(F.col("op").isNull(), True)
        .when(F.col("op") == "is_null", ~known)
        .when(F.col("op") == "not_null", known)
        .when(F.col("op") == "==", known & equal)
        .when(F.col("op") == "!=", known & ~equal)
        .when(F.col("op") == "<", F.col("num") < F.col("number"))
        .when(F.col("op") == "<=", F.col("num") <= F.col("number"))
        .when(F.col("op") == ">", F.col("num") > F.col("number"))
        .when(F.col("op") == ">=", F.col("num") >= F.col("number"))
    )
    each = both.withColumn("holds", F.coalesce(holds, F.lit(False)))
    return each.groupBy("prior_id", "stage", "method", "log_weight").agg(F.bool_and("holds").alias("applies"))


def weights(methods: DataFrame, applied: DataFrame) -> DataFrame:
    """(stage, method, weight, prior_ids) of methods (stage, method): summed weights of the rules that apply."""
    rules = applied.filter("applies").select("stage", "method", "prior_id", "log_weight")
    ids = F.array_join(F.sort_array(F.collect_list("prior_id")), ",")
    return methods.join(rules, ["stage", "method"], "left").groupBy("stage", "method").agg(F.coalesce(F.sum("log_weight"), F.lit(0.0)).alias("weight"), ids.alias("prior_ids"))
