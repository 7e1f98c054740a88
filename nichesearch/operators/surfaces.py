"""Fitted models as plain values, and their predictions over a grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages
from .gam import Additive, Splines
from .learners import Linear, Trees
from .mars import Mars
from .maxent import Expansion, Maxent


def plain(model: Any) -> dict[str, Any]:
    """A model as JSON values, exact and the same whenever it is fitted to the same."""
    match model:
        case Linear():
            return {"kind": "linear", "intercept": model.intercept, "coefficients": list(model.coefficients)}
        case Trees():
            arrays = {n: getattr(model, n).tolist() for n in ("feature", "split", "missing_left", "leaf")}
            return {"kind": "trees", "base": model.base, "edges": [e.tolist() for e in model.edges], **arrays}
        case Maxent(expansion=e):
            return {"kind": "maxent", "w": model.w.tolist(), "log_sum": model.log_sum, "entropy": model.entropy, "low": e.low.tolist(), "high": e.high.tolist(), "classes": list(e.classes), "knots": e.knots}
        case Mars():
            return {"kind": "mars", "terms": [[list(h) for h in t] for t in model.terms], "coefficients": model.coefficients.tolist()}
        case Additive(splines=b):
            return {"kind": "additive", "coefficients": model.coefficients.tolist(), "smoothing": model.smoothing.tolist(), "low": b.low.tolist(), "high": b.high.tolist(), "basis": b.basis, "mean": b.mean.tolist()}
    raise TypeError(f"a {type(model).__name__} has no plain form")


def from_plain(x: dict[str, Any]) -> Callable[[np.ndarray], np.ndarray]:
    """The model of a plain form: probabilities of rows of standardised predictors."""
    match x["kind"]:
        case "linear":
            return Linear(x["intercept"], x["coefficients"])
        case "trees":
            kinds = {"feature": np.int32, "split": np.int32, "missing_left": bool, "leaf": float}
            return Trees(x["base"], [np.array(e, float) for e in x["edges"]], **{n: np.array(x[n], t) for n, t in kinds.items()})
        case "maxent":
            return Maxent(Expansion(np.array(x["low"], float), np.array(x["high"], float), tuple(x["classes"]), x["knots"]), np.array(x["w"], float), x["log_sum"], x["entropy"])
        case "mars":
            return Mars([tuple((int(j), float(c), int(side)) for j, c, side in t) for t in x["terms"]], np.array(x["coefficients"], float))
        case "additive":
            b = Splines(np.array(x["low"], float), np.array(x["high"], float), x["basis"], np.array(x["mean"], float))
            return Additive(b, np.array(x["coefficients"], float), np.array(x["smoothing"], float))
    raise ValueError(f"no model of kind {x['kind']!r}")


def surface(grid: DataFrame, model: dict[str, Any], mean: Sequence[float | None], sd: Sequence[float | None]) -> DataFrame:
    """(row, col, value) of every cell of ``grid`` (row, col, predictors): NULL where a predictor is missing. Map-only; the plain model goes with the tasks."""
    z = stages.scaled("predictors", mean, sd)
    rows = grid.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.when(stages.complete(z), z).alias("z"))
    k = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = from_plain(model)
        for batch in batches:
            z = batch.column("z")
            value = np.full(batch.num_rows, np.nan)
            there = np.asarray(z.is_valid())
            if there.any():
                value[there] = predict(z.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("col"), pa.array(value, from_pandas=True)], names=["row", "col", "value"])

    return rows.mapInArrow(run, "row int, col int, value double")
