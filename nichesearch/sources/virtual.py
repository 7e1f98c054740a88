"""Virtual species: suitability over the grid, and weighted draws of cells from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import stages
from ..schema import CapabilityGap


def suitability(grid: DataFrame, coefficients: Sequence[float], intercept: float) -> DataFrame:
    """Adds suitability, the logistic of a linear niche in z-scored predictors; NULL where one is missing."""
    mean, sd = stages.layer_stats(grid, len(coefficients))
    z = grid.withColumn("_z", stages.scaled("predictors", mean, sd))
    logit = F.lit(float(intercept))
    for i, beta in enumerate(coefficients):
        logit = logit + F.lit(float(beta)) * F.get("_z", F.lit(i))
    return z.withColumn("suitability", 1 / (1 + F.exp(-logit))).drop("_z")


def draw_without(cells: DataFrame, weight: Column, n: int, seed: int, purpose: str) -> DataFrame:
    """n cells with chances by weight, without replacement: the least of -ln(u) / weight; at most n rows come together."""
    rows = cells.withColumn("_w", weight).filter("_w > 0")
    race = -F.ln(draws.uniform(seed, purpose, F.col("row"), F.col("col"))) / F.col("_w")
    return rows.orderBy(race, "row", "col").limit(n).drop("_w")


#: Stretches of (0, 1) by which draws and grid rows meet.
STRETCHES = 1024


def draw_with(cells: DataFrame, weight: Column, n: int, seed: int, purpose: str) -> DataFrame:
    """n draws with replacement: uniform numbers looked up in the running sum of the weights.

    Weights are summed by grid row first. A draw meets the grid rows whose share of the sum reaches into its stretch of (0, 1), and
    takes the one that holds it; inside the row, cells and draws are sorted together, and a draw takes the last cell that begins before it.
    """
    rows = cells.withColumn("_w", F.coalesce(weight, F.lit(0.0))).filter("_w > 0").select("row", "col", "_w")
    by_row = rows.groupBy("row").agg(F.sum("_w").alias("_rw"))
    order = Window.orderBy("row")  # a row a row of the grid
    by_row = by_row.withColumns({"_hi": F.sum("_rw").over(order), "_all": F.sum("_rw").over(Window.partitionBy())}).withColumn("_lo", F.col("_hi") - F.col("_rw"))
    stretch = lambda x, slack: F.least(F.lit(STRETCHES - 1), F.greatest(F.lit(0), F.floor(x / F.col("_all") * STRETCHES + slack))).cast("int")
    met = by_row.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_lo"), -1e-6), stretch(F.col("_hi"), 1e-6))))
    drawn = cells.sparkSession.range(n).select("id", draws.uniform(seed, purpose, F.col("id")).alias("u")).withColumn("_stretch", F.floor(F.col("u") * STRETCHES).cast("int"))
    hit = drawn.join(F.broadcast(met), "_stretch").filter((F.col("u") * F.col("_all") >= F.col("_lo")) & (F.col("u") * F.col("_all") < F.col("_hi")))
    hit = hit.select("row", F.lit(None).cast("int").alias("col"), (F.col("u") * F.col("_all") - F.col("_lo")).alias("_at"), "id")
    before = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.select("row", F.col("col").cast("int").alias("col"), F.coalesce(F.sum("_w").over(before), F.lit(0.0)).cast("double").alias("_at"), F.lit(None).cast("long").alias("id"))
    last = F.last("col", ignorenulls=True).over(Window.partitionBy("row").orderBy("_at", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return begins.unionByName(hit).withColumn("_cell", last).filter("id is not null").select("id", "row", F.col("_cell").alias("col"))


def draw(cells: DataFrame, weight: Column, n: int, total_cells: int, seed: int, purpose: str) -> DataFrame:
    """(row, col) of n cells; with replacement only if there are fewer cells than draws."""
    rows = cells.withColumn("_weight", weight)
    known = rows.agg(F.count_if(F.col("_weight") > 0).alias("n")).first()["n"]
    if not known or (n <= total_cells and known < n):
        raise CapabilityGap("degenerate_virtual_species", f"{known} cells have weight for {n} draws", "virtual_species")
    found = draw_with(rows, F.col("_weight"), n, seed, purpose) if n > total_cells else draw_without(rows, F.col("_weight"), n, seed, purpose)
    return found.select("row", "col")
