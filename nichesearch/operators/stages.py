"""Methodology stages as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws, ranks


def drop_duplicate_cells(occ: DataFrame) -> DataFrame:
    """The first record (least record_id) of each cell and label. Where all columns are numbers and dates no record is sorted: what is shuffled is a row a cell, label and task."""
    keys = ("row", "col", "label")
    others = [f for f in occ.schema.fields if f.name not in keys]
    if all(isinstance(f.dataType, (T.NumericType, T.DateType, T.BooleanType)) for f in others):
        return occ.groupBy(*keys).agg(*[F.min_by(f"`{f.name}`", "record_id").alias(f.name) for f in others]).select(*[f"`{c}`" for c in occ.columns])
    first = F.row_number().over(Window.partitionBy("row", "col", "label").orderBy("record_id"))
    return occ.withColumn("_first", first).filter("_first = 1").drop("_first")


def full_extent(grid: DataFrame) -> DataFrame:
    return grid.withColumn("accessible", F.lit(True))


def layer_stats(grid: DataFrame, k: int) -> tuple[list[float | None], list[float | None]]:
    """Mean and population deviation (1 where it is 0) of each layer, missing values left out; one aggregation, one row."""
    aggs = [f(F.get("predictors", F.lit(i))).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(k)]
    r = grid.agg(*aggs).first()
    return [r[f"m{i}"] for i in range(k)], [1.0 if r[f"s{i}"] == 0 else r[f"s{i}"] for i in range(k)]


def scaled(predictors: Column | str, mean: Sequence[float | None], sd: Sequence[float | None]) -> Column:
    """z-scores as an array; NULL where the value or the layer's statistics are."""
    p = F.col(predictors) if isinstance(predictors, str) else predictors
    return F.array(*[(F.get(p, F.lit(i)) - F.lit(m).cast("double")) / F.lit(s).cast("double") for i, (m, s) in enumerate(zip(mean, sd, strict=True))])


def complete(features: Column | str) -> Column:
    return F.forall(features, lambda x: x.isNotNull())


def gather(occ: DataFrame, grid: DataFrame) -> DataFrame:
    """Records with their cell's predictors; NULL off the grid."""
    return occ.join(grid.select("row", "col", "predictors"), ["row", "col"], "left")


def standardise(occ: DataFrame, grid: DataFrame, mean: Sequence, sd: Sequence) -> DataFrame:
    """Adds features to every record; ``features`` is NULL where any predictor is missing."""
    z = gather(occ, grid).withColumn("features", scaled("predictors", mean, sd)).drop("predictors")
    return z.withColumn("features", F.when(complete("features"), F.col("features")))


def random_background(grid: DataFrame, n: int, seed: int) -> DataFrame:
    """n accessible cells in hash order, with their predictors: at most n rows come together."""
    return grid.filter("accessible").orderBy(draws.order_key(seed, "background", F.col("row"), F.col("col")), "row", "col").limit(n)


def target_group_background(grid: DataFrame, effort: DataFrame, n: int, seed: int, weight: str | None = None) -> DataFrame:
    """n accessible cells with chances by their records in ``effort`` (row, col), a target group's: background that shares the sampling bias.

    A row of ``effort`` is a record, or as many as its ``weight`` column says. Without replacement, by the least of -ln(u) / records; cells without any are not drawn.
    """
    counts = effort.groupBy("row", "col").agg((F.sum(weight) if weight else F.count("*")).alias("_records")).filter("_records > 0")
    race = -F.ln(draws.uniform(seed, "target_group", F.col("row"), F.col("col"))) / F.col("_records")
    return grid.filter("accessible").join(counts, ["row", "col"]).orderBy(race, "row", "col").limit(n).drop("_records")


def random_kfold(occ: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """Balanced folds: the place in hash order, modulo the number of folds."""
    rows = draws.ranked(occ, draws.order_key(seed, "kfold", F.col("record_id")), ["record_id"], "_place")
    return rows.withColumn("fold", (F.col("_place") % n_folds).cast("int")).drop("_place")


def spatial_blocks(occ: DataFrame, block_size: int, n_folds: int, seed: int) -> DataFrame:
    """Distinct blocks (block_row, block_col) with their folds, in hash order."""
    blocks = occ.select(F.floor(F.col("row") / block_size).cast("int").alias("block_row"), F.floor(F.col("col") / block_size).cast("int").alias("block_col")).distinct()
    rows = draws.ranked(blocks, draws.order_key(seed, "block", F.col("block_row"), F.col("block_col")), ["block_row", "block_col"], "_place")
    return rows.withColumn("fold", (F.col("_place") % n_folds).cast("int")).drop("_place")


def spatial_block_folds(occ: DataFrame, block_size: int, n_folds: int, seed: int) -> DataFrame:
    """Records with their block's fold."""
    blocks = spatial_blocks(occ, block_size, n_folds, seed)
    rows = occ.withColumns({"block_row": F.floor(F.col("row") / block_size).cast("int"), "block_col": F.floor(F.col("col") / block_size).cast("int")})
    return rows.join(blocks, ["block_row", "block_col"])


def auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, n_positive, auc) from rows (label, score): Mann-Whitney with average ranks.

    Equal scores are grouped first; ranks come from running sums over ranges of the distinct
    scores of a group. NULL where one class is missing.
    """
    by = list(by)
    values = scored.groupBy(*by, (F.col("score") + F.lit(0.0)).alias("score")).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    rows = ranks.running(values, by, "score", ["n"])
    rows = rows.withColumn("rank_sum", F.col("p") * (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)))
    total = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("n_positive"), F.sum("rank_sum").alias("r"))
    p, q = F.col("n_positive").cast("double"), (F.col("n") - F.col("n_positive")).cast("double")
    return total.select(*by, "n", "n_positive", F.try_divide(F.col("r") - p * (p + 1) / 2, p * q).alias("auc"))
