"""Training data for the niche models of many species at once, from a table of records.

    python -m jobs.training_table --tables IN --output OUT --config jobs/training_table.json

Records are placed on the grid by the config's expressions; the grid's layers are aggregates of a table. Each cell
with records of a species is a presence of it, with its predictors standardised over the
grid and the fold of its spatial block. One background is drawn for all species, cells weighed by all
records in them (a target group), so that it shares their bias: it is written once, under the species
``background``, and serves each species without the cells of its own presences.

``OUT/training`` has a folder a fold and in it one a kind of row; ``OUT/species`` has a row a species: records,
cells, those lost for missing predictors, folds with presences, and how far its
presences lie from the background. Both are overwritten as a whole: a rerun over equal
tables gives equal rows, as all draws are orders of hashes.

Defined cases: records without a place or species are left out and counted in the log; species with fewer
presence cells than ``min_presences`` have a row in the report and none in the training data; a
species named ``background`` is refused; ties of a draw go by row and column; empty tables make
empty folders with the right columns.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichesearch.functions.caching import hold, scope
from nichesearch.operators import stages

from .common import log, main

BACKGROUND = "background"


def _cells(df: DataFrame, places: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.expr(places[c]).cast("int") for c in ("row", "col")})


def grid(spark: SparkSession, tables: str, settings: dict[str, Any]) -> DataFrame:
    """(row, col, predictors): one aggregation of the layers' table."""
    layers = settings["layers"]
    rows = _cells(spark.read.parquet(f"{tables}/{layers['table']}.parquet"), layers).filter("row is not null and col is not null")
    named = [F.expr(x).cast("double").alias(n) for n, x in layers["predictors"].items()]
    return rows.groupBy("row", "col").agg(*named).select("row", "col", F.array(*layers["predictors"]).alias("predictors"))


def records(spark: SparkSession, tables: str, settings: dict[str, Any]) -> DataFrame:
    """(species, row, col, obs_date) of every record, placed or not."""
    own = settings["records"]
    rows = spark.read.parquet(f"{tables}/{own['table']}.parquet")
    rows = rows.select(F.expr(own["species"]).cast("string").alias("species"), *[F.expr(own[c]).cast("int").alias(c) for c in ("row", "col")], F.expr(own["date"]).cast("date").alias("obs_date"))
    return rows.withColumn("species", F.when(F.col("species") == BACKGROUND, F.raise_error(F.lit(f"a species is named {BACKGROUND}"))).otherwise(F.col("species")))


def tables_of(spark: SparkSession, tables: str, settings: dict[str, Any]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The training rows, the report, and what was read."""
    k, names = len(settings["layers"]["predictors"]), list(settings["layers"]["predictors"])
    land, every = hold(grid(spark, tables, settings)), records(spark, tables, settings)
    placed = F.col("species").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    counts = every.agg(F.count("*").alias("n"), F.count_if(placed).alias("placed")).first()
    found = hold(every.filter(placed).groupBy("species", "row", "col").agg(F.count("*").alias("n_records"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date")))
    mean, sd = stages.layer_stats(land, k)
    z = land.withColumn("z", stages.scaled("predictors", mean, sd)).filter(stages.complete("z"))
    effort = found.groupBy("row", "col").agg(F.sum("n_records").alias("effort"))
    size, n_folds, seed = settings["block_size"], settings["n_folds"], settings["seed"]
    sites = stages.spatial_block_folds(effort.join(z, ["row", "col"]), size, n_folds, seed).select("row", "col", "effort", "fold", *[F.get("z", F.lit(i)).alias(n) for i, n in enumerate(names)])

    there = found.join(sites, ["row", "col"], "left")
    enough = there.groupBy("species").agg(F.sum("n_records").alias("n_records"), F.count("*").alias("n_cells"), F.count_if(F.col("fold").isNull()).alias("n_lost"), F.count_distinct("fold").alias("n_folds"), *[F.avg(n).alias(n) for n in names])
    enough = enough.withColumn("used", F.col("n_cells") - F.col("n_lost") >= settings["min_presences"])
    presences = there.filter("fold is not null").join(enough.filter("used").select("species"), "species").select("species", F.lit(1).alias("label"), "row", "col", "fold", "n_records", "first_date", "last_date", *names)
    drawn = stages.target_group_background(sites.withColumn("accessible", F.lit(True)), sites, settings["n_background"], seed, weight="effort")
    drawn = drawn.select(F.lit(BACKGROUND).alias("species"), F.lit(0).alias("label"), "row", "col", "fold", F.col("effort").alias("n_records"), F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"), *names)
    level = drawn.agg(*[F.avg(n).alias(f"_{n}") for n in names])  # one row
    moved = sum((F.abs(F.col(n) - F.col(f"_{n}")) for n in names), F.lit(0.0)) / k
    report = enough.join(F.broadcast(level)).select("species", "n_records", "n_cells", "n_lost", "n_folds", "used", moved.alias("shift"))
    return presences.unionByName(drawn), report, {"records": counts["n"], "placed": counts["placed"]}


def run(spark: SparkSession, tables: str, output: str, settings: dict[str, Any]) -> dict[str, int]:
    """Write the training data and the report of all species; returns rows read and written."""
    if settings["n_folds"] < 1 or settings["block_size"] < 1 or not math.isfinite(settings["n_background"]):
        raise ValueError("n_folds, block_size and n_background are counts")
    with scope():
        training, report, told = tables_of(spark, tables, settings)
        kind = F.when(F.col("label") == 1, "presence").otherwise(BACKGROUND)
        training.withColumn("kind", kind).hint("rebalance", "fold", "kind").write.mode("overwrite").partitionBy("fold", "kind").parquet(f"{output}/training")
        report.write.mode("overwrite").parquet(f"{output}/species")
    told |= {"training": read(spark, output, settings).count(), "species": spark.read.parquet(f"{output}/species").count()}
    log.info("training_table: %d records read from %s, %d of them placed; %d rows written to %s, %d species reported", told["records"], tables, told["placed"], told["training"], f"{output}/training", told["species"])
    return told


def read(spark: SparkSession, output: str, settings: dict[str, Any]) -> DataFrame:
    layers = "".join(f", `{n}` double" for n in settings["layers"]["predictors"])
    schema = f"species string, label int, row int, col int, n_records long, first_date date, last_date date{layers}, fold int, kind string"
    return spark.read.schema(schema).parquet(f"{output}/training")


if __name__ == "__main__":
    main("training_table", {"tables": "folder of the tables"}, run)
