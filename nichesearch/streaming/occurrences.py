"""Occurrence files as they arrive: the batch reader's projection over a stream, with running accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import occurrences
from ..sources.rasters import Grid


def read_stream(spark: SparkSession, folder: str, header: list[str], grid: Grid, crs: str, date_field: str | None = None) -> DataFrame:
    """Parsed records of CSV files that are put into a folder; see ``occurrences.parse`` for the columns."""
    raw = spark.readStream.option("header", True).schema(", ".join(f"`{c}` string" for c in header)).csv(folder)
    columns = occurrences.find_columns(header, grid.is_georeferenced, date_field)
    return occurrences.parse(raw, columns, grid, crs)[0]


def running_losses(parsed: DataFrame) -> DataFrame:
    """The account of losses over all records so far (complete mode)."""
    return occurrences.losses(parsed)


def monthly(parsed: DataFrame, lateness: str = "31 days") -> DataFrame:
    """Records by 30-day window of their date, closed once later dates pass the watermark (append mode)."""
    dated = parsed.filter("inside and obs_date is not null").withColumn("at", F.col("obs_date").cast("timestamp"))
    return dated.withWatermark("at", lateness).groupBy(F.window("at", "30 days"), "label").agg(F.count("*").alias("n"))
