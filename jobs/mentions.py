"""Occurrences from texts: which names of a group does each new text mention, and which not?

    python -m jobs.mentions --documents IN --output OUT --config jobs/mentions.json

Species data are mined from field notes and literature. A text that mentions any name of the
group is a visit of its site: the names it mentions are present, the others absent, so that
absences share the effort of the presences. The config's expressions give a site's coordinates, and
their system; they are moved to the grid's and placed in its cells as the library's reader places
records, and the rows have the columns that the library's stages take as occurrences (record_id, row, col, label, obs_date).

The job is a file stream: each run takes the files that came since the last one and ends. Which were
taken stands in ``OUT/checkpoint``; rows are appended to ``OUT/occurrences``, a folder a name,
exactly once, through the file sink's log. A run that was stopped is taken up where it was;
one without new files changes nothing. Nothing is shuffled, and no state is kept.

Defined cases: a null or wordless text, or one without any name, is no visit; repeated rows
are visits of their own; names match whole words (runs of letters) in any case; a text of any
length is read whole; null sites and dates stay null, and sites without coordinates have no cell; columns that the config does not name
are ignored.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichesearch.functions import geometry
from nichesearch.sources import occurrences

from .common import log, main

SCHEMA = "record_id long, row int, col int, label int, obs_date date, doc_id long, site string, n_mentions int, n_words int, name string"
WORD_BREAK = r"[^\p{L}]+"


def mined(documents: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """A row for each visit and name; map-only."""
    names = sorted({n.lower() for n in settings["names"]})
    columns = {c: F.expr(settings[c]) for c in ("doc_id", "text", "site", "obs_date")}
    rows = documents.select(*[x.alias(c) for c, x in columns.items()])
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WORD_BREAK), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumns({"n_words": F.size("words"), "hits": F.filter(F.transform("words", F.lower), lambda w: w.isin(names))}).drop("text", "words")
    rows = rows.filter(F.size("hits") > 0).withColumn("name", F.explode(F.array(*map(F.lit, names))))
    n = F.size(F.filter("hits", lambda w: w == F.col("name")))
    record_id = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "name")), 1, 15), 16, 10).cast("long")
    x, y, _ = occurrences.reproject(F.expr(settings["x"]).cast("double"), F.expr(settings["y"]).cast("double"), settings["crs"], settings["grid_crs"])
    row, col = geometry.world_to_cell(tuple(settings["transform"]), x, y)
    rows = rows.withColumns({"n_mentions": n, "label": (n > 0).cast("int"), "record_id": record_id, "row": row, "col": col})
    return rows.select("name", "record_id", "row", "col", "label", F.col("obs_date").cast("date").alias("obs_date"), F.col("doc_id").cast("long").alias("doc_id"), F.col("site").cast("string").alias("site"), "n_mentions", "n_words")


def run(spark: SparkSession, documents: str, output: str, settings: dict[str, Any]) -> dict[str, int]:
    """Take the new files of ``documents`` (Parquet; a folder or a glob, which a single file must be given as); returns rows read and occurrences written by this run."""
    stream = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", settings.get("files_per_batch", 1000)).parquet(documents)
    rows = mined(stream, settings).observe("written", F.count("*").alias("rows"))
    sink = rows.writeStream.format("parquet").partitionBy("name").option("path", f"{output}/occurrences").option("checkpointLocation", f"{output}/checkpoint")
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    batches = query.recentProgress
    told = {"read": sum(p["numInputRows"] for p in batches), "written": sum(p["observedMetrics"]["written"]["rows"] for p in batches if "written" in p["observedMetrics"])}
    log.info("mentions: %d texts read from %s, %d occurrences written to %s in %d batches", told["read"], documents, told["written"], f"{output}/occurrences", len(batches))
    return told


def read(spark: SparkSession, output: str) -> DataFrame:
    """All occurrences that were written so far."""
    return spark.read.schema(SCHEMA).parquet(f"{output}/occurrences")


if __name__ == "__main__":
    main("mentions", {"documents": "folder or file of the texts' table"}, run)
