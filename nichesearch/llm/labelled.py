"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(*keys: str) -> Column:
    """In [0, 1), by hash."""
    return F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) / float(1 << 30)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label, text) of about ``per_class`` labelled documents of each class 0 and 1, or of all; one row an id.

    Those whose hashed ids fall below a rate of the class are taken, so that no class is
    gathered or sorted. The choice is made from ids and labels alone and is small enough to
    be broadcast: the number taken exceeds ``per_class`` by a few of its square roots at
    most, however often an id is repeated. A document with several labels counts by its
    highest; of an id with several texts that with the least hash is taken. Null ids and
    labels are left out; an empty table on either side gives none.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, min(1.0, per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_class / max(1, sizes.get(0, 0))))
    chosen = known.filter(place("doc_id") < rate).select("doc_id", "label").collect()
    bounded = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in chosen], "doc_id long, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "label", "text")
