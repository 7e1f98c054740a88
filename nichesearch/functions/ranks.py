"""Running sums in the order of a number, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .caching import hold

#: Ranges that all values are dealt to, and those of each group where there are groups; powers of two.
RANGES, EACH = 256, 32


def running(values: DataFrame, by: Sequence[str], key: str, sums: Sequence[str]) -> DataFrame:
    """Adds ``<c>_before`` for each column c of ``sums``: its sum over the rows of the group with a smaller ``key``.

    Rows are distinct in (by, key); NULL keys have none before them. Approximate quantiles cut a group into ranges;
    sums inside a range come from a window over it, those of the ranges before from their
    few totals. Where the quantiles lie changes no result.
    """
    by, values = list(by), hold(values)  # read for edges, for totals and for places
    ranges = EACH if by else RANGES
    places = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = values.groupBy(*by).agg(F.percentile_approx(key, places, F.lit(10_000)).alias("_edges"))
    edges = F.broadcast(edges.withColumnsRenamed({c: f"_by_{c}" for c in by}))  # a row a group
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    rows = values.join(edges, same, "left") if by else values.crossJoin(edges)
    rows = rows.drop(*[f"_by_{c}" for c in by]).withColumn("_range", F.lit(0))
    step = ranges // 2
    while step:  # binary search, a column a step
        rows = rows.withColumn("_range", F.when(F.get("_edges", F.col("_range") + (step - 1)) <= F.col(key), F.col("_range") + step).otherwise(F.col("_range")))
        step //= 2
    rows = rows.drop("_edges")
    total = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    rows = rows.join(F.broadcast(base), [*same, F.col("_range") == F.col("_at")])  # a row a range

    def before(c: str) -> Column:
        return F.col(f"_b_{c}") + F.col(f"_i_{c}")

    rows = rows.withColumns({f"{c}_before": before(c) for c in sums})
    return rows.drop("_range", "_at", *[f"_by_{c}" for c in by], *[f"_{k}_{c}" for c in sums for k in "bi"])
