"""Seeded draws by hash order: repeatable at any parallelism, and the same in any SQL engine.

A draw's order is ``md5(seed:purpose:key)``; its uniform number is the digest's first 52 bits.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, purpose: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys]))


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """In (0, 1)."""
    digits = F.conv(F.substring(order_key(seed, purpose, *keys), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def above(key: Column, p: float) -> Column:
    """Whether the uniform number of an order key is above p in (0, 1); digits are compared as text."""
    least = int(Fraction(p) * (1 << 52) + Fraction(1, 2))  # of whole numbers d, the first with d + 0.5 > p * 2 ** 52
    return key >= f"{least:013x}" if least < 1 << 52 else F.lit(False)


def ranked(df: DataFrame, key: Column, ties: list[str], name: str) -> DataFrame:
    """Adds the 0-based place of each row in the order of ``key`` (hex digits), then ``ties``.

    Rows are dealt by the key's first three digits: places inside a bucket come from a
    window over it, those of the buckets before from their 4,096 counts at most. No task
    sees all rows. A key travels as its bytes, which sort as its digits do.
    """
    rows = df.withColumns({"_key": F.unhex(key), "_bucket": F.substring(key, 1, 3)})
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", *ties)) - 1
    rows = rows.withColumn("_inside", inside).join(F.broadcast(base), "_bucket")
    return rows.withColumn(name, F.col("_base") + F.col("_inside")).drop("_key", "_bucket", "_inside", "_base")
