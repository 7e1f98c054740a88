"""Profile measures: volume, spacing, autocorrelation, coverage, shift, collinearity, time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.caching import hold

#: Work bounds of the profile: cells and pairs of the variogram, cells of the landscape sample.
VARIOGRAM_CELLS, VARIOGRAM_PAIRS, LANDSCAPE_CELLS = 3000, 20_000, 5000
BINS = 25


def valid_cells(grid: DataFrame) -> DataFrame:
    """Cells with every predictor."""
    return grid.filter(F.forall("predictors", lambda x: x.isNotNull()))


def sample_cells(valid: DataFrame, n: int, seed: int, purpose: str) -> DataFrame:
    """n cells in hash order, or all."""
    return valid.orderBy(draws.order_key(seed, purpose, F.col("row"), F.col("col")), "row", "col").limit(n)


def volume(occ: DataFrame, presence_absence: bool = True) -> DataFrame:
    n, unique = F.count("*"), F.count_distinct("row", "col")
    ones, zeros = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    prevalence = F.try_divide(ones.cast("double"), n.cast("double")) if presence_absence else F.lit(None).cast("double")
    return occ.agg(
        n.alias("n_records"),
        unique.alias("n_unique_cells"),
        ones.alias("n_presences"),
        zeros.alias("n_absences"),
        prevalence.alias("prevalence"),
        F.coalesce(1 - F.try_divide(unique.cast("double"), n.cast("double")), F.lit(0.0)).alias("duplicate_fraction"),
    )


def nearest_distances(cells: DataFrame, extent: int) -> DataFrame:
    """(row, col, distance) to the nearest other cell of ``cells`` (row, col distinct).

    Cells are dealt to square tiles and joined with the nine tiles around: a distance of at
    most a tile's side is final. Cells without one are tried again with tiles four times as
    wide, until a tile covers the extent. Tiles start at about the expected spacing, so a
    tile holds few cells at any size of the input.
    """
    n = cells.count()
    if n < 2:
        return cells.select("row", "col", F.lit(None).cast("double").alias("distance"))
    side = max(1, math.ceil(math.sqrt(extent / n)))
    bounds = cells.agg(F.max("row") - F.min("row"), F.max("col") - F.min("col")).first()
    widest = max(bounds[0], bounds[1]) + 1
    left, done = cells.select("row", "col"), None
    while True:
        tile = lambda c, s=side: F.floor(F.col(c) / s)
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        probe = left.withColumn("o", around).select("row", "col", (tile("row") + F.col("o.i")).alias("tr"), (tile("col") + F.col("o.j")).alias("tc"))
        there = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), tile("row").alias("tr"), tile("col").alias("tc"))
        squared = (F.col("row") - F.col("r2")).cast("double") * (F.col("row") - F.col("r2")) + (F.col("col") - F.col("c2")).cast("double") * (F.col("col") - F.col("c2"))
        pairs = probe.join(there, ["tr", "tc"]).filter((F.col("row") != F.col("r2")) | (F.col("col") != F.col("c2")))
        found = pairs.groupBy("row", "col").agg(F.sqrt(F.min(squared)).alias("distance"))
        if side >= widest:
            return found if done is None else done.unionByName(found)
        found = found.filter(F.col("distance") <= side)
        done = found if done is None else done.unionByName(found)
        left = hold(left.join(found.select("row", "col"), ["row", "col"], "left_anti"))  # else each round repeats those before
        if left.isEmpty():
            return done
        side *= 4


def spacing(cells: DataFrame, extent: int) -> DataFrame:
    """(mean_nearest_neighbour_cells, nearest_neighbour_index): Clark-Evans against random spacing."""
    expected = 0.5 * F.sqrt(F.lit(float(extent)) / F.col("n"))
    rows = nearest_distances(cells, extent).agg(F.avg("distance").alias("mean"), F.count("*").alias("n"))
    mean = F.coalesce("mean", F.lit(0.0))
    return rows.select(mean.alias("mean_nearest_neighbour_cells"), F.when(F.col("n") < 2, F.lit(1.0)).when(expected > 0, mean / expected).otherwise(1.0).alias("nearest_neighbour_index"))


def variogram(grid: DataFrame, k: int, seed: int, cells: int = VARIOGRAM_CELLS, pairs: int = VARIOGRAM_PAIRS) -> DataFrame:
    """(bin, n_pairs, semivariance, max_distance) of hash-drawn pairs of sampled cells."""
    spark = grid.sparkSession
    sample = sample_cells(valid_cells(grid), cells, seed, "variogram").select("row", "col", "predictors")
    place = F.row_number().over(Window.orderBy(draws.order_key(seed, "variogram", F.col("row"), F.col("col")), "row", "col")) - 1
    sample = sample.withColumn("place", place)  # at most ``cells`` rows
    sd = [F.stddev_pop(F.get("predictors", F.lit(i))).over(Window.partitionBy()) for i in range(k)]
    sample = sample.select("row", "col", "place", F.count("*").over(Window.partitionBy()).alias("n"), F.array(*[F.get("predictors", F.lit(i)) / F.when(s == 0, 1.0).otherwise(s) for i, s in enumerate(sd)]).alias("z"))
    size = sample.agg(F.max("n").alias("n"))
    draw = lambda side: F.floor(draws.uniform(seed, f"variogram-{side}", F.col("id")) * F.col("n"))
    drawn = spark.range(pairs).join(F.broadcast(size)).filter("n is not null").select(draw("left").alias("a"), draw("right").alias("b")).filter("a <> b")
    one = F.broadcast(sample.select(F.col("place").alias("a"), F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("z").alias("z1")))
    two = F.broadcast(sample.select(F.col("place").alias("b"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("z").alias("z2")))
    both = drawn.join(one, "a").join(two, "b")
    d = F.sqrt(F.pow((F.col("r1") - F.col("r2")).cast("double"), F.lit(2.0)) + F.pow((F.col("c1") - F.col("c2")).cast("double"), F.lit(2.0)))
    squares = sum([F.pow(F.get("z1", F.lit(i)) - F.get("z2", F.lit(i)), F.lit(2.0)) for i in range(k)], F.lit(0.0)) / k
    both = both.select(d.alias("d"), squares.alias("g"))
    both = both.withColumn("top", F.max("d").over(Window.partitionBy()))  # at most ``pairs`` rows
    binned = both.filter("top > 0").withColumn("bin", F.least(F.floor(F.col("d") / (F.col("top") / BINS)), F.lit(BINS - 1)).cast("int"))
    return binned.groupBy("bin").agg(F.count("*").alias("n_pairs"), (F.avg("g") / 2).alias("semivariance"), F.max("top").alias("max_distance"))


def variogram_range(bins: list, sample_size: int) -> tuple[float, bool]:
    """Centre of the first bin at 0.95 of the sill, and whether it lies before the last five bins."""
    if sample_size < 20 or len(bins) < 3:
        return 1.0, False
    bins = sorted(bins, key=lambda b: b["bin"])
    sill = sum(b["semivariance"] for b in bins[-5:]) / len(bins[-5:])
    if sill <= 0:
        return 1.0, False
    for b in bins:
        if b["semivariance"] >= 0.95 * sill:
            return (b["bin"] + 0.5) * b["max_distance"] / BINS, b["bin"] < BINS - 5
    return bins[0]["max_distance"], False


def _layer(i: int) -> Column:
    return F.get("predictors", F.lit(i))


#: Share of a layer's spread within which two values are the same: interpolated quantiles are good to that.
SAME = 1e-9


def _below(edges: Column, value: Column, tolerance: Column) -> Column:
    """How many edges are at most the value."""
    return F.size(F.filter(edges, lambda e: e <= value + tolerance))


def _quantiles(value: Column, at: Column) -> Column:
    """Quantiles in order, those that are the same once."""
    every = F.percentile(value, at)
    spread = F.element_at(every, -1) - F.get(every, F.lit(0))
    return F.filter(every, lambda e, i: (i == 0) | (e - F.get(every, i - 1) > SAME * spread))


def coverage(sampled: DataFrame, landscape: DataFrame, k: int, n_bins: int = 10) -> DataFrame:
    """(environmental_coverage): the share of the landscape's quantile bins that the sample touches, averaged over predictors."""
    at = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    edges = landscape.agg(*[_quantiles(_layer(i), at).alias(f"e{i}") for i in range(k)])
    rows = sampled.join(F.broadcast(edges))  # one row
    shares = []
    for i in range(k):
        inner = F.slice(f"e{i}", 2, F.greatest(F.lit(0), F.size(f"e{i}") - 2))
        tolerance = SAME * (F.element_at(f"e{i}", -1) - F.get(f"e{i}", F.lit(0)))
        rows = rows.withColumn(f"b{i}", F.when((F.size(f"e{i}") >= 3) & _layer(i).isNotNull(), _below(inner, _layer(i), tolerance)))
    counts = rows.agg(*[F.count_distinct(f"b{i}").alias(f"n{i}") for i in range(k)])
    both = edges.join(F.broadcast(counts))
    for i in range(k):
        shares.append(F.when(F.size(f"e{i}") >= 3, F.col(f"n{i}") / (F.size(f"e{i}") - 1)))
    known = F.array_compact(F.array(*shares))
    return both.select(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0).alias("environmental_coverage"))


def shift(sampled: DataFrame, landscape: DataFrame, k: int) -> DataFrame:
    """(covariate_shift, max_univariate_shift) from two one-row aggregations."""
    a = sampled.agg(*[F.avg(_layer(i)).alias(f"a{i}") for i in range(k)])
    b = landscape.agg(*[F.avg(_layer(i)).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(_layer(i)).alias(f"s{i}") for i in range(k)])
    each = [F.abs(F.col(f"a{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")) for i in range(k)]
    return a.join(F.broadcast(b)).select((sum(each, F.lit(0.0)) / k).alias("covariate_shift"), (F.greatest(*each) if k > 1 else each[0]).alias("max_univariate_shift"))


def niche_breadth(sampled: DataFrame, landscape: DataFrame, k: int) -> DataFrame:
    """(niche_breadth): NULL unless two presences have predictors."""
    ones = sampled.filter("label = 1").agg(F.count("*").alias("n"), *[F.stddev_pop(_layer(i)).alias(f"p{i}") for i in range(k)])
    land = landscape.agg(*[F.stddev_pop(_layer(i)).alias(f"s{i}") for i in range(k)])
    mean = sum([F.col(f"p{i}") / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")) for i in range(k)], F.lit(0.0)) / k
    return ones.join(F.broadcast(land)).select(F.when(F.col("n") >= 2, mean).alias("niche_breadth"))


def correlation(landscape: DataFrame, k: int) -> DataFrame:
    """(i, j, r) of all pairs of layers, 0 where a layer is constant; k * k rows."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    safe = [F.coalesce(F.try_divide(F.covar_pop(_layer(i), _layer(j)), F.stddev_pop(_layer(i)) * F.stddev_pop(_layer(j))), F.lit(0.0)) for i, j in pairs]
    row = landscape.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r")) for (i, j), r in zip(pairs, safe, strict=True)]).alias("m"))
    half = row.select(F.explode("m").alias("c")).select("c.*")
    return half.unionByName(half.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))


def collinearity(matrix: np.ndarray) -> tuple[float, float, float]:
    """(max |r|, max VIF, effective dimensionality) of a correlation matrix; the last needs no eigenvalues."""
    k = len(matrix)
    if k < 2:
        return 0.0, 1.0, 1.0
    try:
        vif = float(np.abs(np.diag(np.linalg.inv(matrix))).max())
    except np.linalg.LinAlgError:
        vif = float("inf")
    squares = float((matrix**2).sum())
    return float(np.abs(matrix[~np.eye(k, dtype=bool)]).max()), vif, float(np.trace(matrix) ** 2 / squares) if squares else 1.0


def temporal(occ: DataFrame) -> DataFrame:
    """(n_dated_records, span_days, first_date, last_date, median_records_per_year); one row."""
    span = F.datediff(F.max("obs_date"), F.min("obs_date"))
    n = F.count("obs_date")
    return occ.agg(
        n.alias("n_dated_records"),
        span.alias("span_days"),
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
        F.when(span > 0, n / (span / F.lit(365.25))).otherwise(n.cast("double")).alias("median_records_per_year"),
    )
