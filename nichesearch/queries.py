"""Registered queries over the driver's tables, and the same in DuckDB's SQL.

Occurrences are lineitem's rows placed on a 60 x 60 grid by part and supplier; the grid's
predictors are a cell's average quantity and discount, missing in every 37th cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import draws, geometry, parsing, projections
from .functions.caching import hold
from .operators import algorithms, profile_stats, selection, stages
from .plans import executor
from .sources import occurrences as occurrence_source
from .sources import virtual
from .sources.rasters import Grid

SIDE, SEED, FOLDS, BLOCK, K = 60, 42, 5, 10, 2
TRANSFORM = (1.0, 0.0, 10.0, 0.0, -1.0, 50.0)
BETA, INTERCEPT = (1.6, -0.9), -0.5
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = VIEWS + sql
        return f

    return add


VIEWS = f"""
WITH occ AS (
  SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount) AS record_id,
         CAST(l_partkey % {SIDE} AS INT) AS "row", CAST(l_suppkey % {SIDE} AS INT) AS col,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CAST(l_shipdate AS DATE) AS obs_date
  FROM lineitem),
cells AS (
  SELECT CAST(l_partkey % {SIDE} AS INT) AS "row", CAST(l_suppkey % {SIDE} AS INT) AS col, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d
  FROM lineitem GROUP BY 1, 2),
grid AS (
  SELECT "row", col, CASE WHEN ("row" * {SIDE} + col) % 37 <> 0 THEN q END AS p1, CASE WHEN ("row" * {SIDE} + col) % 37 <> 0 THEN d END AS p2 FROM cells),
stat AS (SELECT avg(p1) AS m1, avg(p2) AS m2, CASE WHEN stddev_pop(p1) = 0 THEN 1 ELSE stddev_pop(p1) END AS s1, CASE WHEN stddev_pop(p2) = 0 THEN 1 ELSE stddev_pop(p2) END AS s2 FROM grid),
clean AS (SELECT record_id, "row", col, label, obs_date FROM occ QUALIFY row_number() OVER (PARTITION BY "row", col, label ORDER BY record_id) = 1),
valid AS (SELECT * FROM grid WHERE p1 IS NOT NULL AND p2 IS NOT NULL),
land AS (SELECT * FROM valid ORDER BY md5('{SEED}:landscape:' || "row" || ':' || col), "row", col LIMIT {profile_stats.LANDSCAPE_CELLS}),
sampled AS (SELECT occ.*, p1, p2 FROM occ JOIN valid USING ("row", col))
"""


def _u(purpose: str, key: str) -> str:
    return f"((CAST(('0x' || substr(md5('{SEED}:{purpose}:' || {key}), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def six(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).cast("double").alias(name)


def occ(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    return line.select(
        (F.col("l_orderkey") * 1000000 + F.row_number().over(place)).alias("record_id"),
        (F.col("l_partkey") % SIDE).cast("int").alias("row"),
        (F.col("l_suppkey") % SIDE).cast("int").alias("col"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    cells = line.groupBy((F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_suppkey") % SIDE).cast("int").alias("col")).agg(F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"))
    there = (F.col("row") * SIDE + F.col("col")) % 37 != 0
    return cells.select("row", "col", F.array(F.when(there, F.col("q")), F.when(there, F.col("d"))).alias("predictors"))


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return stages.drop_duplicate_cells(occ(spark, sf))


def _landscape(spark: SparkSession, sf: str) -> DataFrame:
    return profile_stats.sample_cells(profile_stats.valid_cells(grid(spark, sf)), profile_stats.LANDSCAPE_CELLS, SEED, "landscape")


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return stages.gather(occ(spark, sf), grid(spark, sf)).filter(stages.complete("predictors"))


# --- stages


@query('SELECT record_id, "row", col, label FROM clean')
def clean_duplicates(spark, sf):
    return _clean(spark, sf).select("record_id", "row", "col", "label")


_BLOCKS = f"""
, blocks AS (SELECT DISTINCT "row" // {BLOCK} AS br, col // {BLOCK} AS bc FROM clean),
folds AS (SELECT br, bc, CAST((row_number() OVER (ORDER BY md5('{SEED}:block:' || br || ':' || bc), br, bc) - 1) % {FOLDS} AS INT) AS fold FROM blocks),
folded AS (SELECT clean.*, fold FROM clean JOIN folds ON br = "row" // {BLOCK} AND bc = col // {BLOCK})
"""


@query(_BLOCKS + "SELECT record_id, fold FROM folded")
def spatial_block_folds(spark, sf):
    return stages.spatial_block_folds(_clean(spark, sf), BLOCK, FOLDS, SEED).select("record_id", "fold")


@query(_BLOCKS + "SELECT fold, count(*) AS n_records, CAST(sum(label) AS BIGINT) AS n_presences FROM folded GROUP BY fold")
def spatial_block_fold_summary(spark, sf):
    rows = stages.spatial_block_folds(_clean(spark, sf), BLOCK, FOLDS, SEED)
    return rows.groupBy("fold").agg(F.count("*").alias("n_records"), F.sum("label").alias("n_presences"))


_KFOLD = f", kf AS (SELECT *, CAST((row_number() OVER (ORDER BY md5('{SEED}:kfold:' || record_id), record_id) - 1) % {FOLDS} AS INT) AS fold FROM occ)"


@query(_KFOLD + "SELECT record_id, fold FROM kf")
def random_kfold(spark, sf):
    return stages.random_kfold(occ(spark, sf), FOLDS, SEED).select("record_id", "fold")


@query('SELECT "row", col, true AS accessible, p1 IS NOT NULL AND p2 IS NOT NULL AS valid FROM grid')
def full_extent_mask(spark, sf):
    return stages.full_extent(grid(spark, sf)).select("row", "col", "accessible", stages.complete("predictors").alias("valid"))


@query('SELECT record_id, round((p1 - m1) / s1, 6) AS z1, round((p2 - m2) / s2, 6) AS z2 FROM occ LEFT JOIN grid USING ("row", col), stat WHERE p1 IS NOT NULL AND p2 IS NOT NULL')
def standardise_predictors(spark, sf):
    g = grid(spark, sf)
    rows = stages.standardise(occ(spark, sf), g, *stages.layer_stats(g, K)).filter("features is not null")
    return rows.select("record_id", six(F.get("features", F.lit(0)), "z1"), six(F.get("features", F.lit(1)), "z2"))


@query('SELECT count(*) FILTER (WHERE p1 IS NULL OR p2 IS NULL) AS n_dropped, count(*) FILTER (WHERE p1 IS NOT NULL AND p2 IS NOT NULL) AS n_kept FROM occ LEFT JOIN grid USING ("row", col)')
def predictors_missing_dropped(spark, sf):
    g = grid(spark, sf)
    rows = stages.standardise(occ(spark, sf), g, *stages.layer_stats(g, K))
    return rows.agg(F.count_if(F.col("features").isNull()).alias("n_dropped"), F.count_if(F.col("features").isNotNull()).alias("n_kept"))


@query(
    f"""SELECT "row", col, 0 AS label, round((p1 - m1) / s1, 6) AS z1, round((p2 - m2) / s2, 6) AS z2 FROM
(SELECT * FROM grid ORDER BY md5('{SEED}:background:' || "row" || ':' || col), "row", col LIMIT 500), stat WHERE p1 IS NOT NULL AND p2 IS NOT NULL"""
)
def random_background(spark, sf):
    g = stages.full_extent(grid(spark, sf))
    z = stages.random_background(g, 500, SEED).withColumn("z", stages.scaled("predictors", *stages.layer_stats(g, K))).filter(stages.complete("z"))
    return z.select("row", "col", F.lit(0).alias("label"), six(F.get("z", F.lit(0)), "z1"), six(F.get("z", F.lit(1)), "z2"))


# --- ingestion


@query('SELECT record_id, CAST(floor(50 - (50 - "row" - 0.5)) AS INT) AS "row", CAST(floor((10 + col + 0.5) - 10) AS INT) AS col FROM occ')
def world_to_cell(spark, sf):
    lon, lat = 10 + F.col("col") + F.lit(0.5), 50 - F.col("row") - F.lit(0.5)
    row, col = geometry.world_to_cell(TRANSFORM, lon, lat)
    return occ(spark, sf).select("record_id", row.alias("row"), col.alias("col"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE \"row\" >= 50 OR col >= 40) AS outside FROM occ")
def extent_filter_counts(spark, sf):
    inside = F.col("row").between(0, 49) & F.col("col").between(0, 39)
    return occ(spark, sf).agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"))


@query('SELECT record_id, round(radians(10 + col + 0.5) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(50 - "row" - 0.5) / 2)) * 6378137.0, 4) AS y, 10 + col + 0.5::DOUBLE AS lon, 50 - "row" - 0.5::DOUBLE AS lat FROM occ')
def mercator_reproject(spark, sf):
    lon, lat = 10 + F.col("col") + F.lit(0.5), 50 - F.col("row") - F.lit(0.5)
    x, y = geometry.to_mercator(lon, lat)
    there = occ(spark, sf).select("record_id", x.alias("x"), y.alias("y"))
    back_lon, back_lat = geometry.from_mercator(F.col("x"), F.col("y"))
    return there.select("record_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(back_lon, 6).alias("lon"), F.round(back_lat, 6).alias("lat"))


@query('SELECT record_id, 10 + col + 0.5::DOUBLE AS lon, 50 - "row" - 0.5::DOUBLE AS lat FROM occ')
def utm_reproject(spark, sf):
    """Degrees to a zone of UTM, from there to Albers' conic, and back to degrees."""
    x, y = 10 + F.col("col") + F.lit(0.5), 50 - F.col("row") - F.lit(0.5)
    rows = occ(spark, sf).select("record_id", x.alias("x"), y.alias("y"))
    for source, target in (("EPSG:4326", "EPSG:32632"), ("EPSG:32632", "EPSG:3577"), ("EPSG:3577", "EPSG:4326")):
        rows = rows.withColumns(dict(zip("xy", projections.move(F.col("x"), F.col("y"), source, target), strict=True)))
    return rows.select("record_id", F.round("x", 6).alias("lon"), F.round("y", 6).alias("lat"))


_STATUS = ["PRESENT", "absent", " yes ", "0", "maybe", "", "False", "1"]
_DATES = ["2019-04-01", "2021-07-15T09:30:00Z", "1998", "sometime in spring", "", "2020-02-30", "2001-01-02/2001-02-03", "2011-05"]
_NUMBERS = ["1.5", " 7 ", "n/a", "", "1.5d", "-3e2", "12,5", ".25"]
_PICK = "list_extract([{}], CAST(record_id % 8 AS INT) + 1)"
_listed = lambda xs: ", ".join("'" + x + "'" for x in xs)


def _dirty(values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("record_id") % 8 + 1).cast("int"))


@query(
    f""", s AS (SELECT lower(trim({_PICK.format(_listed(_STATUS))})) AS v FROM occ)
SELECT CASE WHEN v IN ({_listed(parsing.PRESENT)}) THEN 1 WHEN v IN ({_listed(parsing.ABSENT)}) THEN 0 ELSE 1 END AS label,
v IN ({_listed(parsing.PRESENT + parsing.ABSENT)}) AS known, count(*) AS n FROM s GROUP BY 1, 2"""
)
def presence_parse(spark, sf):
    label = parsing.presence(_dirty(_STATUS))
    return occ(spark, sf).groupBy(F.coalesce(label, F.lit(1)).alias("label"), label.isNotNull().alias("known")).agg(F.count("*").alias("n"))


@query(
    f""", s AS (SELECT record_id, trim({_PICK.format(_listed(_DATES))}) AS v FROM occ)
SELECT record_id, CAST(CASE WHEN regexp_full_match(v, '\\d{{4}}') THEN TRY_CAST(v || '-01-01' AS DATE)
WHEN regexp_full_match(string_split(v, '/')[1], '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?') THEN TRY_CAST(substr(string_split(v, '/')[1], 1, 10) AS DATE) END AS VARCHAR) AS obs_date FROM s"""
)
def date_parse(spark, sf):
    return occ(spark, sf).select("record_id", parsing.observed(_dirty(_DATES)).cast("string").alias("obs_date"))


@query(f""", s AS (SELECT trim({_PICK.format(_listed(_NUMBERS))}) AS v FROM occ), p AS (SELECT CASE WHEN regexp_full_match(v, '[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?)') THEN TRY_CAST(v AS DOUBLE) END AS x FROM s)
SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS dropped, round(sum(x), 6) AS total FROM p""")
def coordinate_parse_losses(spark, sf):
    rows = occ(spark, sf).select(parsing.coordinate(_dirty(_NUMBERS)).alias("x"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("dropped"), six(F.sum("x"), "total"))


@query(
    f""", s AS (SELECT *, lower(trim({_PICK.format(_listed(_STATUS))})) AS v, trim({_PICK.format(_listed(_NUMBERS))}) AS shifted FROM occ),
p AS (SELECT *, CASE WHEN regexp_full_match(shifted, '[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?)') THEN TRY_CAST(shifted AS DOUBLE) END AS x FROM s)
SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS bad_coordinates, count(*) FILTER (WHERE x IS NOT NULL AND v NOT IN ({_listed(parsing.PRESENT + parsing.ABSENT)})) AS bad_labels,
count(*) FILTER (WHERE x IS NOT NULL AND obs_date IS NULL) AS bad_dates, count(*) FILTER (WHERE x IS NOT NULL AND NOT (trunc(x) >= 0 AND trunc(x) < {SIDE})) AS outside FROM p"""
)
def occurrence_account(spark, sf):
    """The whole reader's account over dirty strings: aliases, parsing, extent."""
    raw = occ(spark, sf).select(_dirty(_NUMBERS).alias("Column"), F.col("row").cast("string").alias("ROW"), _dirty(_STATUS).alias("occurrenceStatus"), F.col("obs_date").cast("string").alias("eventDate"))
    there = Grid(grid(spark, sf), ("p1", "p2"), SIDE, SIDE)
    parsed, _ = occurrence_source.parse(raw, occurrence_source.find_columns(raw.columns, False), there, "EPSG:4326")
    return occurrence_source.losses(parsed)


# --- virtual species

_NICHE = f', niche AS (SELECT "row", col, 1 / (1 + exp(-({INTERCEPT} + {BETA[0]} * ((p1 - m1) / s1) + {BETA[1]} * ((p2 - m2) / s2)))) AS s FROM grid, stat)'


@query(_NICHE + 'SELECT "row", col, round(s, 6) AS suitability FROM niche')
def virtual_suitability(spark, sf):
    return virtual.suitability(grid(spark, sf), BETA, INTERCEPT).select("row", "col", six("suitability", "suitability"))


@query(_NICHE + f"""SELECT "row", col FROM niche WHERE s > 0 ORDER BY -ln({_u("presence", "\"row\" || ':' || col")}) / s, "row", col LIMIT 200""")
def virtual_draw_without_replacement(spark, sf):
    cells = virtual.suitability(grid(spark, sf), BETA, INTERCEPT)
    return virtual.draw_without(cells, F.col("suitability"), 200, SEED, "presence").select("row", "col")


@query(
    _NICHE
    + f""", w AS (SELECT "row", col, round(s * 1000000) AS w FROM niche WHERE s IS NOT NULL),
c AS (SELECT *, sum(w) OVER (ORDER BY "row", col) AS hi, sum(w) OVER () AS total FROM w WHERE w > 0),
d AS (SELECT range AS id, {_u("with", "range")} AS u FROM range(1000))
SELECT id, "row", col FROM d JOIN c ON u * total >= hi - w AND u * total < hi"""
)
def virtual_draw_with_replacement(spark, sf):
    cells = virtual.suitability(grid(spark, sf), BETA, INTERCEPT)
    return virtual.draw_with(cells, F.round(F.col("suitability") * 1000000), 1000, SEED, "with").select("id", "row", "col")


# --- profile


@query('SELECT count(*) AS n_records, count(DISTINCT ("row", col)) AS n_unique_cells, count(*) FILTER (WHERE label = 1) AS n_presences, count(*) FILTER (WHERE label = 0) AS n_absences, round(avg(label), 6) AS prevalence, round(1 - count(DISTINCT ("row", col)) / count(*), 6) AS duplicate_fraction FROM occ')
def profile_volume(spark, sf):
    v = profile_stats.volume(occ(spark, sf))
    return v.withColumns({c: F.round(c, 6) for c in ("prevalence", "duplicate_fraction")})


# cells of a sparse subset of the data's own: those with a return, for which spacing is of interest
_PRESENT = ', one AS (SELECT DISTINCT "row", col FROM occ WHERE label = 1), nn AS (SELECT a."row", a.col, min(sqrt((a."row" - b."row") ** 2 + (a.col - b.col) ** 2)) AS d FROM one a JOIN one b ON a."row" <> b."row" OR a.col <> b.col GROUP BY 1, 2)'


@query(_PRESENT + "SELECT round(avg(d), 6) AS mean_nearest_neighbour_cells, round(avg(d) / (0.5 * sqrt((SELECT count(*) FROM valid) / count(*))), 6) AS nearest_neighbour_index FROM nn")
def profile_spatial_nn(spark, sf):
    cells = occ(spark, sf).filter("label = 1").select("row", "col").distinct()
    s = profile_stats.spacing(cells, profile_stats.valid_cells(grid(spark, sf)).count())
    return s.select(six("mean_nearest_neighbour_cells", "mean_nearest_neighbour_cells"), six("nearest_neighbour_index", "nearest_neighbour_index"))


@query('SELECT (SELECT count(*) FROM valid) AS extent_cells, count(DISTINCT ("row", col)) AS occupied_cells, round(count(DISTINCT ("row", col)) / (SELECT count(*) FROM valid), 6) AS coverage_fraction FROM occ')
def profile_coverage_fraction(spark, sf):
    extent = profile_stats.valid_cells(grid(spark, sf)).agg(F.count("*").alias("extent_cells"))
    cells = occ(spark, sf).agg(F.count_distinct("row", "col").alias("occupied_cells"))
    return extent.join(F.broadcast(cells)).withColumn("coverage_fraction", F.round(F.col("occupied_cells") / F.col("extent_cells"), 6))


_VARIOGRAM = f""", vs AS (SELECT *, row_number() OVER (ORDER BY k, "row", col) - 1 AS i, count(*) OVER () AS n FROM
(SELECT *, md5('{SEED}:variogram:' || "row" || ':' || col) AS k FROM valid ORDER BY k, "row", col LIMIT {profile_stats.VARIOGRAM_CELLS})),
sd AS (SELECT CASE WHEN stddev_pop(p1) = 0 THEN 1 ELSE stddev_pop(p1) END AS s1, CASE WHEN stddev_pop(p2) = 0 THEN 1 ELSE stddev_pop(p2) END AS s2 FROM vs),
dr AS (SELECT CAST(floor({_u("variogram-left", "range")} * n) AS BIGINT) AS a, CAST(floor({_u("variogram-right", "range")} * n) AS BIGINT) AS b FROM range({profile_stats.VARIOGRAM_PAIRS}), (SELECT max(n) AS n FROM vs)),
pr AS (SELECT sqrt((x."row" - y."row") ** 2 + (x.col - y.col) ** 2) AS d, (((x.p1 - y.p1) / s1) ** 2 + ((x.p2 - y.p2) / s2) ** 2) / 2 AS g FROM dr JOIN vs x ON x.i = a JOIN vs y ON y.i = b, sd WHERE a <> b),
bins AS (SELECT CAST(least(floor(d / ((SELECT max(d) FROM pr) / 25)), 24) AS INT) AS bin, count(*) AS n_pairs, avg(g) / 2 AS semivariance, (SELECT max(d) FROM pr) AS max_distance FROM pr GROUP BY 1)
"""


@query(_VARIOGRAM + "SELECT bin, n_pairs, round(semivariance, 6) AS semivariance, round(max_distance, 6) AS max_distance FROM bins")
def profile_variogram_bins(spark, sf):
    b = profile_stats.variogram(grid(spark, sf), K, SEED)
    return b.select("bin", "n_pairs", six("semivariance", "semivariance"), six("max_distance", "max_distance"))


_RANGE = (
    _VARIOGRAM
    + """, sill AS (SELECT avg(semivariance) AS s FROM (SELECT * FROM bins ORDER BY bin DESC LIMIT 5)),
found AS (SELECT (bin + 0.5) * max_distance / 25 AS reach, bin < 20 AS bounded FROM bins, sill WHERE semivariance >= 0.95 * s ORDER BY bin LIMIT 1)
"""
)


def _range(spark, sf) -> tuple[float, bool]:
    g = grid(spark, sf)
    n = min(profile_stats.valid_cells(g).count(), profile_stats.VARIOGRAM_CELLS)
    return profile_stats.variogram_range(profile_stats.variogram(g, K, SEED).collect(), n)


@query(_RANGE + "SELECT round(CAST(reach AS DOUBLE), 6) AS autocorrelation_range_cells, bounded AS autocorrelation_range_bounded FROM found")
def profile_variogram_range(spark, sf):
    reach, bounded = _range(spark, sf)
    return spark.createDataFrame([(round(reach, 6), bounded)], "autocorrelation_range_cells double, autocorrelation_range_bounded boolean")


@query(_RANGE + f"SELECT CAST(greatest(1, least(ceil(reach), greatest(1, {SIDE} // 4))) AS INT) AS block_size FROM found")
def suggested_block_size(spark, sf):
    reach, _ = _range(spark, sf)
    return spark.range(1).select(F.greatest(F.lit(1), F.least(F.ceil(F.lit(reach)), F.lit(max(1, SIDE // 4)))).cast("int").alias("block_size"))


def _edges(p: str) -> str:
    return f"(SELECT list_sort(list_distinct(quantile_cont({p}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) FROM land)"


@query(
    f""", e AS (SELECT {_edges("p1")} AS e1, {_edges("p2")} AS e2),
b AS (SELECT len(list_filter(e1[2:len(e1) - 1], lambda x: x <= p1)) AS b1, len(list_filter(e2[2:len(e2) - 1], lambda x: x <= p2)) AS b2, len(e1) AS n1, len(e2) AS n2 FROM sampled, e)
SELECT round((count(DISTINCT b1) / (max(n1) - 1) + count(DISTINCT b2) / (max(n2) - 1)) / 2, 6) AS environmental_coverage FROM b"""
)
def profile_environmental_coverage(spark, sf):
    return profile_stats.coverage(_sampled(spark, sf), _landscape(spark, sf), K).select(six("environmental_coverage", "environmental_coverage"))


_SHIFT = ", l AS (SELECT avg(p1) AS m1, avg(p2) AS m2, stddev_pop(p1) AS s1, stddev_pop(p2) AS s2 FROM land), a AS (SELECT avg(p1) AS a1, avg(p2) AS a2, stddev_pop(p1) FILTER (WHERE label = 1) AS n1, stddev_pop(p2) FILTER (WHERE label = 1) AS n2 FROM sampled)"


@query(_SHIFT + "SELECT round((abs(a1 - m1) / s1 + abs(a2 - m2) / s2) / 2, 6) AS covariate_shift, round(greatest(abs(a1 - m1) / s1, abs(a2 - m2) / s2), 6) AS max_univariate_shift FROM l, a")
def profile_covariate_shift(spark, sf):
    s = profile_stats.shift(_sampled(spark, sf), _landscape(spark, sf), K)
    return s.select(six("covariate_shift", "covariate_shift"), six("max_univariate_shift", "max_univariate_shift"))


@query(_SHIFT + "SELECT round((n1 / s1 + n2 / s2) / 2, 6) AS niche_breadth FROM l, a")
def profile_niche_breadth(spark, sf):
    return profile_stats.niche_breadth(_sampled(spark, sf), _landscape(spark, sf), K).select(six("niche_breadth", "niche_breadth"))


@query("SELECT (SELECT count(*) FROM occ) - count(*) AS n_excluded FROM sampled")
def profile_nodata_excluded(spark, sf):
    return stages.gather(occ(spark, sf), grid(spark, sf)).agg(F.count_if(~F.coalesce(stages.complete("predictors"), F.lit(False))).alias("n_excluded"))


_R = "coalesce(covar_pop(p1, p2) / nullif(stddev_pop(p1) * stddev_pop(p2), 0), 0)"


@query(f", r AS (SELECT {_R} AS r FROM land) SELECT i, j, round(CASE WHEN i = j THEN 1.0::DOUBLE ELSE r END, 6) AS r FROM r, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS p(i, j)")
def profile_correlation_matrix(spark, sf):
    return profile_stats.correlation(_landscape(spark, sf), K).select("i", "j", six("r", "r"))


def _collinearity(spark, sf) -> tuple[float, float, float]:
    m = np.eye(K)
    for r in profile_stats.correlation(_landscape(spark, sf), K).collect():
        m[r["i"], r["j"]] = r["r"]
    return profile_stats.collinearity(m)


@query(f", r AS (SELECT {_R} AS r FROM land) SELECT round(4 / (2 + 2 * r * r), 6) AS effective_dimensionality FROM r")
def profile_effective_dimensionality(spark, sf):
    return spark.createDataFrame([(round(_collinearity(spark, sf)[2], 6),)], "effective_dimensionality double")


@query(f", r AS (SELECT {_R} AS r FROM land) SELECT round(abs(r), 6) AS max_abs_correlation, round(1 / (1 - r * r), 6) AS max_vif FROM r")
def profile_vif(spark, sf):
    high, vif, _ = _collinearity(spark, sf)
    return spark.createDataFrame([(round(high, 6), round(vif, 6))], "max_abs_correlation double, max_vif double")


@query("SELECT count(obs_date) AS n_dated_records, CAST(max(obs_date) - min(obs_date) AS INT) AS span_days, CAST(min(obs_date) AS VARCHAR) AS first_date, CAST(max(obs_date) AS VARCHAR) AS last_date, round(count(obs_date) / ((max(obs_date) - min(obs_date)) / 365.25), 6) AS median_records_per_year FROM occ")
def profile_temporal(spark, sf):
    rows = profile_stats.temporal(occ(spark, sf)).withColumn("median_records_per_year", F.round("median_records_per_year", 6))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


# --- rules and the search space

# What the catalogue and the rules must hold, stated by hand: the oracles below don't read the code under test.
_METHODS = [("cleaning", "drop_duplicate_cells"), ("accessible_area", "full_extent"), ("predictors", "standardize"), ("split", "random_kfold"), ("split", "spatial_block"), ("algorithm", "gbm"), ("algorithm", "logistic")]
_CELLS, _VIF, _NNI, _SHIFTED = "profile.volume.n_unique_cells", "profile.environmental.max_vif", "profile.spatial.nearest_neighbour_index", "profile.sampling.covariate_shift"
_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"
_values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + ")"
_RULES = [
    ("small_sample_favours_simple_models", "algorithm", "logistic", 1.0, _CELLS, "<", None, 50.0),
    ("small_sample_penalises_boosting", "algorithm", "gbm", -1.0, _CELLS, "<", None, 50.0),
    ("ample_data_favours_flexible_models", "algorithm", "gbm", 0.7, _CELLS, ">=", None, 300.0),
    ("collinear_predictors_favour_trees", "algorithm", "gbm", 0.5, _VIF, ">", None, 10.0),
    ("clustered_sampling_requires_spatial_blocks", "split", "spatial_block", 1.5, _NNI, "<", None, 0.8),
    ("covariate_shift_requires_spatial_blocks", "split", "spatial_block", 1.0, _SHIFTED, ">", None, 0.5),
    ("spatial_transfer_requires_spatial_blocks", "split", "spatial_block", 1.5, "objective", "==", "spatial_transfer", None),
    ("interpolation_tolerates_random_folds", "split", "random_kfold", 0.5, "objective", "==", "interpolation", None),
]
# --- scores

_SCORED = _KFOLD + f", sc AS (SELECT fold, label, floor({_u('score', 'record_id')} * 1000) / 1000 + label * 0.1::DOUBLE AS score FROM kf), rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS r FROM sc), au AS (SELECT fold, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))::DOUBLE) AS auc FROM rk GROUP BY fold)"


def _labelled_folds(spark, sf):
    """Random folds of what scores need of the records: these are placed in their orders once, for counts and for places."""
    return stages.random_kfold(hold(occ(spark, sf).select("record_id", "label")), FOLDS, SEED)


def _scored(spark, sf):
    rows = _labelled_folds(spark, sf)
    return rows.withColumn("score", F.floor(draws.uniform(SEED, "score", F.col("record_id")) * 1000) / 1000 + F.col("label") * F.lit(0.1))


@query(_SCORED + "SELECT fold, round(auc, 6) AS auc FROM au")
def auc_per_fold(spark, sf):
    return stages.auc(_scored(spark, sf), ["fold"]).select("fold", six("auc", "auc"))


@query(_SCORED + "SELECT round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_sd, count(auc) AS n_scored_folds FROM au")
def cv_auc_summary(spark, sf):
    return stages.auc(_scored(spark, sf), ["fold"]).agg(six(F.avg("auc"), "auc_mean"), six(F.stddev_pop("auc"), "auc_sd"), F.count("auc").alias("n_scored_folds"))


def _cross_validated(spark, sf, learner: str, params: dict) -> DataFrame:
    g = grid(spark, sf)
    rows = stages.standardise(_clean(spark, sf), g, *stages.layer_stats(g, K)).filter("features is not null")
    folded = stages.spatial_block_folds(rows, BLOCK, FOLDS, SEED).select("record_id", "label", "features", "fold")
    return algorithms.cross_validate(folded, learner, params, SEED)[0].select("record_id", "fold", "label", "cv_prediction")


#: A learner's numbers are its own; SQL states which records are scored, in which fold, and that no prediction is missing or no probability.
_USABLE = f""", usable AS (SELECT clean.* FROM clean JOIN valid USING ("row", col)),
ublocks AS (SELECT DISTINCT "row" // {BLOCK} AS br, col // {BLOCK} AS bc FROM usable),
ufolds AS (SELECT br, bc, CAST((row_number() OVER (ORDER BY md5('{SEED}:block:' || br || ':' || bc), br, bc) - 1) % {FOLDS} AS INT) AS fold FROM ublocks),
ufolded AS (SELECT usable.*, fold FROM usable JOIN ufolds ON br = "row" // {BLOCK} AND bc = col // {BLOCK}),
sides AS (SELECT fold, count(*) AS n, sum(label) AS p FROM ufolded GROUP BY fold),
scorable AS (SELECT fold, n, p, p > 0 AND p < n AND (SELECT sum(p) FROM sides) - p > 0 AND (SELECT sum(p) FROM sides) - p < (SELECT sum(n) FROM sides) - n AS ok FROM sides)
"""


def _as_states(rows: DataFrame) -> DataFrame:
    return rows.select("record_id", "fold", "label", F.col("cv_prediction").isNotNull().alias("scored"), F.coalesce(F.col("cv_prediction").between(0, 1), F.lit(False)).alias("is_probability"))


_STATES = _USABLE + "SELECT record_id, fold, label, ok AS scored, ok AS is_probability FROM ufolded JOIN scorable USING (fold)"


@query(_STATES)
def logistic_cv(spark, sf):
    return _as_states(_cross_validated(spark, sf, "logistic", {}))


@query(_STATES)
def gbm_cv(spark, sf):
    return _as_states(_cross_validated(spark, sf, "gbm", {}))


# --- selection

_SIM = """CASE WHEN list_aggregate(list_transform({r}, lambda x: CASE WHEN x < {p} THEN 1 ELSE 0 END), 'sum') = 0 THEN 100 * ({p} - {r}[1]) / ({r}[len({r})] - {r}[1])
WHEN {p} > {r}[len({r})] THEN 100 * ({r}[len({r})] - {p}) / ({r}[len({r})] - {r}[1])
ELSE least(200.0::DOUBLE * len(list_filter({r}, lambda x: x < {p})) / len({r}), 2 * (100 - 100.0::DOUBLE * len(list_filter({r}, lambda x: x < {p})) / len({r}))) END"""
_CORNER = 'valid WHERE "row" < 30 ORDER BY md5(\'42:reference:\' || "row" || \':\' || col), "row", col LIMIT 200'


@query(
    f""", ref AS (SELECT list_sort(list(p1)) AS r1, list_sort(list(p2)) AS r2 FROM (SELECT * FROM {_CORNER}))
SELECT "row", col, round(least({_SIM.format(p="p1", r="r1")}, {_SIM.format(p="p2", r="r2")}), 6) AS mess FROM valid, ref"""
)
def novelty_mess(spark, sf):
    g = profile_stats.valid_cells(grid(spark, sf))
    reference = profile_stats.sample_cells(g.filter("row < 30"), 200, SEED, "reference")
    return selection.mess(g, reference, K).select("row", "col", six("mess", "mess"))


@query(
    f""", ref AS (SELECT min(p1) AS lo1, max(p1) AS hi1, avg(p1) AS m1, min(p2) AS lo2, max(p2) AS hi2, avg(p2) AS m2, var_pop(p1) AS a, covar_pop(p1, p2) AS b, var_pop(p2) AS c FROM (SELECT * FROM {_CORNER})),
far AS (SELECT max((c * (p1 - m1) ** 2 - 2 * b * (p1 - m1) * (p2 - m2) + a * (p2 - m2) ** 2) / (a * c - b * b)) AS top FROM (SELECT * FROM {_CORNER}), ref),
nt AS (SELECT "row", col, least(0, p1 - lo1, hi1 - p1) / (hi1 - lo1) + least(0, p2 - lo2, hi2 - p2) / (hi2 - lo2) AS one, (c * (p1 - m1) ** 2 - 2 * b * (p1 - m1) * (p2 - m2) + a * (p2 - m2) ** 2) / (a * c - b * b) / top AS two FROM valid, ref, far)
SELECT "row", col, round(CASE WHEN one < 0 THEN one ELSE two END, 6) AS exdet FROM nt"""
)
def novelty_exdet(spark, sf):
    g = profile_stats.valid_cells(grid(spark, sf))
    reference = profile_stats.sample_cells(g.filter("row < 30"), 200, SEED, "reference")
    return selection.exdet(g, reference, K).select("row", "col", six("exdet", "exdet"))


_CELL = "len(list_filter((SELECT quantile_cont({p}, [1/3, 2/3]) FROM valid), lambda x: x <= {p}))"


@query(
    f""", own AS (SELECT record_id, {_CELL.format(p="p1")} AS c1, {_CELL.format(p="p2")} AS c2 FROM sampled), every AS (SELECT {_CELL.format(p="p1")} AS c1, {_CELL.format(p="p2")} AS c2 FROM valid),
s AS (SELECT c1, c2, count(*) / (SELECT count(*) FROM own) AS share FROM own GROUP BY 1, 2), l AS (SELECT c1, c2, count(*) / (SELECT count(*) FROM every) AS share FROM every GROUP BY 1, 2)
SELECT record_id, round(l.share / s.share, 6) AS weight FROM own JOIN s USING (c1, c2) JOIN l USING (c1, c2)"""
)
def importance_weights(spark, sf):
    return selection.importance_weights(_sampled(spark, sf), profile_stats.valid_cells(grid(spark, sf)), K).select("record_id", six("weight", "weight"))


@query(
    f"""SELECT "row", col FROM (SELECT "row", col, count(*) AS n FROM occ GROUP BY 1, 2) JOIN grid USING ("row", col) ORDER BY -ln({_u("target_group", "\"row\" || ':' || col")}) / n, "row", col LIMIT 150"""
)
def target_group_background(spark, sf):
    return stages.target_group_background(stages.full_extent(grid(spark, sf)), occ(spark, sf), 150, SEED).select("row", "col")


_SUIT = ", sq AS (SELECT label, least(1, greatest(0, score)) AS score FROM sc)"


@query(_SCORED + _SUIT + ", b AS (SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) FILTER (WHERE label = 1) AS presences, count(*) AS available FROM sq GROUP BY 1) SELECT bin, presences, available, round((presences / sum(presences) OVER ()) / (available / sum(available) OVER ()), 6) AS ratio FROM b")
def boyce_bins(spark, sf):
    rows = _scored(spark, sf).select("label", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    return selection.boyce_bins(rows).select("bin", "presences", "available", six("ratio", "ratio"))


@query(_SCORED + ", w AS (SELECT label, score, CASE WHEN fold < 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sc), v AS (SELECT score, coalesce(sum(weight) FILTER (WHERE label = 1), 0) AS p, coalesce(sum(weight) FILTER (WHERE label = 0), 0) AS q FROM w GROUP BY 1), r AS (SELECT p, q, p * (sum(q) OVER (ORDER BY score) - q / 2) AS ok FROM v) SELECT round(sum(ok) / (sum(p) * sum(q)), 6) AS weighted_auc FROM r")
def importance_weighted_auc(spark, sf):
    rows = _scored(spark, sf).withColumn("weight", F.when(F.col("fold") < 2, 2.0).otherwise(1.0))
    return selection.weighted_auc(rows).select(six("weighted_auc", "weighted_auc"))


#: Two candidates' scores of each record, and the species that it counts for: a band of the grid.
_TWO = _KFOLD + f""", two AS (SELECT 'a' AS candidate_id, "row" // 20 AS species, fold, label, floor({_u("a", "record_id")} * 1000) / 1000 + label * 0.2::DOUBLE AS score FROM kf UNION ALL SELECT 'b', "row" // 20, fold, label, floor({_u("b", "record_id")} * 1000) / 1000 + label * fold * 0.1::DOUBLE FROM kf),
rf AS (SELECT *, rank() OVER (PARTITION BY candidate_id, species, fold ORDER BY score) + (count(*) OVER (PARTITION BY candidate_id, species, fold, score) - 1) / 2.0::DOUBLE AS r FROM two),
af AS (SELECT candidate_id, species, fold, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))::DOUBLE) AS auc FROM rf GROUP BY ALL),
cv AS (SELECT candidate_id, species, avg(auc) - 0.5 * stddev_pop(auc) AS total FROM af GROUP BY ALL),
re AS (SELECT *, rank() OVER (PARTITION BY candidate_id, species ORDER BY score) + (count(*) OVER (PARTITION BY candidate_id, species, score) - 1) / 2.0::DOUBLE AS r FROM two),
tr AS (SELECT candidate_id, species, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))::DOUBLE) AS score_true FROM re GROUP BY ALL)"""


def _candidates(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(candidate_id, species, metric, value) over folds, and (candidate_id, species, score_true) over all records."""
    rows = stages.random_kfold(occ(spark, sf), FOLDS, SEED).withColumn("species", F.floor(F.col("row") / 20).cast("int"))
    lifts = {"a": F.col("label") * F.lit(0.2), "b": F.col("label") * F.col("fold") * F.lit(0.1)}
    each = [rows.select(F.lit(c).alias("candidate_id"), "species", "fold", "label", (F.floor(draws.uniform(SEED, c, F.col("record_id")) * 1000) / 1000 + lift).alias("score")) for c, lift in lifts.items()]
    two = hold(each[0].unionByName(each[1]))
    own = ["candidate_id", "species"]
    folds = stages.auc(two, [*own, "fold"]).groupBy(*own).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_sd"))
    metrics = folds.select(*own, F.explode(F.map_from_arrays(F.array(F.lit("auc_mean"), F.lit("auc_sd")), F.array("auc_mean", "auc_sd"))).alias("metric", "value"))
    return metrics, stages.auc(two, own).select(*own, F.col("auc").alias("score_true"))


@query(_TWO + " SELECT candidate_id || ':' || species AS candidate_id, round(total, 6) AS total FROM cv")
def composite_scores(spark, sf):
    rows = _candidates(spark, sf)[0].withColumn("candidate_id", F.concat_ws(":", "candidate_id", "species"))
    return selection.composite(rows, selection.WEIGHTS["spatial_transfer"]).select("candidate_id", six("total", "total"))


REPLICATES = 6
_DRAWN = " + ".join(f"CAST(u > {p!r}::DOUBLE AS INT)" for p in selection.POISSON)
_BOOT = (
    _KFOLD
    + f""", sc2 AS (SELECT 'a' AS candidate_id, record_id, fold, label, floor({_u("a", "record_id")} * 200) / 200 + label * 0.2::DOUBLE AS score FROM kf UNION ALL SELECT 'b', record_id, fold, label, floor({_u("b", "record_id")} * 200) / 200 + label * fold * 0.1::DOUBLE FROM kf),
wt AS (SELECT *, {_DRAWN} AS w FROM (SELECT sc2.*, b.i AS replicate, {_u("bootstrap", "b.i || ':' || record_id")} AS u FROM sc2, range({REPLICATES}) b(i))),
vs2 AS (SELECT candidate_id, fold, replicate, score, coalesce(sum(w) FILTER (WHERE label = 1), 0) AS p, coalesce(sum(w) FILTER (WHERE label = 0), 0) AS q FROM wt WHERE w > 0 GROUP BY ALL),
ok2 AS (SELECT *, p * (sum(q) OVER (PARTITION BY candidate_id, fold, replicate ORDER BY score) - q / 2) AS ok FROM vs2),
ab AS (SELECT candidate_id, fold, replicate, sum(ok) / (sum(p) * sum(q)) AS auc FROM ok2 GROUP BY ALL),
am AS (SELECT candidate_id, replicate, avg(auc) AS auc FROM ab GROUP BY ALL),
be AS (SELECT *, auc = max(auc) OVER (PARTITION BY replicate) AS best FROM am)"""
)


def _both_scored(spark, sf) -> DataFrame:
    rows = _labelled_folds(spark, sf)
    lifts = {"a": F.col("label") * F.lit(0.2), "b": F.col("label") * F.col("fold") * F.lit(0.1)}
    both = F.array(*[F.struct(F.lit(c).alias("candidate_id"), (F.floor(draws.uniform(SEED, c, F.col("record_id")) * 200) / 200 + lift).alias("score")) for c, lift in lifts.items()])
    return rows.select("record_id", "fold", "label", F.inline(both))


@query(_BOOT + f" SELECT candidate_id, round(avg(auc), 6) AS auc, round(stddev_pop(auc), 6) AS sd, round(sum(CAST(best AS INT)) / {REPLICATES}, 6) AS wins FROM be GROUP BY candidate_id")
def fold_stability(spark, sf):
    """How far each candidate's AUC and rank depend on the records that happen to be there."""
    return selection.stability(_both_scored(spark, sf), REPLICATES, SEED).select("candidate_id", six("auc", "auc"), six("sd", "sd"), six("wins", "wins"))


@query(
    _BOOT
    + """, r1 AS (SELECT *, rank() OVER (PARTITION BY candidate_id, fold ORDER BY score) + (count(*) OVER (PARTITION BY candidate_id, fold, score) - 1) / 2.0::DOUBLE AS r FROM sc2),
a1 AS (SELECT candidate_id, fold, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))::DOUBLE) AS auc FROM r1 GROUP BY ALL),
k1 AS (SELECT candidate_id, sum(CASE WHEN auc > other THEN 2.0::DOUBLE WHEN auc = other THEN 1.5 ELSE 1 END) AS r, count(*) AS m FROM (SELECT a1.*, o.auc AS other FROM a1 JOIN a1 o ON o.fold = a1.fold AND o.candidate_id <> a1.candidate_id) GROUP BY 1)
SELECT count(*) AS n_candidates, max(m) AS n_folds, round(12 * var_pop(r) * 2 / (max(m) * max(m) * 6.0::DOUBLE), 6) AS w FROM k1"""
)
def fold_concordance(spark, sf):
    """Whether folds rank the candidates alike."""
    aucs = stages.auc(_both_scored(spark, sf), ["candidate_id", "fold"]).select("candidate_id", "fold", "auc")
    return selection.concordance(aucs).select("n_candidates", "n_folds", six("w", "w"))


@query(_TWO + " SELECT CAST(species AS INT) AS species, round(arg_max(score_true, total) - max(score_true), 6) AS regret FROM cv JOIN tr USING (candidate_id, species) GROUP BY species")
def selector_regret(spark, sf):
    metrics, truth = _candidates(spark, sf)
    named = metrics.withColumn("candidate_id", F.concat_ws(":", "candidate_id", "species"))
    total = selection.composite(named, selection.WEIGHTS["spatial_transfer"]).select(F.substring_index("candidate_id", ":", 1).alias("candidate_id"), F.substring_index("candidate_id", ":", -1).cast("int").alias("species"), "total")
    return selection.regret(total.join(truth, ["candidate_id", "species"])).select("species", six("regret", "regret"))


# --- registry and records

@query(
    f""", s AS (SELECT {_PICK.format(_listed(_STATUS))} AS v FROM occ)
SELECT 'unreadable_presence' AS code, 'occurrences.presence' AS feature, v AS requested_value, count(*) AS n FROM s WHERE lower(trim(v)) NOT IN ({_listed(parsing.PRESENT + parsing.ABSENT)}) GROUP BY v"""
)
def gap_backlog(spark, sf):
    """What the records ask for and the parser can't give, by how often."""
    raw = _dirty(_STATUS)
    gaps = occ(spark, sf).filter(parsing.presence(raw).isNull()).select(F.lit("unreadable_presence").alias("code"), F.lit("not a known spelling").alias("message"), F.lit("occurrences.presence").alias("feature"), raw.alias("requested_value"))
    return executor.backlog(gaps)


@query("SELECT CASE WHEN p1 IS NULL THEN 'dropped_records_with_missing_predictors' ELSE 'kept' END AS code, count(*) AS n FROM occ LEFT JOIN grid USING (\"row\", col) GROUP BY 1")
def assumption_counts(spark, sf):
    rows = stages.gather(occ(spark, sf), grid(spark, sf))
    code = F.when(F.coalesce(stages.complete("predictors"), F.lit(False)), "kept").otherwise("dropped_records_with_missing_predictors")
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
