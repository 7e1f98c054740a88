import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichesearch import RealDataSource, UnsupportedDataSource, VirtualDataSource, load_data_source
from nichesearch.functions import caching, geometry, parsing
from nichesearch.operators import stages
from nichesearch.schema import UnreadableOccurrences, UnreadableRasters
from nichesearch.sources import occurrences, rasters

from .fields import SIDE, layers, npy, table, tiff


@pytest.fixture(scope="module")
def geo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("geo")
    return [tiff(folder / f"{n}.tif", v) for n, v in layers().items()]


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    return npy(tmp_path_factory.mktemp("flat"), layers())


def array(grid):
    out = np.full((2, grid.height, grid.width), np.nan)
    for r in grid.cells.collect():
        out[:, r.row, r.col] = [np.nan if v is None else v for v in r.predictors]
    return out


def test_npy_and_tiff_layers_are_read_alike(spark, geo, flat):
    want = np.stack(list(layers().values()))
    a, b = rasters.read_predictors(spark, flat), rasters.read_predictors(spark, geo)
    assert np.array_equal(array(a), want) and np.array_equal(array(b), want)
    assert a.names == b.names == ("temp", "precip") and a.shape == (SIDE, SIDE)
    assert not a.is_georeferenced and b.transform == (1.0, 0.0, 10.0, 0.0, -1.0, 50.0) and b.crs == "EPSG:4326"


@pytest.mark.parametrize(
    "how",
    [
        {"deflate": True},
        {"tile": 16},
        {"tile": 16, "deflate": True},
        {"packed": "lzw"},
        {"packed": "lzw", "tile": 64},
        {"big": True},
        {"big": True, "packed": "lzw", "tile": 32},
        {"predictor": 3},
        {"predictor": 3, "packed": "lzw", "tile": 64},
        {"predictor": 3, "deflate": True, "dtype": "<f4"},
        {"predictor": 2, "packed": "lzw", "dtype": "<i2"},
        {"predictor": 2, "deflate": True, "dtype": "<u4", "big": True},
    ],
)
def test_tiff_layouts(tmp_path, how):
    dtype = np.dtype(how.get("dtype", "<f8"))
    v = np.random.default_rng(0).normal(size=(37, 53)).astype(dtype) if dtype.kind == "f" else np.random.default_rng(0).integers(0, 300, (37, 53)).astype(dtype)
    if dtype.kind == "u":
        v[3, 5] = 9999
        found = rasters.decode("x.tif", open(tiff(tmp_path / "x.tif", v, nodata="9999", **how), "rb").read())["values"]
        assert np.isnan(found[3, 5]) and np.array_equal(np.delete(found.ravel(), 3 * 53 + 5), np.delete(v.ravel(), 3 * 53 + 5).astype(float))
        return
    v[3, 5] = -9999
    found = rasters.decode("x.tif", open(tiff(tmp_path / "x.tif", v, nodata="-9999", **how), "rb").read())["values"]
    assert np.isnan(found[3, 5]) and np.nanmax(np.abs(found - np.where(v == -9999, np.nan, v))) == 0


def test_typed_failures_of_rasters(spark, tmp_path, geo, flat):
    bad = tmp_path / "bad.tif"
    bad.write_bytes(b"II*\0")
    (tmp_path / "x.asc").write_text("ncols 2")
    cases = {
        "unsupported_predictor_format": [str(tmp_path / "x.asc")],
        "unreadable_raster": [str(bad)],
        "unsupported_predictor_shape": npy(tmp_path, {"deep": np.zeros((2, 2, 2))}),
        "unsupported_multiband_raster": [tiff(tmp_path / "two.tif", np.zeros((4, 4)), bands=2)],
        "mixed_predictor_georeferencing": [flat[0], geo[1]],
        "misaligned_predictors": npy(tmp_path, {"a": np.zeros((10, 10)), "b": np.zeros((10, 12))}),
    }
    for code, paths in cases.items():
        with pytest.raises(UnreadableRasters) as e:
            rasters.read_predictors(spark, paths)
        assert e.value.gap.code == code and e.value.gap.feature == "predictor_format"
    for other in ({"origin": (11.0, 50.0)}, {"epsg": 3857}):
        with pytest.raises(UnreadableRasters, match="differ"):
            rasters.read_predictors(spark, [geo[0], tiff(tmp_path / "o.tif", layers()["temp"], **other)])
    with pytest.raises(UnreadableRasters):
        rasters.read_predictors(spark, [str(tmp_path / "missing.npy")])


def read(spark, path, geo, crs="EPSG:4326", field=None):
    grid = rasters.read_predictors(spark, geo)
    rows, dated, said = occurrences.read_occurrences(spark, path, grid, crs, field)
    return rows.orderBy("record_id").collect(), dated, {a.code: a.message for a in said}


CELLS = [(3, 7), (20, 41), (0, 0), (59, 59)]
WORLD = [(10 + c + 0.5, 50 - r - 0.5) for r, c in CELLS]


@pytest.mark.parametrize("names", [("decimalLongitude", "decimalLatitude"), ("longitude", "latitude"), ("LON", "Lat"), ("x", "y")])
def test_world_coordinates_fall_in_their_cells(spark, tmp_path, geo, names):
    path = table(tmp_path / "o.csv", names, WORLD)
    rows, dated, said = read(spark, path, geo)
    assert sorted((r.row, r.col) for r in rows) == sorted(CELLS) and not dated and not said
    assert {r.label for r in rows} == {1}


def test_statuses_dates_and_losses(spark, tmp_path, geo):
    rows = [(*WORLD[0], "PRESENT", "2019-04-01"), (*WORLD[1], "ABSENT", "2021-07-15T09:30:00Z"), (*WORLD[2], "maybe", "1998"), (-40, 12, "absent", "2000-01-01"), ("n/a", 1, "1", "2000-01-01"), (*WORLD[3], "0", "sometime")]
    found, dated, said = read(spark, table(tmp_path / "o.csv", ("decimalLongitude", "decimalLatitude", "occurrenceStatus", "eventDate"), rows), geo)
    found = sorted(found, key=lambda r: CELLS.index((r.row, r.col)))
    assert [r.label for r in found] == [1, 0, 1, 0] and dated
    assert [r.obs_date for r in found] == [datetime.date(2019, 4, 1), datetime.date(2021, 7, 15), datetime.date(1998, 1, 1), None]
    assert set(said) == {"dropped_unparseable_coordinates", "unreadable_presence_values_treated_as_presence", "dropped_unparseable_dates", "dropped_records_outside_extent"}
    assert said["dropped_records_outside_extent"].startswith("1 of 5") and said["dropped_unparseable_coordinates"].startswith("1 of 6")


def test_rows_and_columns_need_no_transform(spark, tmp_path, flat):
    rows, _, said = read(spark, table(tmp_path / "o.csv", ("row", "column", "presence"), [(5, 6, 1), (-0.5, 3.9, 0), (60, 1, 1), ("nan", 2, 1)]), flat)
    assert sorted((r.row, r.col, r.label) for r in rows) == [(0, 3, 0), (5, 6, 1)]
    assert said["dropped_records_outside_extent"].startswith("2 of 4")


def test_typed_failures_of_occurrences(spark, tmp_path, geo, flat):
    def code(path, paths, crs="EPSG:4326"):
        with pytest.raises(UnreadableOccurrences) as e:
            read(spark, path, paths, crs)
        return e.value.gap.code

    world = table(tmp_path / "w.csv", ("lon", "lat"), WORLD)
    assert code(str(tmp_path / "none.csv"), geo) == "missing_occurrence_file"
    assert code(table(tmp_path / "e.csv", ("lon", "lat"), []), geo) == "empty_occurrence_file"
    assert code(table(tmp_path / "u.csv", ("easting", "northing"), [(1, 2)]), geo) == "unrecognised_occurrence_columns"
    assert code(world, flat) == "ungeoreferenced_predictors"
    assert code(table(tmp_path / "b.csv", ("lon", "lat"), [("", "x")]), geo) == "no_usable_occurrences"
    if occurrences.Transformer is None:
        assert code(world, geo, "EPSG:27700") == "missing_reprojection_runtime"


def test_mercator_is_moved_to_degrees(spark, tmp_path, geo):
    r = geometry.RADIUS
    moved = [(np.radians(x) * r, np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * r) for x, y in WORLD]
    rows, _, said = read(spark, table(tmp_path / "m.csv", ("x", "y"), moved), geo, "epsg:3857 ")
    assert sorted((r.row, r.col) for r in rows) == sorted(CELLS) and set(said) == {"reprojected_occurrences"}
    rows, _, said = read(spark, table(tmp_path / "m.csv", ("x", "y"), moved), geo)
    assert not rows and said["dropped_records_outside_extent"].startswith("4 of 4")


def test_parsing_is_strict(spark):
    numbers = {"1.5": 1.5, " 7 ": 7.0, "1.5d": None, "12,5": None, "-3e2": -300.0, "": None, "1_0": None}
    days = {"2011-05": None, "2020-02-30": None, "2020-02-29": datetime.date(2020, 2, 29), "2001-01-02/2001-03-04": datetime.date(2001, 1, 2), "2019-12-31T23:30-05:00": datetime.date(2019, 12, 31), "99": None}
    one = spark.createDataFrame([(k,) for k in numbers], "s string").select("s", parsing.coordinate(F.col("s")).alias("v")).collect()
    two = spark.createDataFrame([(k,) for k in days], "s string").select("s", parsing.observed(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in one} == numbers and {r.s: r.v for r in two} == days
    with pytest.raises(UnreadableRasters, match="inverse"):
        geometry.world_to_cell((1, 1, 0, 1, 1, 0), F.lit(1.0), F.lit(1.0))


def virtual(paths, **more):
    return VirtualDataSource(paths, (1.6, -0.9), n_presences=150, n_absences=150, **more)


def test_a_virtual_species_follows_its_niche_and_repeats(spark, flat):
    ctx, said = load_data_source(spark, virtual(flat), 42)
    again, _ = load_data_source(spark, virtual(flat), 42)
    other, _ = load_data_source(spark, virtual(flat), 7)
    cells = lambda c: sorted((r.row, r.col, r.label) for r in c.occurrences.collect())
    assert not said and cells(ctx) == cells(again) != cells(other)
    rows = {label: np.mean([r for r, _, x in cells(ctx) if x == label]) for label in (0, 1)}
    assert rows[1] > rows[0] + 5
    assert ctx.occurrences.columns == ["record_id", "row", "col", "label", "obs_date"] and ctx.grid.columns == ["row", "col", "predictors"]


def test_virtual_gaps_and_nodata(spark, tmp_path, flat):
    with pytest.raises(UnsupportedDataSource) as e:
        load_data_source(spark, virtual(flat, sampling_bias="roads"), 1)
    assert e.value.gap.code == "unsupported_sampling_bias"
    holes = layers()
    holes["temp"][:5] = np.nan
    ctx, said = load_data_source(spark, virtual(npy(tmp_path, holes)), 1)
    assert [a.code for a in said] == ["virtual_species_excluded_nodata_cells"] and ctx.occurrences.filter("row < 5").isEmpty()
    with pytest.raises(UnsupportedDataSource) as e:
        load_data_source(spark, virtual(npy(tmp_path, {"a": np.full((5, 5), np.nan), "b": np.zeros((5, 5))})), 1)
    assert e.value.gap.code == "degenerate_virtual_species"
    few = npy(tmp_path, {"c": np.arange(25.0).reshape(5, 5), "d": np.ones((5, 5))})
    assert load_data_source(spark, virtual(few), 1)[0].occurrences.count() == 300  # with replacement


def test_predictor_gaps_come_first(spark, tmp_path):
    with pytest.raises(UnsupportedDataSource) as e:
        load_data_source(spark, RealDataSource("none.csv", (str(tmp_path / "x.asc"),), "presence_only"), 1)
    assert e.value.gap.code == "unsupported_predictor_format"


def test_files_that_the_library_writes_are_read_back(spark, tmp_path):
    values = layers(0.1)
    values["temp"][4, 9] = np.nan
    (tmp_path / "temp.tif").write_bytes(rasters.tiff_bytes(values["temp"], (1.0, 0.0, 10.0, 0.0, -1.0, 50.0)))
    (tmp_path / "precip.tif").write_bytes(rasters.tiff_bytes(values["precip"], (1.0, 0.0, 10.0, 0.0, -1.0, 50.0)))
    grid = rasters.read_predictors(spark, [str(tmp_path / "temp.tif"), str(tmp_path / "precip.tif")])
    assert np.array_equal(array(grid), np.stack(list(values.values())), equal_nan=True)
    assert grid.transform == (1.0, 0.0, 10.0, 0.0, -1.0, 50.0) and grid.crs == "EPSG:4326"
    (tmp_path / "temp.npy").write_bytes(rasters.npy_bytes(values["temp"]))
    assert np.array_equal(rasters.decode("temp.npy", (tmp_path / "temp.npy").read_bytes())["values"], values["temp"], equal_nan=True)
    with pytest.raises((ValueError, struct.error)):
        rasters.header("t.tif", rasters.tiff_bytes(values["temp"], (1.0, 0.0, 10.0, 0.0, -1.0, 50.0))[:-3000])


def test_a_csv_is_split_and_ids_do_not_depend_on_it(spark, tmp_path, geo):
    rng = np.random.default_rng(3)
    rows = [(10 + rng.random() * 60, 50 - rng.random() * 60, int(rng.integers(0, 2)), f"2020-01-{i % 28 + 1:02d}") for i in range(20_000)]
    path = table(tmp_path / "big.csv", ("lon", "lat", "presence", "date"), rows)
    grid = rasters.read_predictors(spark, geo)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = {}
    try:
        for size in ("64m", "128k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            occ, _, _ = occurrences.read_occurrences(spark, path, grid, "EPSG:4326")
            parts = occ.rdd.getNumPartitions()
            found[size] = sorted(map(tuple, stages.random_kfold(occ, 4, 1).select("record_id", "row", "col", "label", "fold").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 4 and found["64m"] == found["128k"] and len(found["64m"]) == 20_000


def test_records_over_several_lines_are_read_whole(spark, tmp_path, geo):
    path = table(tmp_path / "notes.csv", ("lon", "lat", "notes"), [(*WORLD[0], 'one\ntwo "quoted"'), (*WORLD[1], "plain")])
    rows, _, _ = read(spark, path, geo)
    assert sorted((r.row, r.col) for r in rows) == sorted(CELLS[:2])


def test_a_record_is_parsed_once(spark, tmp_path):
    """What is filtered and counted refers to the parsed columns: their patterns stand in the plan once each, and a file is read by one pass."""
    (tmp_path / "o.csv").write_text("decimalLongitude,decimalLatitude,occurrenceStatus,eventDate\n10.5,49.5,present,2001-02-03\n12.5,47.5,absent,2001\n-40.0,49.5,present,2001\nx,1,present,2001\n")
    raw = spark.read.option("header", True).csv(str(tmp_path / "o.csv"))
    grid = rasters.Grid(spark.createDataFrame([], "row int, col int, predictors array<double>"), ("p",), 60, 60, (1.0, 0.0, 10.0, 0.0, -1.0, 50.0), "EPSG:4326")
    for crs in ("EPSG:4326", "EPSG:3857"):
        parsed = occurrences.parse(raw, occurrences.find_columns(raw.columns, True), grid, crs)[0].filter("inside").select("row", "col", "label")
        assert parsed._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 4  # two coordinates, two spellings of a date
    with caching.scope():
        occ, _, _ = occurrences.read_occurrences(spark, str(tmp_path / "o.csv"), grid, "EPSG:4326")
        assert sorted(map(tuple, occ.select("row", "col", "label").collect())) == [(0, 0, 1), (2, 2, 0)]
        assert "InMemoryRelation" in occ._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" not in occurrences.read_occurrences(spark, str(tmp_path / "o.csv"), grid, "EPSG:4326")[0]._jdf.queryExecution().withCachedData().toString()
