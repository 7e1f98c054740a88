"""Artifacts by content, lineage over contents, steps that are read back."""

import hashlib
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichesearch import ArtifactStore, CandidatePlan, MethodologySpec, MethodSpec, RealDataSource, default_registry, execute_run
from nichesearch.plans import digest, executor
from nichesearch.sources import rasters

from .fields import layers, npy, table
from .test_execution import method

PAIRS = [
    ("a int, b double", [(None, 5.0)], [(5, None)]),
    ("a int, b int", [(None, 1), (2, 2)], [(1, None), (2, 2)]),
    ("a array<int>", [([None, 1],)], [([1, None],)]),
    ("a array<int>", [([],)], [(None,)]),
    ("a array<array<int>>", [([[1], [2]],)], [([[1, 2]],)]),
    ("a struct<x:int,y:int>", [((None, 1),)], [((1, None),)]),
    ("a struct<x:int>", [((None,),)], [(None,)]),
    ("a map<string,int>", [({"x": None, "y": 1},)], [({"x": 1, "y": None},)]),
    ("a string", [("null",)], [(None,)]),
    ("a int", [(1,), (1,)], [(1,)]),
]


@pytest.mark.parametrize(("schema", "one", "two"), PAIRS)
def test_tables_that_differ_by_a_null_are_both_kept(spark, tmp_path, schema, one, two):
    store = ArtifactStore(tmp_path, spark)
    a, b = (store.put_table("t", spark.createDataFrame(rows, schema)) for rows in (one, two))
    assert a.digest != b.digest
    for kept, rows in ((a, one), (b, two)):
        assert sorted(map(repr, store.read_table(spark, kept).collect())) == sorted(map(repr, spark.createDataFrame(rows, schema).collect()))


def test_maps_in_any_order_and_vectors_count(spark):
    from pyspark.ml.linalg import Vectors

    one = spark.range(1).select(F.expr("map('x', 1, 'y', 2) AS m"))
    assert digest.digest_table(one) == digest.digest_table(spark.range(1).select(F.expr("map('y', 2, 'x', 1) AS m")))
    tables = [spark.createDataFrame([(Vectors.dense(v),)], ["v"]) for v in ([1.0, 2.0], [2.0, 1.0])]
    assert digest.digest_table(tables[0]) != digest.digest_table(tables[1])


def test_half_a_table_is_written_again(spark, tmp_path):
    store = ArtifactStore(tmp_path, spark)
    df = spark.range(10)
    kept = store.put_table("t", df)
    (tmp_path / kept.path / "_SUCCESS").unlink()
    for f in (tmp_path / kept.path).glob("part-*"):
        f.unlink()
    assert store.put_table("t", df) == kept and store.read_table(spark, kept).count() == 10


def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    data = bytes(np.random.default_rng(0).integers(0, 256, 10_000, np.uint8))
    for name, x in (("a", data), ("b", data[:-1]), ("none", b"")):
        (tmp_path / name).write_bytes(x)
    monkeypatch.setattr(digest, "PIECE", 700)
    monkeypatch.setattr(digest, "LEAF", 3000)
    plain = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in digest.digest_files(spark, str(tmp_path)).collect()}
    assert plain == {n: hashlib.sha256(x).hexdigest() for n, x in (("a", data), ("b", data[:-1]))}
    tree = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in digest.tree_digests(spark, str(tmp_path)).collect()}
    leaves = "".join(hashlib.sha256(data[i : i + 3000]).hexdigest() for i in range(0, 10_000, 3000))
    assert tree["a"] == hashlib.sha256(leaves.encode()).hexdigest() and len(set(tree.values())) == 2


@pytest.fixture
def source(spark, tmp_path):
    paths = npy(tmp_path, layers(0.05))
    rng = np.random.default_rng(1)
    rows = sorted({(int(r), int(c), int(r < 30)) for r, c in rng.integers(0, 60, (200, 2))})
    return RealDataSource(table(tmp_path / "o.csv", ("row", "col", "presence"), rows), paths, "presence_absence")


def steps(spark, store, run):
    found = executor.lineage(spark, store).filter(F.col("run_id") == run).orderBy("candidate_id", "place").collect()
    return {(r.candidate_id, r.stage): r for r in found}


def test_what_did_not_change_is_read_back(spark, tmp_path, source):
    store = ArtifactStore(tmp_path / "store", spark)
    run = lambda name, *plans: execute_run(spark, list(plans), default_registry(), store, run_id=name, resume=True)
    first = run("one", CandidatePlan("a", source, method()))
    assert not first.candidates[0].failed and not any(r.reused for r in steps(spark, store, "one").values())

    again = run("two", CandidatePlan("a", source, method()))
    assert all(r.reused for r in steps(spark, store, "two").values())
    assert again.candidates[0].metrics == first.candidates[0].metrics and again.manifest.data_digest == first.manifest.data_digest
    assert [s.artifacts for s in again.candidates[0].step_records] == [s.artifacts for s in first.candidates[0].step_records]

    other = MethodologySpec(MethodSpec("drop_duplicate_cells"), MethodSpec("full_extent"), MethodSpec("standardize"), MethodSpec("random_kfold", {"n_folds": 3}), MethodSpec("logistic"))
    changed = run("three", CandidatePlan("b", source, other))
    assert not changed.candidates[0].failed
    assert {s: r.reused for (_, s), r in steps(spark, store, "three").items()} == {"data_source": True, "cleaning": True, "accessible_area": True, "predictors": True, "split": False, "algorithm": False}

    with open(source.occurrences_path, "a") as f:
        f.write("59,59,1\r\n")
    run("four", CandidatePlan("a", source, method()))
    one, four = steps(spark, store, "one"), steps(spark, store, "four")
    assert not any(r.reused for r in four.values())
    assert all(one[k].inputs_digest != four[k].inputs_digest for k in one)


def test_equal_contents_elsewhere_are_the_same(spark, tmp_path, source):
    store = ArtifactStore(tmp_path / "store", spark)
    moved = tmp_path / "moved"
    moved.mkdir()
    paths = [str(shutil.copy(p, moved)) for p in source.predictor_paths]
    twin = source.replace(occurrences_path=str(shutil.copy(source.occurrences_path, moved / "other.csv")), predictor_paths=tuple(paths))
    execute_run(spark, [CandidatePlan("a", source, method())], default_registry(), store, run_id="one", resume=True)
    execute_run(spark, [CandidatePlan("a", twin, method())], default_registry(), store, run_id="two", resume=True)
    assert all(r.reused for r in steps(spark, store, "two").values())


def test_a_cleared_artifact_is_made_again(spark, tmp_path, source):
    store = ArtifactStore(tmp_path / "store", spark)
    run = lambda name: execute_run(spark, [CandidatePlan("a", source, method())], default_registry(), store, run_id=name, resume=True)
    first = run("one")
    shutil.rmtree(tmp_path / "store" / first.candidates[0].step_records[-1].artifacts[0].path)
    second = run("two")
    assert [r.reused for r in steps(spark, store, "two").values()] == [True] * 5 + [False]
    assert second.candidates[0].metrics == first.candidates[0].metrics


def test_without_resume_all_steps_run(spark, tmp_path, source):
    store = ArtifactStore(tmp_path / "store", spark)
    for name in ("one", "two"):
        execute_run(spark, [CandidatePlan("a", source, method())], default_registry(), store, run_id=name)
    one, two = steps(spark, store, "one"), steps(spark, store, "two")
    assert not any(r.reused for r in two.values()) and all(one[k].step_digest == two[k].step_digest for k in one)


# --- layers by windows


def stacked(grid):
    out = np.full((len(grid.names), grid.height, grid.width), -1.0)
    for r in grid.cells.collect():
        out[:, r.row, r.col] = [np.nan if v is None else v for v in r.predictors]
    return out


def test_windows_of_unlike_layers(spark, tmp_path, monkeypatch):
    from .fields import tiff

    values = {k: v[:, :53] for k, v in layers(0.1).items()}
    values["temp"][7, 9] = np.nan
    want = np.stack([*values.values(), values["temp"]])
    paths = [tiff(tmp_path / "a.tif", values["temp"], tile=16), tiff(tmp_path / "b.tif", values["precip"], deflate=True), tiff(tmp_path / "c.tif", values["temp"], tile=32, packed="lzw")]
    flat = [*npy(tmp_path, values), *npy(tmp_path, {"f": np.asfortranarray(values["temp"])})]
    for window in (1, 100, 1 << 18):
        monkeypatch.setattr(rasters, "WINDOW", window)
        monkeypatch.setattr(rasters, "BATCH", 37)
        for files in (paths, flat, paths[:1] + paths[2:]):
            grid = rasters.read_predictors(spark, files)
            own = want if len(files) == 3 else want[[0, 2]]
            assert np.array_equal(stacked(grid), own, equal_nan=True)
            part = rasters.read_predictors(spark, files, (5, 20, 30, 33))
            assert part.cells.count() == 64
            assert np.array_equal(stacked(part)[:, 5:21, 30:34], own[:, 5:21, 30:34], equal_nan=True)
            if window == 1 and files is not flat:
                assert grid.cells.rdd.getNumPartitions() > 1 and "Exchange" not in grid.cells._jdf.queryExecution().executedPlan().toString()
    assert rasters.read_predictors(spark, paths, (50, 40, 0, 9)).cells.count() == 0


def test_a_layer_of_many_gigabytes_is_many_tasks(spark, tmp_path):
    """A BigTIFF of 40,000 x 40,000 doubles in tiles of 512: a hole in the disk but for its header and a tile."""
    import struct

    side, tile = 40_000, 512
    across = -(-side // tile)
    size = tile * tile * 8
    first = 16 + 1024
    places = [first + i * size for i in range(across * across)]
    lists = first + len(places) * size
    tags = [(256, 4, side), (257, 4, side), (258, 3, 64), (259, 3, 1), (277, 3, 1), (322, 3, tile), (323, 3, tile), (324, 16, lists), (325, 16, lists + 8 * len(places)), (339, 3, 3)]
    path = tmp_path / "large.tif"
    with open(path, "wb") as f:
        f.write(b"II+\0\x08\0\0\0" + struct.pack("<Q", 16) + struct.pack("<Q", len(tags)))
        for tag, kind, v in tags:
            f.write(struct.pack("<HHQQ", tag, kind, len(places) if kind == 16 else 1, v))
        f.seek(places[40 * across + 39])
        f.write(np.arange(tile * tile, dtype="<f8").tobytes())
        f.seek(lists)
        f.write(struct.pack(f"<{len(places)}Q", *places) + struct.pack(f"<{len(places)}Q", *[size] * len(places)))
    assert path.stat().st_size > 10 << 30
    grid = rasters.read_predictors(spark, [str(path)])
    assert grid.shape == (side, side) and grid.cells.rdd.getNumPartitions() == across * across
    part = rasters.read_predictors(spark, [str(path)], (40 * tile + 3, 40 * tile + 4, 39 * tile - 2, 39 * tile + 1)).cells
    assert part.rdd.getNumPartitions() == 2
    assert {(r.row - 40 * tile, r.col - 39 * tile): r.predictors[0] for r in part.collect()} == {(y, x): float(y * tile + x) if x >= 0 else 0.0 for y in (3, 4) for x in (-2, -1, 0, 1)}
