"""The jobs: two runs over growing input, reruns, defined cases, the command line."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, mentions, training_table

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, name string"
SETTINGS = {
    "schema": "doc_id long, text string, source string",
    "doc_id": "doc_id",
    "text": "text",
    "site": "source",
    "obs_date": "cast('2020-01-02' as date)",
    "x": "length(site) + 0.5",
    "y": "-(ascii(site) % 10) - 0.5",
    "crs": "EPSG:4326",
    "grid_crs": "EPSG:4326",
    "transform": [1, 0, 0, 0, -1, 0],
    "names": ["Quercus", "fagus", "FAGUS"],
    "files_per_batch": 1,
}


def texts(spark, folder, rows, part):
    """Adds a file, as a writer of another job would."""
    spark.createDataFrame([(i, t, "x", s, 0, "clash") for i, t, s in rows], TEXTS).coalesce(1).write.mode("append").parquet(str(folder))


def found(spark, out):
    return sorted(map(tuple, mentions.read(spark, str(out)).select("doc_id", "name", "label", "n_mentions", "n_words", "site", "row", "col").collect()), key=repr)


def test_each_run_takes_what_is_new(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    texts(spark, source, [(1, "Quercus, fagus; QUERCUS", "a"), (2, "nothing here", "a"), (3, None, "b")], 0)
    assert mentions.run(spark, str(source), str(out), SETTINGS) == {"read": 3, "written": 2}
    first = found(spark, out)
    assert first == [(1, "fagus", 1, 1, 3, "a", 7, 1), (1, "quercus", 1, 2, 3, "a", 7, 1)]
    assert mentions.run(spark, str(source), str(out), SETTINGS) == {"read": 0, "written": 0}
    assert found(spark, out) == first
    texts(spark, source, [(4, "a fagus_2", "bc"), (1, "Quercus, fagus; QUERCUS", "a")], 1)
    texts(spark, source, [(None, "quercusfagus quercus", None), (6, "", "a")], 2)
    assert mentions.run(spark, str(source), str(out), SETTINGS) == {"read": 4, "written": 6}
    assert sorted(found(spark, out), key=repr) == sorted([*first, *first, (4, "fagus", 1, 1, 2, "bc", 8, 2), (4, "quercus", 0, 0, 2, "bc", 8, 2), (None, "fagus", 0, 0, 2, None, None, None), (None, "quercus", 1, 1, 2, None, None, None)], key=repr)
    assert {p.name for p in (out / "occurrences").iterdir() if p.is_dir() and not p.name.startswith("_")} == {"name=fagus", "name=quercus"}


def test_a_lost_run_is_taken_up(spark, tmp_path):
    """A run that fails after its first batch leaves no row twice and none out."""
    source, out = tmp_path / "in", tmp_path / "out"
    texts(spark, source, [(1, "fagus", "a")], 0)
    mentions.run(spark, str(source), str(out), SETTINGS)
    texts(spark, source, [(2, "fagus", "a")], 1)
    with pytest.raises(Exception, match="division|DIVIDE"):
        mentions.run(spark, str(source), str(out), SETTINGS | {"y": "1 div (doc_id - 2)"})
    assert [r[0] for r in found(spark, out)] == [1, 1]
    mentions.run(spark, str(source), str(out), SETTINGS)
    assert [r[0] for r in found(spark, out)] == [1, 1, 2, 2]


def test_mentions_shuffle_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "fagus", "a")], SETTINGS["schema"])
    plan = mentions.mined(rows, SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sites_are_moved_to_the_grids_system(spark):
    """A site of UTM coordinates falls in the cell that its degrees fall in."""
    rows = spark.createDataFrame([(1, "fagus", "a")], SETTINGS["schema"])
    moved = SETTINGS | {"x": "448251.8", "y": "5411932.7", "crs": "EPSG:32631", "transform": [0.01, 0, 2, 0, -0.01, 49]}
    assert tuple(mentions.mined(rows, moved).select("row", "col").first()) == (14, 29)  # 48.858 N, 2.294 E


SPECIES = {
    "records": {"table": "seen", "species": "s", "row": "r", "col": "c", "date": "d"},
    "layers": {"table": "land", "row": "r", "col": "c", "predictors": {"a": "max(a)", "b": "max(b)"}},
    "block_size": 2, "n_folds": 2, "n_background": 10, "min_presences": 3, "seed": 1,
}


@pytest.fixture
def tables(spark, tmp_path):
    land = [(r, c, float(r), float(c * c) if (r, c) != (3, 3) else None) for r in range(6) for c in range(6)]
    spark.createDataFrame(land, "r int, c int, a double, b double").write.parquet(str(tmp_path / "land.parquet"))
    seen = [("x", r, c, f"2020-01-0{1 + c}") for r in range(4) for c in range(4)] + [("y", 0, 0, "2021-01-01"), ("y", 0, 1, None)] + [("x", 0, 0, "2019-01-01")] * 3
    seen += [(None, 1, 1, None), ("x", None, 1, None), ("z", 50, 50, None), ("z", 51, 50, None), ("z", 52, 50, None)]
    spark.createDataFrame(seen, "s string, r int, c int, d string").write.parquet(str(tmp_path / "seen.parquet"))
    return tmp_path


def test_training_table(spark, tables):
    out = str(tables / "out")
    told = training_table.run(spark, str(tables), out, SPECIES)
    assert told["records"] == 26 and told["placed"] == 24
    rows = training_table.read(spark, out, SPECIES).toPandas()
    own = rows[rows["species"] == "x"].set_index(["row", "col"])
    assert len(own) == 15 and (3, 3) not in own.index and set(own["label"]) == {1}  # one cell lacks a layer
    assert own.loc[(0, 0)]["n_records"] == 4 and str(own.loc[(0, 0)]["first_date"]) == "2019-01-01"
    sd = spark.range(6).agg(F.stddev_pop("id")).first()[0]
    assert own.loc[(2, 1)]["a"] == pytest.approx((2 - 2.5) / sd)
    assert rows.groupby([rows["row"] // 2, rows["col"] // 2])["fold"].nunique().max() == 1
    background = rows[rows["species"] == "background"]
    assert len(background) == 10 and not background.duplicated(["row", "col"]).any() and set(background["label"]) == {0}
    report = {r["species"]: r for r in spark.read.parquet(f"{out}/species").collect()}
    assert set(rows["species"]) == {"x", "background"}
    assert {k: (r["n_records"], r["n_cells"], r["n_lost"], r["used"]) for k, r in report.items()} == {"x": (19, 16, 1, True), "y": (2, 2, 0, False), "z": (3, 3, 3, False)}


def test_a_rerun_gives_the_same(spark, tables):
    out = str(tables / "out")
    told = training_table.run(spark, str(tables), out, SPECIES)
    before = sorted(map(repr, training_table.read(spark, out, SPECIES).collect()))
    assert training_table.run(spark, str(tables), out, SPECIES) == told
    assert sorted(map(repr, training_table.read(spark, out, SPECIES).collect())) == before


def test_empty_tables_and_a_reserved_name(spark, tables, tmp_path):
    none = tmp_path / "none"
    for name in ("land", "seen"):
        spark.read.parquet(str(tables / f"{name}.parquet")).limit(0).write.parquet(str(none / f"{name}.parquet"))
    assert training_table.run(spark, str(none), str(none / "out"), SPECIES) == {"records": 0, "placed": 0, "training": 0, "species": 0}
    with pytest.raises(Exception, match="background"):
        training_table.run(spark, str(tables), str(tmp_path / "o"), SPECIES | {"records": SPECIES["records"] | {"species": "'background'"}})


def test_settings_stay_as_they_were(spark, tables):
    before, known = dict(spark.conf.getAll), spark.catalog.listTables()
    training_table.run(spark, str(tables), str(tables / "out"), SPECIES)
    assert dict(spark.conf.getAll) == before
    assert spark.catalog.listTables() == known


def test_command_line(spark, tmp_path):
    source, out, config = tmp_path / "in", tmp_path / "out", tmp_path / "config.json"
    texts(spark, source, [(1, "fagus", "a")], 0)
    config.write_text(json.dumps(SETTINGS))
    root = Path(common.__file__).parents[1]
    done = subprocess.run([sys.executable, "-m", "jobs.mentions", "--documents", str(source), "--output", str(out), "--config", str(config)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 texts read" in done.stderr and [r[0] for r in found(spark, out)] == [1, 1]
