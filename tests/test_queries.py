import glob
import os

import duckdb
import pytest

import __spark_entry__
from nichesearch import queries, run_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES | run_queries.queries.ORACLES))
def test_spark_and_sql_agree(spark, con, name):
    found = queries.QUERIES[name](spark, SMALL)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(rel.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in found.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, learner", [("logistic_cv", "logistic"), ("gbm_cv", "gbm")])
def test_registered_learners_run_with_the_defaults(spark, monkeypatch, name, learner):
    given = []
    monkeypatch.setattr(queries.algorithms, "cross_validate", lambda rows, *args: given.append(args) or (rows.withColumn("cv_prediction", rows.label * 1.0),))
    queries.QUERIES[name](spark, SMALL)
    assert [a[:2] for a in given] == [(learner, {})]
