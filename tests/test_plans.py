"""Physical plans: what is read, and what must not be there."""

import re

import pytest

from nichesearch import queries
from nichesearch.operators import selection, stages

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_duplicates", "spatial_block_folds", "random_kfold", "standardise_predictors", "profile_volume", "auc_per_fold"])
def test_scans_read_only_what_is_used(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(queries.QUERIES[name](spark, SMALL))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = set(re.findall(r"l_\w+(?=:)", " ".join(re.findall(r"ReadSchema: struct<[^>]*>", text))))
    assert read and not read & {"l_tax", "l_linestatus", "l_comment"}
    assert "CartesianProduct" not in text and "Python" not in text


def test_ranks_do_not_gather_rows(spark):
    text = plan(queries.random_kfold(spark, SMALL))
    windows = re.findall(r"Exchange SinglePartition", text)
    assert len(windows) <= 1  # the counts of the hash's buckets
    assert "hashpartitioning(_bucket" in text


@pytest.mark.parametrize("name", ["profile_volume", "profile_temporal", "cv_auc_summary"])
def test_aggregations_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(queries.QUERIES[name](spark, SMALL))


def test_no_window_orders_all_scores(spark):
    """Places among scores come from ranges of them, with and without groups."""
    scored = queries._scored(spark, SMALL)
    for text in (plan(stages.auc(scored)), plan(stages.auc(scored, ["fold"])), plan(selection.weighted_auc(scored.withColumn("weight", scored.label * 1.0 + 1)))):
        specs = re.findall(r"windowspecdefinition\(([^)]*)\)", text)
        assert any("_range" in s and "score" in s for s in specs)
        assert all("_range" in s for s in specs if "score" in s)
