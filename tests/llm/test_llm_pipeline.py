import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from nichesearch.llm import common, queries

from .conftest import row, text

SMALL = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 13)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_files"]


def test_stages_by_hand_give_what_run_gives(spark):
    docs = common.documents(spark, SMALL)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns and docs.count() > 0
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in texts)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in got)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens


def test_stages_take_odd_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() > 0, name
        if name != "token_files":
            assert out.columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles_agree(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_stages_take_empty_tables_null_ids_and_shared_ids(spark, make, nothing, docs):
    rng = random.Random(12)
    a, b, c = (text(rng, "en", 60) for _ in range(3))
    rows = [row(1, a), row(1, b), row(None, a), row(None, c), row(None, c), row(2, None), row(2, ""), row(3, a + " end")]
    own = make(rows)
    near = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, own, SMALL).collect())
    assert near == sorted([("1", a), ("1", b), ("None", c), ("2", "")])
    clean = corpus_pipeline.drop_contaminated(spark, own, SMALL)
    assert clean.count() == len(rows) and clean.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, own, SMALL)
    assert sum(len(r.text.split()) for r in mixed.collect()) == round(1.5 * sum(len((r[1] or "").split()) for r in rows))
    assert corpus_pipeline.write_tokens(spark, own, SMALL).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).collect() == []


def test_what_a_stage_leaves_is_deleted(spark):
    before = {*common.kept()}
    corpus_pipeline.run(spark, SMALL).collect()
    left = [x.rsplit("/", 1)[-1].rsplit("-", 1)[0] for x in common.kept() if x not in before]
    assert sorted(x for x in left if not x.startswith("pipeline-")) == []
