import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nichesearch.llm import common, simhash

from .conftest import row, text


def naive(body):
    words = [w for w in (body or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [naive(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = root(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted((str(r[0]), format(p, "016x"), str(least.get(root(i)))) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))


def test_equals_brute_force(make, corpus):
    rng = random.Random(9)
    base = text(rng, "en", 400).split()
    near = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        near.append(row(500 + i, " ".join(own)))
    rows = corpus + near
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.query(make(rows)).collect())
    assert got == brute(rows)


def test_links_are_complete_and_large_buckets_are_dealt_anew(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")

    def groups(links):
        parent = {v: v for v in signed}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in links:
            parent[root(a)] = root(b)
        return {frozenset(v for v in signed if root(v) == r) for r in {root(v) for v in signed}}

    x = np.array(signed).view(np.uint64)
    every = [(signed[i], signed[j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)]
    want = groups(every)
    for limit in (2048, 8):
        monkeypatch.setattr(simhash, "LIMIT", limit)
        assert groups([tuple(r) for r in simhash.links(df).collect()]) == want


def test_stars_on_a_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (100, 102)], "u long, v long")
    assert {(r.node, r.root) for r in simhash.stars(edges).collect()} == {(i, 0) for i in range(1, n + 1)} | {(101, 100), (102, 100)}


def test_one_document_of_each_group_stays(docs, corpus, nothing):
    found = {r[0]: r[2] for r in brute(corpus)}
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(map(str, ids)) == sorted({c for d, c in found.items() if d != "None"} | {"None"})
    assert simhash.keep_one(nothing).collect() == [] and simhash.query(nothing).collect() == []


def test_a_hubs_rows_are_split(spark):
    """Both sides of a star's join are written, so that Spark's skew rule applies to it."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pairs = spark.range(1, 200_000).selectExpr("if(id % 2 = 0, 0, id * 7919) AS u", "id AS v")
        both = common.written(pairs.unionByName(pairs.selectExpr("v AS u", "u AS v")), "test-both")
        least = common.written(both.groupBy("u").agg(F.min("v").alias("m")), "test-least")
        found = simhash._hung(both, least)
        assert found.write.format("noop").mode("overwrite").save() is None
        joined = both.join(least, "u")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
