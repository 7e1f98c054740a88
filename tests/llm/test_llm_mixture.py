import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichesearch.llm import mixture

from .conftest import row


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def words(t):
    return len((t or "").encode().split())


def check(rows, got):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = waterfill(sizes)
    source = {r[0]: r[3] for r in rows}
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_takes_what_is_due_of_each_source(docs, corpus, nothing):
    first = mixture.plan(docs).collect()
    check(corpus, first)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, mixture.plan(docs.repartition(3)).collect()), key=str)
    assert mixture.plan(nothing).collect() == [] and mixture.mix(nothing).collect() == []


def test_deep_trees_and_many_sources(make, monkeypatch):
    rng = random.Random(2)
    rows = [row(i, " ".join(["w"] * rng.randint(0, 30)), source="hot" if i % 3 == 0 else rng.choice([None, "a", "b", "c", "é", "Z", "empty"])) for i in range(3000)]
    rows += [row(9000 + i, "", source="void") for i in range(5)]
    monkeypatch.setattr(mixture, "LEAF_DOCS", 1)
    monkeypatch.setattr(mixture, "BROADCAST_LEAVES", 0)
    check(rows, mixture.plan(make(rows)).collect())


@pytest.mark.parametrize("ids", ["distinct", "null", "equal"])
@pytest.mark.parametrize("text", ["equal", "distinct"])
def test_rows_that_share_an_id_or_a_text(make, ids, text):
    rows = [row({"distinct": 1000 * k + i, "null": None, "equal": 7777}[ids], "w" if text == "equal" else f"w{i}", source=s) for k, s in enumerate("abc") for i in range(1000)]
    got = mixture.plan(make(rows).repartition(5)).collect()
    for s in "abc":
        target = waterfill({x: 1000 for x in "abc"})[s]
        assert any(r.target == pytest.approx(target) for r in got)
    goals = Counter(round(r.target, 3) for r in got)
    taken = Counter()
    for r in got:
        taken[round(r.target, 3)] += r.taken
        assert 0 <= r.taken <= 2 and r.size == 1
    assert all(abs(taken[t] - t) <= 0.5 for t in goals) and len(goals) == 3
    mixed = mixture.mix(make(rows).repartition(3)).collect()
    assert Counter(r.source for r in mixed) == Counter({s: round(waterfill({x: 1000 for x in "abc"})[s]) for s in "abc"})
    if text == "distinct":
        assert max(Counter((r.source, r.text) for r in mixed).values()) <= 2


def test_shards_fill_their_quotas_in_permuted_order(make, monkeypatch):
    rng = random.Random(3)
    rows = [row(i, " ".join(["w"] * rng.randint(0, 30)), source="abc"[i % 3]) for i in range(1500)]
    monkeypatch.setattr(mixture, "LEAF_DOCS", 100)
    blocks, found, passes, _ = mixture.leaves(make(rows))
    placed = mixture._taken(blocks, found, passes).collect()
    groups = {}
    for r in placed:
        groups.setdefault((r.source, r.shard), []).append((r._o, r.size, r.taken - r.whole * r.size))
    assert len({shard for _, shard in groups}) > 4
    shared = Counter(shard for _, shard in groups)
    assert min(shared.values()) == 3  # every shard has blocks of all sources
    for own in groups.values():
        own.sort()
        quota = left = sum(x[2] for x in own)  # brute force: fill the quota in order
        assert 0 <= quota <= sum(x[1] for x in own)
        for _, size, taken in own:
            assert taken == min(size, left)
            left -= taken


def test_the_mixture_holds_the_words_taken(docs):
    plan = mixture.plan(docs).agg(F.sum("taken")).first()[0]
    mixed = mixture.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in mixed.collect()) == plan


@pytest.mark.parametrize("wide", [1e9, 0.5])
@pytest.mark.parametrize(("left", "right", "quota"), [(12, 8, 7), (8, 30, 20), (300, 200, 400), (50, 1000, 40)])
def test_draws_are_hypergeometric(spark, monkeypatch, wide, left, right, quota):
    """Chi-squared against the chances themselves, by inversion and by rejection."""
    monkeypatch.setattr(mixture, "WIDE", wide)
    n = 20_000
    rows = spark.range(n).select("id", F.lit(left).cast("long").alias("left"), F.lit(right).cast("long").alias("right"), F.lit(quota).cast("long").alias("quota"))
    k = Counter(r.k for r in mixture.hypergeometric(rows, [F.col("id")]).select("k").collect())
    chance = {i: math.comb(left, i) * math.comb(right, quota - i) / math.comb(left + right, quota) for i in range(max(0, quota - right), min(left, quota) + 1)}
    assert set(k) <= set(chance)
    cells = [(k[i], n * c) for i, c in chance.items() if n * c >= 5]
    chi = sum((o - e) ** 2 / e for o, e in cells)
    assert chi < len(cells) + 5 * math.sqrt(2 * len(cells)) + 5


def test_draws_of_any_size(spark):
    for scale in (1, 10**3):
        wide = spark.range(2000).select("id", F.lit(6 * 10**9 * scale).alias("left"), F.lit(4 * 10**9 * scale).alias("right"), F.lit(10**9 * scale).alias("quota"))
        k = np.array([r.k for r in mixture.hypergeometric(wide, [F.col("id")]).select("k").collect()], float)
        sd = (10**9 * scale * 0.24 * 0.9) ** 0.5
        z = (k - 6e8 * scale) / sd
        assert abs(z.mean()) < 5 / 2000**0.5 and abs(z.std() - 1) < 0.1 and abs(np.mean(z < -1) - 0.1587) < 0.04
