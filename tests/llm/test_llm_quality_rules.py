import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nichesearch.llm import common, quality_rules

from .conftest import row


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = len(covered)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), repeats, len(words) < 20 or 100 * repeats > 30 * len(words)


def test_counts_equal_brute_force(make, corpus, labels):
    block = " ".join(f"w{i}" for i in range(10))
    more = [f"{block} {block}", " ".join([block] * 7) + " tail", "a " * 40, "x #*|\ny\n\nx #*|\n \nx #*|", "  é #1\r\nb\x0bc", "one two three four five six seven eight " * 2]
    rows = corpus + [row(1000 + i, t) for i, t in enumerate(more)]
    got = quality_rules.assess(make(rows), labels).collect()
    key = lambda r: tuple(r)
    want = sorted([(r[0] is None, r[0] or 0, *brute(r[1])) for r in rows])
    assert sorted([(r.doc_id is None, r.doc_id or 0, *key(r)[1:7]) for r in got]) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 150 and not r.base_failed)


def below(k, n):
    """P(Binomial(n, ALPHA) <= k)."""
    alpha = quality_rules.ALPHA
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha)) for i in range(k + 1))


@pytest.mark.parametrize(("k", "n"), [(0, 200), (0, 216), (0, 217), (1, 300), (1, 340), (7, 900), (40, 3000), (41, 3000), (42, 3000), (43, 3000), (300, 20_000), (355, 20_000), (356, 20_000), (357, 20_000), (400, 20_000)])
def test_the_binomial_bound_is_exact(spark, k, n):
    got = spark.range(1).select(quality_rules.admitted(F.lit(k), F.lit(n))).first()[0]
    assert got == (below(k, n) <= quality_rules.EACH and k < n * quality_rules.ALPHA)
    assert below(0, quality_rules.LEAST) <= quality_rules.EACH < below(0, quality_rules.LEAST - 1)


def test_cutoffs_reject_junk_and_bound_good_rejections(spark, make):
    good = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"w{i}###" for i in range(40))
    rows = [row(i, f"{good} n{i}") for i in range(1500)] + [row(2000 + i, f"{junk} n{i}") for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(2000 + i, 0) for i in range(10)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.assess(make(rows), labels).collect()}
    assert sum(not got[i].kept for i in range(1500)) <= quality_rules.ALPHA * 1500
    assert not any(got[2000 + i].kept for i in range(50))


def test_levels_equal_brute_force(spark, make):
    """Joint rejections, fixed sequences and pooled strata, in plain Python."""
    rng = random.Random(3)

    def body(n, bad):
        lines = [" ".join(("Aa" if rng.random() < 0.3 * bad else "w") + f"{rng.randrange(10**6)}" + "#" * (rng.random() < 0.3 * bad) for _ in range(5)) for _ in range(n // 5)]
        return "\n".join(lines + lines[:1] * (rng.random() < 0.1) * 3)

    rows = [row(i, body(n, rng.random() ** 6)) for i, n in enumerate([40] * 300 + [100] * 700 + [400] * 60 + [1500] * 20)]
    rows += rows[400:700] + [row(5001 + 140 * i, rows[500][1]) for i in range(300)]  # repeated rows, and copies under other ids
    labels = spark.createDataFrame([(r[0], int(r[0] % 20 != 0)) for r in rows if r[0] % 7], "doc_id long, quality int")
    measured = common.written(quality_rules.measure(make(rows)), "test-measures")
    got = {r.stratum: r.level for r in quality_rules.thresholds(measured, labels).collect()}
    good = list({r.text_hash: r for r in measured.collect() if r.doc_id % 7 and r.doc_id % 20 and not r.base_failed}.values())
    sizes = Counter(r.stratum for r in good)
    pool = {s: s if n >= quality_rules.LEAST else -1 for s, n in sizes.items()}
    assert -1 in pool.values() and len(set(pool.values())) > 1
    want = {}
    for s in sizes:
        own = [r for r in good if pool[r.stratum] == pool[s]]
        for level in reversed(range(quality_rules.LEVELS)):
            k = sum(any(r[a] > r[b] * quality_rules.GRID[rule][level] for rule, (a, b) in quality_rules.MEASURES.items()) for r in own)
            if k >= len(own) * quality_rules.ALPHA or below(k, len(own)) > quality_rules.EACH:
                break
            want[s] = level
    assert got == want and want
    kept = {r.doc_id: r.kept for r in quality_rules.judge(measured, quality_rules.thresholds(measured, labels)).collect()}
    for r in measured.collect():
        cuts = {rule: c[got[r.stratum]] for rule, c in quality_rules.GRID.items()} if r.stratum in got else {}
        assert kept[r.doc_id] == (not r.base_failed and not any(r[quality_rules.MEASURES[x][0]] > r[quality_rules.MEASURES[x][1]] * c for x, c in cuts.items()))


def test_a_repeated_document_is_one_trial(spark, make):
    good = " ".join(f"word{i}" for i in range(80))
    labels = spark.createDataFrame([(i, 1) for i in range(500)], "doc_id long, quality int")
    for rows in ([row(1, good)] * 400, [row(i, good) for i in range(400)]):
        assert quality_rules.thresholds(quality_rules.measure(make(rows)), labels).count() == 0
    apart = [row(i, f"{good} n{i}") for i in range(400)]
    assert quality_rules.thresholds(quality_rules.measure(make(apart)), labels).count() == 1


def test_without_labels_or_rows_only_base_rules_decide(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.assess(nothing, none).collect() == []
    assert all(r.kept != r.base_failed for r in quality_rules.assess(docs, none).collect())
