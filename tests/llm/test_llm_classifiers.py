import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from nichesearch.llm import labelled, quality_mil, toxicity

from .conftest import row, text


@pytest.fixture(scope="module")
def learnable(spark, make):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        body, toxic, good = text(rng, "en", rng.randint(20, 80)), int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            body += f" {rng.choice(['moron', 'scumbag'])} " + text(rng, "en", 10)
        if not good:
            body = " | ".join(body.upper().split())
        rows.append(row(i, body))
        marks.append((i, good, toxic, 0.0))
    return make(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, score double"), {m[0]: m for m in marks}


@pytest.mark.parametrize(("module", "place", "threshold"), [(toxicity, 2, 0.5), (quality_mil, 1, 0.7)])
def test_held_out_rows_are_right(learnable, module, place, threshold):
    docs, labels, marks = learnable
    found = module.classify(docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 600 and held
    assert sum(r.predicted == marks[r.doc_id][place] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)


@pytest.mark.parametrize("module", [toxicity, quality_mil])
def test_odd_rows_and_labels(spark, docs, corpus, nothing, labels, module):
    found = module.classify(docs, labels).collect()
    assert len(found) == len(corpus) and all(0 <= r.score <= 1 for r in found)
    same = [r.score for r in found if r.doc_id == 0]
    assert len(same) == 3 and len(set(same)) == 1
    none = labels.filter("false")
    assert all(r.score < 1e-9 for r in module.classify(docs, none).collect())
    one = spark.createDataFrame([(i, 1, 1) for i in range(150)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in module.classify(docs, one).collect())
    assert module.classify(nothing, labels).collect() == []


def test_slopes_of_the_attention_model_are_right():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality_mil.WIDTH)) for n in (1, 3, 2)]
    y = np.array([1.0, 0.0, 1.0])
    epochs, quality_mil.EPOCHS = quality_mil.EPOCHS, 1
    p = {k: v.astype(np.float64) for k, v in quality_mil.train(bags, y).items()}
    quality_mil.EPOCHS = epochs
    x, counts = np.concatenate(bags), np.array([1, 3, 2])

    def loss(q):
        s = quality_mil.forward(q, x, counts)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = quality_mil.backward(p, x, counts, quality_mil.forward(p, x, counts), y, np.ones(3))
    for name in g:
        at = (0,) * p[name].ndim
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[name][at]) < 1e-6


def test_every_passage_is_read():
    a, n = quality_mil.encode(["x" * 5000 + "END", None, ""])
    b, _ = quality_mil.encode(["x" * 5000 + "FIN", None, ""])
    assert list(n) == [10, 1, 1] and not np.array_equal(a[9], b[9]) and not a[10].any()


def test_the_forward_pass_equals_loops_over_passages():
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, quality_mil.WIDTH)).astype(np.float32) for n in (1, 4, 2, 7)]
    p = quality_mil.train(bags, np.array([1.0, 0.0, 1.0, 0.0]))
    got = quality_mil.forward(p, np.concatenate(bags), np.array([1, 4, 2, 7]))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for bag, score in zip(bags, got["score"], strict=True):
        hidden, gates = [], []
        for passage in bag:
            h = np.tanh((passage - p["mean"]) / p["sd"] @ p["w1"] + p["b1"])
            hidden.append(h)
            gates.append(np.exp(sum(np.tanh(h @ p["v"][:, k]) * sigmoid(h @ p["u"][:, k]) * p["w"][k] for k in range(quality_mil.GATE))))
        z = sum(g / sum(gates) * h for g, h in zip(gates, hidden, strict=True))
        assert sigmoid(z @ p["c"] + p["b"][0]) == pytest.approx(score, abs=1e-5)


def test_passages_are_measured_one_by_one():
    texts = ["Aé1 |x." * 200, "plain words here", "", "日本語 " * 300]
    x, counts = quality_mil.encode(texts)
    passages = [b[i : i + quality_mil.PASSAGE] for b in (t.encode() for t in texts) for i in range(0, max(1, len(b)), quality_mil.PASSAGE)]
    assert counts.sum() == len(passages)
    for own, passage in zip(x, passages, strict=True):
        n = max(1, len(passage))
        for k, of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n")):
            assert own[quality_mil.BUCKETS + k] == pytest.approx(sum(c in of for c in passage) / n, abs=1e-6)


def bucket(gram):
    """By Python's integers."""
    x, mix = 0, 0x9E3779B97F4A7C15
    for c in gram:
        x = (x * 0x100000001B3 + ord(c)) % 2**64
    return ((x ^ x >> 31) * mix + toxicity.LENGTHS.index(len(gram)) * mix) % 2**64 >> 64 - toxicity.BITS


def features(text):
    spaced = f" {(text or '').lower()} "
    return {bucket(spaced[i : i + n]) for n in toxicity.LENGTHS for i in range(len(spaced) - n + 1)}


def test_ratios_and_scores_equal_brute_force(spark, make):
    rng = random.Random(6)
    rows = [row(i, text(rng, rng.choice(("en", "fr", "de")), rng.randint(3, 20)) + (" Schwächling日本語" if i % 3 == 0 else "")) for i in range(60)] + [row(60, None), row(61, ""), row(62, "é")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(make(rows), labels)
    own = {r[0]: features(r[1]) for r in rows}
    sums = [sum((Counter(own[i]) for i in range(60) if (i % 3 == 0) == k), Counter()) for k in (False, True)]
    a, b = (toxicity.SMOOTHING * n / 60 for n in (40, 20))
    want = {x: np.log((sums[1][x] + b) / (20 + b) / ((sums[0][x] + a) / (40 + a))) for x in sums[0] | sums[1]}
    assert set(np.flatnonzero(model["ratios"]).tolist()) == {x for x, r in want.items() if r}
    assert all(model["ratios"][x] == pytest.approx(r) for x, r in want.items())
    assert not model["weights"][[x not in want for x in range(1 << toxicity.BITS)]].any()
    weight = dict(enumerate(model["weights"].tolist()))
    for r in toxicity.score(make(rows), model).collect():
        z = model["bias"] + sum(weight.get(b, 0.0) for b in own[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_the_sample_is_bounded_when_an_id_is_repeated(spark, make):
    rows = [row(1, f"text {i % 7}") for i in range(3000)] + [row(i, f"other {i}") for i in range(2, 400)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(400)] * 2, "doc_id long, quality int")
    got = labelled.sample(make(rows), labels, "quality", 10).collect()
    assert len(got) == len({r.doc_id for r in got}) < 50
    every = labelled.sample(make(rows), labels, "quality", 10**6).collect()
    assert sorted(r.doc_id for r in every) == list(range(1, 400)) and all(r.label == r.doc_id % 2 for r in every)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(8)
    texts = [text(rng, "de", 200), None, "x", text(rng, "fr", 40), "", text(rng, "de", 200)]
    monkeypatch.setattr(toxicity, "_AT_ONCE", 64)
    table, found = toxicity._Features(), [[] for _ in range(2 * len(texts))]
    for more in (0, len(texts)):  # two batches of one task
        for i, own in table.of(texts):
            found[more + i] += own.tolist()
    for own, t in zip(found, texts * 2, strict=True):
        assert len(own) == len(set(own)) and set(own) == features(t)


def test_scores_carried_over_portions_equal_whole_bags(monkeypatch):
    rng = np.random.default_rng(9)
    bags = [rng.normal(size=(n, quality_mil.WIDTH)).astype(np.float32) for n in (1, 4, 2, 7)]
    p = quality_mil.train(bags, np.array([1.0, 0.0, 1.0, 0.0]))
    own = random.Random(9)
    texts = [text(own, "en", 900), None, "short", text(own, "fr", 2000), "", text(own, "de", 300), "x" * 2048]
    whole = quality_mil.forward(p, *quality_mil.encode(texts))["score"]
    for at_once in (512, 1024, 4096, 1 << 20):
        monkeypatch.setattr(quality_mil, "_AT_ONCE", at_once)
        assert quality_mil.scores(p, texts) == pytest.approx(whole, abs=1e-5)


def test_equal_passages_share_the_attention():
    rng = np.random.default_rng(12)
    p = quality_mil.train([rng.normal(size=(n, quality_mil.WIDTH)).astype(np.float32) for n in (1, 4)], np.array([1.0, 0.0]))
    passage = ("Some words, " * 50)[: quality_mil.PASSAGE]
    one, three = quality_mil.scores(p, [passage, passage * 3])
    assert one == pytest.approx(three, abs=1e-6)
    weights = quality_mil.forward(p, *quality_mil.encode([passage * 3]))["a"]
    assert weights == pytest.approx([1 / 3] * 3, abs=1e-5)


def test_a_long_text_is_scored_in_little_memory():
    rng = np.random.default_rng(10)
    p = quality_mil.train([rng.normal(size=(n, quality_mil.WIDTH)).astype(np.float32) for n in (1, 4)], np.array([1.0, 0.0]))
    long = "Some words of a text that goes on, " * (1 << 19)  # 18 MB
    tracemalloc.start()
    quality_mil.scores(p, [long, "x"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(long) + (32 << 20)


def test_long_labelled_texts_are_learned_from(spark, make):
    """All bad documents are long, and what makes them bad stands at their end."""
    rng = random.Random(11)
    rows = [row(i, text(rng, "en", 60)) for i in range(60)] + [row(100 + i, text(rng, "en", 5000) + " | # | # | # |" * 1500) for i in range(12)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows], "doc_id long, quality int")
    found = {r.doc_id: r.predicted for r in quality_mil.score(make(rows), quality_mil.fit(make(rows), labels)).collect()}
    assert all(found[r[0]] == int(r[0] < 100) for r in rows)
