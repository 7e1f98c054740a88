import random

import numpy as np
import pytest

import corpus_pipeline
from nichesearch.llm import near_copies, simhash

from .conftest import row, text


def test_all_documents_of_which_four_fifths_agree_are_found(spark, make, monkeypatch):
    rng = random.Random(5)

    def altered(words, n):
        own = list(words)
        for i in rng.sample(range(len(own)), n):
            own[i] = f"z{rng.randrange(10**6)}"
        return own

    bodies = [text(rng, "en", n).split() for n in (8, 30, 120, 300, 300, 700)]
    line = text(rng, "en", 12).split()
    texts = [b for body in bodies for b in (body, *(altered(body, n) for n in (1, 1, 2, 3, 4) for _ in range(4)))]
    texts += [altered(bodies[3], 1) for _ in range(40)] + [text(rng, "en", 25).split() + line for _ in range(40)] + [line]
    rows = [row(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (r[1].encode().lower().split() for r in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    for sample in (1, 2, 10**6):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make(rows), "").collect())
        assert kept == sorted(set(root)) and len(kept) < len(rows) - 60


def test_odd_rows(docs, nothing):
    kept = near_copies.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and None in ids
    assert {*range(200)} & {*ids} == {*range(150)} and {200, 220, 242, 243} & {*ids} == set() and {240, 241} <= {*ids}
    assert near_copies.keep_one(nothing).collect() == []


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, simhash.keep_one])
def test_ids_that_are_null_or_repeated_over_texts(make, keep_one):
    rng = random.Random(6)
    a, b, c, d = (text(rng, "en", 60) for _ in range(4))
    rows = [row(1, a), row(2, a), row(2, b), row(2, b), row(3, c), row(3, d), row(None, d), row(None, "only here, " + c[::-1]), row(None, "only here, " + c[::-1]), row(None, None), row(None, "")]
    kept = sorted((str(r.doc_id), r.text or "") for r in keep_one(make(rows)).collect())
    assert kept == sorted([("1", a), ("2", b), ("3", c), ("3", d), ("None", "only here, " + c[::-1]), ("None", "")])


def test_maps_of_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, max(1, n // 5)).astype(np.uint64)]))
        apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(near_copies._parities(a), near_copies._parities(b), strict=True))
        assert len(near_copies._parities(a)) == near_copies.MAP // 64 and apart <= len(np.setxor1d(a, b))


def test_texts_of_the_same_sentences_make_few_pairs(spark, make, monkeypatch):
    """Pairs that are compared as whole sets grow with the documents, not with their square."""
    rng = random.Random(7)
    sentences = [text(rng, "en", 12) + "." for _ in range(60)]
    compared, seen = {}, []
    real = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda docs, prints, pairs: seen.append(pairs.count()) or real(docs, prints, pairs))
    for n in (1000, 2000):
        seen.clear()
        near_copies.keep_one(make([row(i, " ".join(rng.sample(sentences, 5))) for i in range(n)])).count()
        compared[n] = sum(seen)
    assert compared[2000] <= 3 * max(compared[1000], 100) and compared[2000] < 2000
