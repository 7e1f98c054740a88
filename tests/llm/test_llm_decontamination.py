import math
import random
import re
from collections import Counter

import pytest

from nichesearch.llm import decontamination

from .conftest import row, text

ITEMS = "item_id long, text string, score double"


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    return [(i, text(rng, "en", rng.randint(20, 60)) + f" unique{i} mark{i}. The answer{i} is {i} of course{i} and so{i}.", 0.0) for i in range(40)] + [(50, text(rng, "fr", 400), 0.0), (51, None, 0.0), (52, "too short", 0.0), (None, "an item without id that is long enough to count", 0.0)]


def test_planted_items_are_found_and_clean_documents_are_not(spark, make, corpus, items):
    body = corpus[0][1]
    planted = [row(1000 + i, f"{body} {items[i][1].upper()}\n{body}") for i in range(40)]
    planted += [row(2000, items[40][1].replace(" ", "\n")), row(2001, " ".join([body] * 400) + items[7][1]), row(2002, items[3][1] + " " + items[4][1])]
    half = [row(3000, " ".join(items[5][1].split()[:12]))]
    found = decontamination.search(make(corpus + planted + half), spark.createDataFrame(items, ITEMS)).collect()
    want = {(1000 + i, i) for i in range(40)} | {(2000, 50), (2001, 7), (2002, 3), (2002, 4)}
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.score >= 0.5 and r.question_overlap >= 0.5 for r in found)


def brute_force(texts, items):
    """Every entry scored in every window with BM25 as it is defined, then the overlaps of the items retrieved."""
    split = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).split()
    items = sorted({(i, t) for i, t, _ in items if t}, key=repr)
    entries = []
    for item, text in items:
        own = split(text)
        n = -(-len(own) // 128) if len(own) >= 8 else 0
        entries += [(item, text, Counter(own[len(own) * k // n : len(own) * (k + 1) // n])) for k in range(n)]
    df = Counter(t for *_, e in entries for t in e)
    mean = sum(sum(e.values()) for *_, e in entries) / max(1, len(entries))

    def part(e, t):
        return math.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * e[t] * 2.2 / (e[t] + 1.2 * (0.25 + 0.75 * sum(e.values()) / mean))

    grams = lambda own, n: {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
    out = {}
    for i, text in enumerate(texts):
        own = split(text)
        windows = [own[a : a + 256] for a in range(0, len(own), 128)]
        for item, stated in items:
            short = split(stated)
            if len(short) < 8:
                if short and any(own[a : a + len(short)] == short for a in range(len(own))):
                    out[i, item] = (1.0, 1.0, 1.0)
                continue
            scores = [(sum(part(e, t) for t in set(w) & set(e)) / sum(part(e, t) for t in e), k) for x, y, e in entries if (x, y) == (item, stated) for k, w in enumerate(windows)]
            hit = [(x, k) for x, k in scores if x >= 0.5]
            if not hit:
                continue
            cut = decontamination.question_words(stated)
            shares = []
            for side in (short[:cut], short[cut:]):
                n = min(5, len(side))
                there = set().union(*(grams(windows[k], n) for _, k in hit))
                shares.append(len(grams(side, n) & there) / len(grams(side, n)))
            if min(shares) >= 0.5:
                out[i, item] = max(out.get((i, item), (0, 0, 0)), (max(hit)[0], *shares))
    return out


def test_search_equals_brute_force(spark, make, corpus, monkeypatch):
    rng = random.Random(8)
    items = [(n, text(rng, "fr", n), 0.0) for n in (1, 2, 3, 5, 7, 8, 9, 12, 20, 50, 100, 127, 128, 129, 200, 257, 300, 400) for _ in range(1)]
    items += [(1000 + n, text(rng, "en", n) + "\n" + text(rng, "de", 9), 0.0) for n in (10, 60, 150, 200, 390)]
    items += [(2000, items[9][1], 0.0), items[9], (2001, "the the the the the the the the the", 0.0), (None, items[3][1], 0.0), (2002, None, 0.0), (2003, "?!", 0.0)]
    known = [t for _, t, _ in items if t]
    texts = [f"{text(rng, 'de', rng.randint(0, 300))} {t} {text(rng, 'en', rng.randint(0, 200))}" for t in known]
    texts += [" ".join(w if rng.random() > 0.12 else "zz" for w in t.split()) for t in known]
    texts += [" ".join(t.split()[: len(t.split()) * 2 // 3]) for t in known] + [" ".join(t.split()[len(t.split()) // 3 :]) for t in known]
    texts += [r[1] for r in corpus if len(r[1] or "") < 5000] + [f"{known[-8]} {' '.join(['the'] * 300)} {known[-9]}", None, ""]
    want = brute_force(texts, items)
    assert {(i, item) for i, (item, t, _) in enumerate(items) if t and t != "?!"} <= {*want}  # recall of planted items is 1
    for chars in (decontamination.SHARD_CHARS, 1500):
        monkeypatch.setattr(decontamination, "SHARD_CHARS", chars)
        found = decontamination.search(make([row(i, t) for i, t in enumerate(texts)]), spark.createDataFrame(items, ITEMS)).collect()
        got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in found}
        assert len(got) == len(found) and set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_items_without_an_id_are_searched_for(spark, make):
    rng = random.Random(10)
    one, two = (text(rng, "en", 40) for _ in range(2))
    bench = spark.createDataFrame([(None, one, 0.0), (None, two, 0.0), (None, one, 0.0), (None, "just four short words", 0.0), (7, one, 0.0)], ITEMS)
    docs = make([row(1, f"{one} and {two}"), row(2, "so just four short words, here"), row(3, text(rng, "de", 50))])
    found = sorted(((r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect()), key=repr)
    assert found == [(1, 7), (1, None), (1, None), (2, None)]
    assert [r.doc_id for r in decontamination.keep_clean(docs, bench).collect()] == [3]


def test_windows_and_items_of_equal_score(spark, make):
    """A text that holds an item twice has one row; two items of one text have equal rows."""
    rng = random.Random(13)
    item, rest = text(rng, "en", 40), text(rng, "de", 300)
    bench = spark.createDataFrame([(1, item, 0.0), (2, item, 0.0)], ITEMS)
    found = decontamination.search(make([row(1, f"{item} {rest} {item}"), row(2, item)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert len({(r.score, r.question_overlap, r.answer_overlap) for r in found}) == 1


def test_a_question_without_its_answer_is_clean(spark, make):
    rng = random.Random(9)
    question, answer = text(rng, "en", 200), text(rng, "en", 6)
    bench = spark.createDataFrame([(1, f"{question}\n{answer}", 0.0)], ITEMS)
    docs = make([row(1, question), row(2, answer), row(3, f"{question} {answer}"), row(4, f"{answer} and much later {text(rng, 'en', 400)}")])
    assert [(r.doc_id, r.answer_overlap) for r in decontamination.search(docs, bench).collect()] == [(3, 1.0)]


def test_several_shards_give_the_same(spark, make, items, monkeypatch):
    docs = make([row(i, items[i][1]) for i in range(10)])
    bench = spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(decontamination, "SHARD_CHARS", 2000)
    assert {(r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect()} == {(i, i) for i in range(10)}
    assert decontamination.keep_clean(docs, bench).count() == 0


def test_empty_tables(spark, docs, nothing, items):
    none = spark.createDataFrame([], ITEMS)
    assert decontamination.search(docs, none).collect() == []
    assert decontamination.search(nothing, spark.createDataFrame(items, ITEMS)).collect() == []
    assert decontamination.keep_clean(docs, none).count() == docs.count()


def test_short_items_are_found_as_exact_sequences(spark, make, items):
    bench = spark.createDataFrame([*items, (60, "Who wrote it? Ann Lee.", 0.0), (61, "who wrote it ann lee", 0.0), (62, "so", 0.0), (63, " ?! ", 0.0)], ITEMS)
    texts = {1: "they ask: who wrote it -- Ann Lee, of course", 2: "who wrote it? Ann B. Lee", 3: "wrote it ann lee who", 4: "so it goes", 5: "Who wrote it? Ann Leeds", 6: "", 7: f"{items[3][1]} Who wrote it? Ann Lee."}
    docs = make([row(i, t) for i, t in texts.items()])
    found = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontamination.search(docs, bench).collect()}
    assert set(found) == {(1, 60), (1, 61), (4, 62), (7, 3), (7, 60), (7, 61)}
    assert found[1, 60] == (1.0, 1.0, 1.0)
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, bench).collect()) == [2, 3, 5, 6]
