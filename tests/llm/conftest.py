import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, label string, fp int, words string, part int, held_out string"
LABELS = "doc_id long, quality int, toxic int, score double"
SYLLABLES = {"en": ["the", "and", "ing", "tion", "er", "ou", "sh"], "fr": ["que", "eau", "ment", "oi", "ré", "aux"], "de": ["sch", "ung", "keit", "ein", "ver", "ü"]}


def text(rng, lang, n):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def row(doc_id, body, lang="en", source="a"):
    """A document with extra columns whose names clash with what operators make."""
    return (doc_id, body, lang, source, len(body or ""), 0.5, 1, "x", 7, "w", 3, "h")


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def corpus():
    """Rows: three languages, one hot source, copies, near copies, repeated rows, nulls, empties, a very long text."""
    rng = random.Random(1)
    rows = [row(i, text(rng, ("en", "fr", "de")[i % 3], rng.randint(30, 120)), ("en", "fr", "de")[i % 3], "hot" if i % 2 else f"s{i % 5}") for i in range(150)]
    base = rows[3][1]
    rows += [row(200 + i, base) for i in range(5)]
    rows += [row(220 + i, base + f" extra{i}") for i in range(5)]
    rows += [row(240, text(rng, "en", 20_000)), row(241, None), row(242, ""), row(243, "  \n\t "), row(244, "123 456"), row(245, "one two"), row(246, "ſ İ     x"), row(247, "日本語 text"), row(None, "without an id but with words in it"), row(248, "no lang", None, None)]
    return [*rows, rows[0], rows[0]]


@pytest.fixture(scope="session")
def docs(make, corpus):
    return make(corpus).cache()


@pytest.fixture(scope="session")
def nothing(make):
    return make([])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0), 0.1) for i in range(150)]
    return spark.createDataFrame([*rows, rows[0], (None, 1, 1, 0.0), (5, None, None, 0.0)], LABELS)
