"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Test items, cut into entries of at most ``ENTRY`` words, are indexed; every window of
``2 * ENTRY`` words of every training text, at steps of ``ENTRY``, is a query, so that each
entry a text contains lies wholly in some window. Scores are divided by the entry's score
for itself; all entries of at least ``RETRIEVE`` are retrieved. An item is verified in the
union of the windows for which any of its entries was retrieved: half of the five-word
shingles of its question and half of those of its answer must occur there. Items of fewer
than ``LEAST`` words are looked up as they are: the whole item must occur as a sequence of
words, and its score and overlaps are 1.

The search is exact. In each entry the commonest terms that together stay below
``COMMON`` are set apart, as they cannot lift a score over the threshold alone. The other
postings, by blocks of entries with their greatest impact, give a window an upper bound for
each block; blocks whose bound is below the threshold are skipped whole, the rest are scored
in full. As the threshold is fixed, there is no list of the best to raise it, and no pivot to move. Postings are looked up for all windows of a batch at once.

Frequencies of terms and the mean length are counted over the entries of all items before
anything is indexed. The items are then read in shards of at most ``SHARD_CHARS`` characters,
each an index that is broadcast: the size of what the driver and a worker hold is bounded,
more items mean more passes, and how they fall into shards changes no score.

Words are lower-cased, with ASCII punctuation taken for space. The answer is what follows
an item's last line feed, else its last sentence, else its last third. Defined cases: items
with a null text or without words are not searched for; each item without an id is one of its own, with a null item_id; texts without words match nothing, and
null texts are such; repeated documents each get their rows; an item that is repeated with its
id counts once, equal texts under two ids each match; of windows of equal score any gives the
same row; texts of any length are searched whole; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ENTRY, LEAST, SHINGLE, BLOCK = 128, 8, 5, 4
RETRIEVE, COMMON, PART = 0.5, 0.35, 0.5
K1, B = 1.2, 0.75
SHARD_CHARS = 8 << 20
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_MARKS = bytes(32 if (33 <= i < 127 and not chr(i).isalnum()) else i for i in range(256))
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_MARKS).split()


def question_words(text: str) -> int:
    """How many of an item's words are its question."""
    text = text.rstrip()
    at = text.rfind("\n") + 1 or max((m.end() for m in _SENTENCE.finditer(text)), default=0)
    n, total = len(words(text[:at])), len(words(text))
    return n if 0 < n < total else total - max(1, total // 3)


def shingles(own: list[bytes], n: int = SHINGLE) -> set[int]:
    """Hashes of the sequences of n words."""
    return set(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(own[i:] for i in range(n)), strict=False))))


def entries(own: list[bytes]) -> Iterator[list[bytes]]:
    """An item's words, cut evenly; none of an item that is looked up as it is."""
    n = -(-len(own) // ENTRY) if len(own) >= LEAST else 0
    for k in range(n):
        yield own[len(own) * k // n : len(own) * (k + 1) // n]


class Statistics:
    """Entries with a term, by term; the number of entries and their mean length."""

    def __init__(self, df: dict[bytes, int], n: int, mean: float):
        self.df, self.n, self.mean = df, n, mean


class Index:
    """Postings of a shard's entries, whole and by block. Every (item_id, text) stands for an item of its own."""

    def __init__(self, items: list[tuple[int | None, str]], over: Statistics):
        self.items: list[tuple[tuple[bool, int], int, np.ndarray, int, np.ndarray]] = []  # key; words of a shingle, and shingles, of the question and the answer
        self.short: dict[int, dict[tuple[bytes, ...], list[tuple[bool, int]]]] = {}  # by number of words: items of a sequence
        self.terms: dict[bytes, int] = {}
        owner: list[int] = []  # the item of each entry
        found: list[tuple[int, int, int]] = []  # term, entry, occurrences
        for place, (item_id, text) in enumerate(items):
            item = (item_id is None, place if item_id is None else item_id)  # a key for each item, one for rows of one id
            own, cut = words(text), question_words(text or "")
            if len(own) < LEAST:
                if own:
                    self.short.setdefault(len(own), {}).setdefault(tuple(own), []).append(item)
                continue
            for words_of_entry in entries(own):
                counts: dict[int, int] = {}
                for w in words_of_entry:
                    t = self.terms.setdefault(w, len(self.terms))
                    counts[t] = counts.get(t, 0) + 1
                found += [(t, len(owner), n) for t, n in counts.items()]
                owner.append(len(self.items))
            sides = [(n := min(SHINGLE, len(part)), np.fromiter(shingles(part, n), np.uint64)) for part in (own[:cut], own[cut:])]
            self.items.append((item, *sides[0], *sides[1]))
        self.owner = np.array(owner, np.int64)
        term, entry, count = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True)) if found else np.zeros((3, 0), np.int64)
        n = len(owner)
        df = np.array([over.df[t] for t in self.terms], np.int64)
        length = np.bincount(entry, count, n)
        impact = np.log(1 + (over.n - df[term] + 0.5) / (df[term] + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * length[entry] / max(1, over.mean)))
        impact = impact / np.bincount(entry, impact, n)[entry]  # an entry's score for itself is 1
        by = np.lexsort((term, -df[term], entry))  # commonest first
        sums = np.cumsum(impact[by])
        starts = np.searchsorted(entry[by], np.arange(n))
        before = np.concatenate([[0.0], sums])[starts]
        common_posting = np.zeros(len(term), bool)
        common_posting[by] = sums - before[entry[by]] < COMMON
        self.rest = np.bincount(entry, impact * common_posting, n)  # what common terms can add
        blocks = -(-n // BLOCK)
        keys, place = np.unique((term * max(1, blocks) + entry // BLOCK)[~common_posting], return_inverse=True)
        self.peak = np.zeros(len(keys))
        np.maximum.at(self.peak, place, impact[~common_posting])
        self.block = keys % max(1, blocks)
        self.block_first = np.searchsorted(keys // max(1, blocks), np.arange(len(self.terms) + 1))
        self.block_rest = np.zeros(blocks)
        np.maximum.at(self.block_rest, np.arange(n) // BLOCK, self.rest)
        self.blocks = blocks
        by = np.argsort(entry // BLOCK, kind="stable")  # all postings, block by block
        self.term, self.place, self.impact = term[by], entry[by] % BLOCK, impact[by]
        self.first = np.searchsorted(entry[by] // BLOCK, np.arange(blocks + 1))
        self.there = np.zeros(len(self.terms), bool)

    def windows(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(step, block) pairs whose upper bound reaches the threshold: the window is that step and the next.

        terms: of all words of all texts in turn, -1 for unknown ones; sizes: words of each text.
        """
        steps = -(-sizes // ENTRY)
        step = np.repeat(np.cumsum(steps) - steps, sizes) + (np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // ENTRY
        at = np.flatnonzero(terms >= 0)
        at = at[self.block_first[terms[at] + 1] > self.block_first[terms[at]]]
        n = len(self.terms)
        pairs = np.unique(step[at] * n + terms[at])
        step, term = pairs // n, pairs % n
        many = self.block_first[term + 1] - self.block_first[term]
        posting = np.repeat(self.block_first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        wide = self.blocks + 1
        keys, place = np.unique(np.repeat(step, many) * wide + self.block[posting], return_inverse=True)
        peak = np.bincount(place, self.peak[posting], len(keys))
        first = np.unique(np.concatenate([keys, keys - wide]))
        first = first[first >= 0]
        bound = self.block_rest[first % wide]
        for shift in (0, wide):
            spot = np.minimum(np.searchsorted(keys, first + shift), max(0, len(keys) - 1))
            bound = bound + np.where(keys[spot] == first + shift, peak[spot], 0) if len(keys) else bound
        first = first[bound >= RETRIEVE - 1e-9]
        return first // wide, first % wide

    def retrieve(self, window: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Entries of a block that reach the threshold for a window's distinct terms, with scores."""
        own = slice(self.first[block], self.first[block + 1])
        self.there[window] = True
        hit = self.there[self.term[own]]
        self.there[window] = False
        scores = np.bincount(self.place[own][hit], self.impact[own][hit], BLOCK)
        return [(block * BLOCK + int(k), float(scores[k])) for k in np.flatnonzero(scores >= RETRIEVE)]

    def verify(self, item: int, windows: list[list[bytes]]) -> tuple[float, float] | None:
        """Shares of the item's question and answer in the windows together, if they suffice."""
        _, *sides = self.items[item]
        shares = []
        for n, own in (sides[:2], sides[2:]):
            there = set().union(*(shingles(w, n) for w in windows))
            shares.append(sum(x in there for x in own.tolist()) / len(own))
        return tuple(shares) if min(shares) >= PART else None

    def search(self, texts: list[str | None]) -> list[tuple[int, int | None, float, float, float]]:
        """(text, item id, score, question overlap, answer overlap): by the best entry of each item in each text."""
        split = list(map(words, texts))
        best = {(i, item): (1.0, 1.0, 1.0) for i, own in enumerate(split) for item in self.quoted(own)}
        for key, found in self.ranked(split).items():
            best[key] = max(best.get(key, found), found)
        return [(i, None if nameless else item, *v) for (i, (nameless, item)), v in sorted(best.items())]

    def quoted(self, own: list[bytes]) -> Iterator[tuple[bool, int]]:
        """The short items that a text holds."""
        for n, items in self.short.items():
            for found in items.keys() & set(zip(*(own[i:] for i in range(n)), strict=False)):
                yield from items[found]

    def ranked(self, split: list[list[bytes]]) -> dict[tuple[int, tuple[bool, int]], tuple[float, float, float]]:
        """The longer items in each text, as in ``search``."""
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        terms = np.fromiter(map(self.terms.get, chain.from_iterable(split), repeat(-1)), np.int64, int(sizes.sum()))
        if not len(self.owner) or not len(terms):
            return {}
        steps = -(-sizes // ENTRY)
        last = np.cumsum(steps)
        begin = np.cumsum(sizes) - sizes
        hits: dict[tuple[int, int], list] = {}  # text, item: best score, then the begins of windows
        seen, window = -1, np.zeros(0, np.int64)
        for step, block in zip(*(x.tolist() for x in self.windows(terms, sizes)), strict=True):
            i = int(np.searchsorted(last, step, side="right"))
            a = (step - int(last[i] - steps[i])) * ENTRY
            if step != seen:
                own = terms[begin[i] + a : begin[i] + min(a + 2 * ENTRY, int(sizes[i]))]
                seen, window = step, np.unique(own[own >= 0])
            for entry, score in self.retrieve(window, block):
                hit = hits.setdefault((i, int(self.owner[entry])), [0.0])
                hit[0] = max(hit[0], score)
                hit.append(a)
        best: dict[tuple[int, tuple[bool, int]], tuple[float, float, float]] = {}
        for (i, item), (score, *begins) in hits.items():
            if shares := self.verify(item, [split[i][a : a + 2 * ENTRY] for a in sorted(set(begins))]):
                key = (i, self.items[item][0])
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *shares))
        return best


def statistics(items: DataFrame) -> DataFrame:
    """(term, n, length): entries with each term; under a null term the number of entries and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df: Counter[bytes] = Counter()
            n = length = 0
            for text in batch.column("text").to_pylist():
                for own in entries(words(text)):
                    df.update(set(own))
                    n, length = n + 1, length + len(own)
            rows = [*((t.decode(), c, 0) for t, c in df.items()), (None, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "n", "length"])

    return items.select("text").mapInArrow(run, "term string, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def indexes(items: DataFrame) -> Iterator[Broadcast]:
    """An index for each shard of ``items`` (item_id, text), in the order of their ids; the driver holds one at a time."""
    spark = items.sparkSession
    common.small_batches(spark)
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    counted = common.written(statistics(own), "benchmark-terms")
    total = counted.filter("term is null").first()
    n, mean = (total["n"], total["length"] / max(1, total["n"])) if total else (0, 0.0)

    def index(shard: list[tuple[int | None, str]]) -> Broadcast:
        terms = spark.createDataFrame([(t.decode(),) for t in {w for _, text in shard for w in words(text)}], "term string")
        df = {r["term"].encode(): r["n"] for r in counted.join(F.broadcast(terms), "term").select("term", "n").toLocalIterator()}  # at most the words of a shard
        return spark.sparkContext.broadcast(Index(shard, Statistics(df, n, mean)))

    held: list[tuple[int | None, str]] = []
    size = 0
    for r in own.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r["text"]) > SHARD_CHARS:
            yield index(held)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held and any(words(text) for _, text in held):
        yield index(held)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each contaminated document and item; map-only over ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_pass(rows, index) for index in indexes(items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def _pass(rows: DataFrame, index: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            hits = [(ids[i], *rest) for i, *rest in index.value.search(batch.column("text").to_pylist())]
            columns = list(zip(*hits, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return rows.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no test item; null texts, empty ones and repeated rows stay."""
    at = docs.columns.index("text")
    for index in indexes(items):
        docs = _drop(docs, index, at)
    return docs


def _drop(docs: DataFrame, index: Broadcast, at: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[hit[0] for hit in index.value.search(batch.column(at).to_pylist())]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
