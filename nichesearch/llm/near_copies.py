"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash (``simhash``) opens the search: the fingerprints of the sets that its pigeonring
search links, and sets of one fingerprint, are compared as whole sets. At a similarity of
0.8 two fingerprints differ in some ten bits of 64, so that most near copies lie beyond its
reach; an exact search by prefixes completes it. All shingles have one global order. Of two
sets of n and m shingles that are similar enough, the first 0.2 n + 1 and 0.2 m + 1, their
heads, share one; where the first that they share stands at the places i and j, n - i and m - j
must reach the overlap that sizes of n and m need. Pairs that pass are compared as whole sets.

Any order gives the same result. That of hashes is taken, but with shingles that a sample of
the texts holds more than once at the end, the commonest last: common lines and passages put
few documents together. Copies of a set are searched once. Large groups are not compared pair
by pair: first two sets of each shingle, that with the least share of rare shingles and one
by hash, are compared with the others, and only then the pairs that are not yet connected. Before
whole sets are compared, a map of ``MAP`` parities a set tells how much they differ at least: each shingle turns one
place of it over, so that no more places differ than shingles do, of which similar sets of n and m have at
most (n + m) / 9. So texts made of the same few sentences are told apart before they are moved.
No step gathers the sets of a shingle.

Words are as in ``simhash``; fewer than five are one shingle; texts without words are copies
of each other. Hashes of 64 bits stand for shingles, sets and texts.

Defined cases: rows are told apart by id and text, null ids included; repeated rows and copies
are one group; of equal similarity nothing depends; texts of any length are compared whole;
an empty table gives an empty one; other columns are kept by ``keep_one`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import links as fingerprint_links
from .simhash import one_of_each, stars

WORDS, SEED = 5, 42
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: One text of so many, by hash, tells which shingles are common, and how many of the commonest are kept; neither changes the result.
SAMPLE, HOTTEST = 16, 1 << 18
#: Places of a set's map of parities, a multiple of 64.
MAP = 256
#: Sets that a task remembers while it compares pairs.
REMEMBERED = 64
#: Odd factors of the words of a shingle.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: Hashes of words that a task remembers.
_REMEMBERED = 1 << 17


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: str | None, hashes: _Hashes) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    x = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        x = (x ^ x >> np.uint64(29)) + own[i : i + n] * factor
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return np.unique(x ^ x >> np.uint64(33))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _head(own: np.ndarray, hot: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, those that are ``hot`` (ordered) at the end by their places, and how many of the set are not hot."""
    n, rare = len(own) - -(-PART * len(own) // WHOLE) + 1 if len(own) else 0, len(own)
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        place = np.where(hot[at] == own, places[at], 0)
        rare = int((place == 0).sum())
        if rare < n:
            own = own[np.argsort(place, kind="stable")]
        else:
            own = own[place == 0]
    return own[:n], rare


def _fingerprint(own: np.ndarray) -> int:
    """Of a set: a bit is 1 if set in over half of its shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0])


def _parities(own: np.ndarray) -> list[int]:
    """Of a set: whether an odd number of its shingles has each place, as longs."""
    odd = np.bincount((own % np.uint64(MAP)).astype(np.int64), minlength=MAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _longs(x: np.ndarray | list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _hottest(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in the order of their values, and their places from 1, the commonest last. At most ``HOTTEST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [shingles(t, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate([np.zeros(0, np.uint64), *found]))], names=["shingle"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counted = some.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 1")
    hot = counted.orderBy(F.desc("count"), "shingle").limit(HOTTEST).toArrow()
    order = np.argsort(values := hot.column("shingle").to_numpy().view(np.uint64))
    return values[order], len(order) - order


def _prints(docs: DataFrame, hot: np.ndarray, places: np.ndarray) -> DataFrame:
    """(doc_id, h: hash of the text, key of the set, its fingerprint, n, rare, head, map of parities) of each row; a head and map once a task for each set, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            rows = []
            for own in (shingles(t, hashes) for t in batch.column("text").to_pylist()):
                key, head, rare = _key(own), None, 0
                if len(own) and key not in seen:
                    seen.add(key)
                    head, rare = _head(own, hot, places)
                rows.append((key, _fingerprint(own) if head is not None else 0, len(own), rare, head, None if head is None else _parities(own)))
            keys, fps, sizes, rares, heads, maps = zip(*rows, strict=True) if rows else ((),) * 6
            ends = pa.array([0, *np.cumsum([0 if h is None else len(h) for h in heads]).tolist()], pa.int32())
            values = np.concatenate([np.zeros(0, np.uint64), *(h for h in heads if h is not None)])
            lists = pa.ListArray.from_arrays(ends, _longs(values), mask=pa.array([h is None for h in heads], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), _longs(keys), _longs(fps), pa.array(sizes, pa.int64()), pa.array(rares, pa.int64()), lists, pa.array(maps, pa.list_(pa.int64()))], names=["doc_id", "h", "key", "fp", "n", "rare", "head", "map"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, key long, fp long, n long, rare long, head array<long>, map array<long>")


_ROW = ("shingle", "key", "n", "rare", "place")


def _shared(heads: DataFrame) -> DataFrame:
    """The distinct rows of ``_ROW`` whose shingle is in the heads of two sets or more; holds one row at a time between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = np.zeros((0, len(_ROW)), np.int64), False  # the last row, and whether its shingle has an earlier one
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW], axis=1)])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            rows = rows[new]
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.zeros(len(rows), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= before
            held, before = rows[-1:], bool(keep[-1])
            out = rows[:-1][keep[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(len(_ROW))], names=list(_ROW))
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(len(_ROW))], names=list(_ROW))

    return heads.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(run, heads.schema)


def _possible(a: str, b: str) -> str:
    """Whether what is left of both sets from a shingle on reaches the overlap that they need, if it is the first that they share."""
    return f"{PART + WHOLE} * least({a}.n - {a}.place, {b}.n - {b}.place) >= {PART} * ({a}.n + {b}.n)"


def _with_pivots(rows: DataFrame, choice: Column) -> DataFrame:
    """Pairs (u, v) of the first set of each shingle, by ``choice``, and each other set of the shingle in another group."""
    first = rows.groupBy("shingle").agg(F.min_by(F.struct("key", "n", "place", "root"), F.struct(choice, "key")).alias("p"))
    first = common.written(first.select("shingle", "p.*"), "near-pivots")
    joined = rows.alias("a").join(first.alias("b"), F.expr(f"a.shingle = b.shingle AND a.root <> b.root AND {_possible('a', 'b')}"))
    return joined.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()


def _unconnected(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the groups ``known`` (key, root) as root, of shingles that more than one group shares."""
    rows = rows.drop("root").join(known, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = common.written(rows, "near-rows")
    several = rows.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("shingle")
    return rows.join(common.written(several, "near-several"), "shingle", "left_semi")


def _alike(a: str, b: str) -> str:
    """Whether the maps of parities of both sets differ in as few places as sets that are similar enough can."""
    apart = " + ".join(f"bit_count({a}.map[{i}] ^ {b}.map[{i}])" for i in range(MAP // 64))
    return f"{PART + WHOLE} * ({apart}) <= {a}.n + {b}.n"


def _apart(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (u, v) without those whose maps tell that they differ too much."""
    for c in "uv":
        pairs = pairs.join(maps.select(F.col("key").alias(c), F.struct("n", "map").alias(f"_{c}")), c)
    return pairs.filter(_alike("_u", "_v")).select("u", "v").distinct()


def _every(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """All pairs (u, v) of sets that share a shingle, are possible by place and map, and not in one group.

    The largest group of a shingle is not compared with itself: the others are joined to all.
    """
    groups = rows.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    largest = common.written(groups.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("largest")), "near-largest")
    marked = rows.join(largest, "shingle").withColumn("large", F.col("root") == F.col("largest")).drop("largest").join(maps.select("key", "map"), "key")
    marked = common.written(marked, "near-marked")
    a, b = marked.alias("a"), marked.filter("NOT large").alias("b")
    joined = a.join(b, F.expr(f"a.shingle = b.shingle AND a.root <> b.root AND (a.large OR a.key < b.key) AND {_possible('a', 'b')} AND {_alike('a', 'b')}"))
    return joined.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()


def _by_fingerprints(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are one or linked; of each fingerprint the least set stands for it in its links."""
    sets = common.written(prints.filter("fp is not null").select("fp", "key").distinct(), "near-fingerprints")
    least = common.written(sets.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("c")), "near-least")
    found = fingerprint_links(least.select("fp"))
    linked = found.join(least.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v")
    equal = sets.join(least.filter("c > 1"), "fp").filter("key <> least").select(F.col("least").alias("x"), F.col("key").alias("y"))
    return linked.select("x", "y").unionByName(equal).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def _texts(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, text) of the sets of ``pairs``. A task passes on one of its copies of a text; no text moves that is not compared while the keys are few."""

    def once(column: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                keys = batch.column(column).to_pylist()
                yield batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))

        return run

    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    needed = common.written(prints.groupBy("key").agg(F.min("h").alias("h")).join(keys, "key").select("h", "key"), "near-needed")
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    if needed.count() > common.BROADCAST_ROWS:
        texts = texts.mapInArrow(once("h"), texts.schema)
    texts = texts.join(common.few(needed), "h").select("key", "text").mapInArrow(once("key"), "key long, text string")
    return common.written(texts.repartition("key").mapInArrow(once("key"), "key long, text string"), "near-texts")


def verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The written ``pairs`` (u, v) of keys whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets = _Hashes(), {}

        def own(key: int, text: str) -> np.ndarray:
            if (found := sets.pop(key, None)) is None:
                found = shingles(text, hashes)
                if len(sets) >= REMEMBERED:
                    sets.pop(next(iter(sets)))
            sets[key] = found
            return found

        for batch in batches:
            ok = []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "x", "y")), strict=True):
                x, y = own(u, a), own(v, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((PART + WHOLE) * both >= PART * (len(x) + len(y)))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    texts = _texts(docs, prints, pairs)
    rows = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("key").alias("v"), F.col("text").alias("y")), "v")
    links = common.written(rows.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "near-links")
    common.discard(docs.sparkSession, texts, pairs)
    common.release(docs.sparkSession)
    return links


def roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, h: hash of the text, key) of ``docs`` (doc_id, text), and (key, root) of the keys with near copies."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", "text")
    whole = common.written(_prints(docs, *_hottest(docs)), "near-heads")
    heads = whole.filter("head is not null").select("key", "n", "rare", F.posexplode("head").alias("place", "shingle"))
    shared = common.written(_shared(heads.select("shingle", "key", "n", "rare", F.col("place").cast("long").alias("place"))), "near-shared")
    prints = common.written(whole.select("doc_id", "h", "key", F.when(F.col("head").isNotNull(), F.col("fp")).alias("fp"), "n", "map"), "near-prints")
    common.discard(spark, whole)
    common.release(spark)
    rows = shared.withColumn("root", F.col("key"))
    pairs = _by_fingerprints(prints)
    for choice in (F.col("rare") / F.col("n"), F.xxhash64("key")):
        pairs = pairs.unionByName(_with_pivots(rows, choice))
    maps = common.written(prints.filter("map is not null").select("key", "n", "map").dropDuplicates(["key"]), "near-maps")
    links = verified(docs, prints, common.written(_apart(pairs.distinct(), maps), "near-pairs"))
    found = stars(links).withColumnRenamed("node", "key")
    rows = common.written(_unconnected(rows, found), "near-rows")
    if not rows.isEmpty():
        links = links.unionByName(verified(docs, prints, common.written(_every(rows, maps), "near-pairs")))
        found = stars(links).withColumnRenamed("node", "key")
    return prints.select("doc_id", "h", "key"), found


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group that near copies connect, all columns; see ``one_of_each``."""
    prints, found = roots(docs)
    rows = prints.join(found, "key", "left").select("doc_id", "h", F.coalesce("root", "key").alias("root"))
    return one_of_each(docs, common.written(rows, "near-found"))
