"""Near-duplicates by SimHash, searched with the pigeonring filter.

Fingerprints of 64 bits are cut into a ring of eight segments. If two differ in at most 3
bits, some segment starts a chain in which the differences of the first l segments sum to
at most floor(3 l / 8), for every l: none over two segments, one over five, two over seven,
three over all. A chain's first five segments therefore agree but for one of the last three,
so that a pair meets in the bucket of one of 3 x 8 masks of 32 bits; inside a bucket, the
rest of the chain is checked before the whole distance.

Only distinct fingerprints are searched: copies cost nothing. A bucket of more than
``LIMIT`` of them is dealt anew: its free bits fall in four groups, one of which must agree,
so each fingerprint goes to four smaller buckets, as often as needed. A bucket gives a
spanning forest of its links, not all pairs. Components of the links are found by
alternating large and small stars on tables in the shared folder.

Defined cases: a text without words (null, empty) has fingerprint zero and links like any
other; fewer than three words are one shingle; repeated rows get equal results; a null
doc_id gets its component's smallest id, null if there is none; a bit set in exactly half of the
shingles is 0; a text of any length is read whole; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 8
#: Fingerprints of a bucket that one task compares; larger buckets are dealt anew, three times at most (16,384 values are left then).
LIMIT, DEALS = 2048, 3
_FULL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """Unsigned; lower-cases A-Z only; words are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - WORDS + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text); fp as a signed long."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segments(first: int, n: int) -> int:
    """The bits of n segments of the ring from the first one."""
    return sum(0xFF << (8 * ((first + k) % SEGMENTS)) for k in range(n))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: (start of the chain, mask): five segments but one of the last three.
CHAINS = [(i, _segments(i, 5) ^ _segments(i + j, 1)) for i in range(SEGMENTS) for j in (2, 3, 4)]


def _finer(mask: int) -> list[int]:
    """The mask with each of four groups of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // 4 for k in range(5)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _compare(start: np.ndarray, run: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows whose run is equal; runs are consecutive."""
    six, seven = (np.array([_segments(i, n) for i in range(SEGMENTS)], np.uint64) for n in (6, 7))
    parent: dict[tuple[int, int], tuple[int, int]] = {}
    links = []

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for lag in range(1, len(fp)):
        at = np.flatnonzero(run[:-lag] == run[lag:])
        if not len(at):
            break
        x = fp[at] ^ fp[at + lag]
        for masks, most in ((six, 2), (seven, 2), (None, DISTANCE)):
            ok = np.bitwise_count(x & masks[start[at]] if masks is not None else x) <= most
            at, x = at[ok], x[ok]
        for i in at.tolist():
            a, b = root((int(run[i]), int(fp[i]))), root((int(run[i]), int(fp[i + lag])))
            if a != b:
                parent[b] = a
                links.append((int(fp[i]), int(fp[i + lag])))
    return links


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in rows (start, mask, val, fp) that are sorted by bucket; the last bucket of a batch waits for the next."""
    held: np.ndarray | None = None

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)
        run = np.cumsum(new)
        some = np.isin(run, np.flatnonzero(np.bincount(run) > 1))
        found = np.array(_compare(rows[some, 0], run[some], rows[some, 3].view(np.uint64)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1, initial=2**63 - 1)), pa.array(found.max(axis=1, initial=-(2**63)))], names=["u", "v"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "mask", "val", "fp")], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        if len(rows):
            last = int((rows[:, 1:3] == rows[-1, 1:3]).all(axis=1).argmax())
            held = rows[last:]
            if last:
                yield links(rows[:last])
    if held is not None and len(held):
        yield links(held)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) with u < v: links that connect all fingerprints of ``distinct`` (fp) within the distance."""
    spark = distinct.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("start"), F.lit(_signed(m)).alias("mask")) for i, m in CHAINS]))
    rows = distinct.select("fp", each.alias("s")).select("s.start", "s.mask", F.col("fp").bitwiseAND(F.col("s.mask")).alias("val"), "fp")
    masks = [m for _, m in CHAINS]
    cold: list[DataFrame] = []
    for _ in range(DEALS):
        hot = common.written(rows.groupBy("mask", "val").count().filter(F.col("count") > LIMIT).select("mask", "val"), "simhash-hot")
        if hot.isEmpty():
            break
        cold.append(rows.join(hot, ["mask", "val"], "left_anti"))
        table = spark.createDataFrame([(_signed(m), [_signed(x) for x in _finer(m)]) for m in dict.fromkeys(masks)], "mask long, finer array<long>")
        rows = rows.join(hot, ["mask", "val"], "left_semi").join(F.broadcast(table), "mask").select("start", F.explode("finer").alias("mask"), "fp")
        rows = common.written(rows.select("start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp"), "simhash-finer")
        masks = [x for m in masks for x in _finer(m)]
    for part in cold:
        rows = rows.unionByName(part.select(rows.columns))
    dealt = rows.repartition("mask", "val").sortWithinPartitions("mask", "val", "fp")
    return dealt.mapInArrow(_search, "u long, v long").distinct()


def _hung(both: DataFrame, least: DataFrame) -> DataFrame:
    """Each larger neighbour v of u in ``both`` (u, v), hung on the m of u in ``least``."""
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of the edges (u, v).

    A large star hangs a node's larger neighbours on its least neighbour, a small star its
    smaller ones; alternating until nothing changes leaves one star a component. Hubs are
    joined to their least neighbour, not gathered; both sides of a join are written first,
    so that Spark splits a hub's rows.
    """
    spark = edges.sparkSession
    edges, mark = common.written(edges, "stars"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars-least")
        large = common.written(_hung(both, least).distinct(), "stars-large")
        low = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "stars-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = common.written(small.filter("u <> v").distinct().select(F.col("v").alias("u"), F.col("u").alias("v")), "stars")
        common.discard(spark, edges, least, large, low)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        mark = now


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text)."""
    prints = common.written(fingerprints(docs), "simhash-prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = stars(links(distinct.select("fp")))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = common.written(linked, "simhash-linked")
    least = common.written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    found = common.written(linked.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    rows = components(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns; see ``one_of_each``."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = components(rows.select(F.xxhash64("doc_id", "h").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")).distinct()
    return one_of_each(docs, rows.select("doc_id", "h", F.xxhash64("doc_id", "h").alias("row")).join(found, "row"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``found`` (doc_id, h: hash of the text, root): by the smallest id, nulls last, then the smallest hash; once if it is repeated."""
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")).alias("l")).select("root", "l.id", F.col("l.h").alias("least"))
    others = found.join(common.written(least, "near-least"), "root").filter("NOT (doc_id <=> id AND h = least)")
    dropped = common.written(others.select("doc_id", "h").distinct(), "near-dropped")
    repeated = common.written(found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "h"), "near-repeated")
    kept = _among(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return kept
    return _among(kept, repeated, "left_anti").unionByName(_among(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    return docs.alias("d").join(common.few(rows).alias("i"), F.expr("d.doc_id <=> i.doc_id AND xxhash64(d.text) = i.h"), how)
