"""Token-ID files: static rANS blocks with checkpoints and checksums.

A file set is a folder with two Parquet tables. ``frequencies`` is the one table of
(token, frequency) that all blocks share, counted over all tokens. ``blocks`` has a row a
block: whole consecutive documents of at least ``BLOCK_TOKENS`` tokens together. Files by
name, and blocks in a file, follow each other in ascending order of doc_id, nulls first,
equal ids by the hash of their text. A block holds its place (part, first), its documents'
ids and token counts, the states of its interleaved lanes, the coded words, checkpoints
inside it, and a CRC32 of all these. Blocks decode independently of each other; inside a
long block decoding can begin at each checkpoint (``between``).

Texts move once, to be ranged and sorted by doc_id; ids are written once between, so that
encoding needs no second tokenisation and survives lost executors. Coded blocks then move to
the file of their part.

Defined cases: null and empty texts are a document of the end id alone; repeated rows are
documents of their own, and equal (doc_id, text) are dealt over files by a third key, as any
order of them is the same; an empty table gives empty files; a text of any length is one
document of one block; other columns are ignored; a damaged block raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, rans, tokens

BLOCK_TOKENS, END_ID = 1 << 17, 2
_IDS = "doc_id long, part int, seq long, n_tokens long, ids binary"
_BLOCKS = "part int, first long, n_tokens long, doc_ids array<long>, counts array<long>, states binary, words binary, marks binary, crc long"


def _encode_texts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of ``_IDS`` in the order of the files."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    equal = F.monotonically_increasing_id()  # parts equal rows, of which any order is the same
    ranged = keyed.withColumn("equal", equal).repartitionByRange(*order, "equal").sortWithinPartitions(*order).drop("equal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            ends += np.arange(1, n + 1)
            coded = ids.astype("<u2").tobytes() if len(ids) and ids.max() < 1 << 16 else None
            width, data = (2, coded) if coded is not None else (4, ids.tobytes())
            begins = ends - counts - 1
            # the width of an id follows from the bytes of a document and its count
            parts = [data[a * width : b * width] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(counts + 1), pa.array(parts, pa.binary())],
                names=["doc_id", "part", "seq", "n_tokens", "ids"],
            )
            seq += n

    return ranged.mapInArrow(run, _IDS)


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _count_ids(rows: DataFrame) -> np.ndarray:
    """Occurrences by token over all rows; counted by task, then summed by token. Bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            parts = [_ids(d, n) for d, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)]
            if parts:
                more = np.bincount(np.concatenate(parts))
                total, more = (np.pad(x, (0, max(0, max(len(total), len(more)) - len(x)))) for x in (total, more))
                total = total + more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])

    counts = rows.select("n_tokens", "ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["token"]] = counts["n"]
    return total


def _crc(r: dict) -> int:
    return rans.checksum(repr((r["part"], r["first"], r["doc_ids"], r["counts"])).encode(), r["states"], r["words"], r["marks"])


def _blocks(rows: DataFrame, freq: np.ndarray, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq, bits)
        held: list[tuple] = []  # documents of the block at hand
        tokens_held = 0

        def block() -> pa.RecordBatch:
            r = {"part": held[0][1], "first": held[0][2], "doc_ids": [x[0] for x in held], "counts": [x[3] for x in held]}
            r["states"], r["words"], r["marks"] = coder.encode(np.concatenate([_ids(x[4], x[3]) for x in held]))
            r |= {"n_tokens": tokens_held, "crc": _crc(r)}
            types = {"part": pa.int32(), "first": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "states": pa.binary(), "words": pa.binary(), "marks": pa.binary(), "crc": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r[k]], t) for k, t in types.items()], names=list(types))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "seq", "n_tokens", "ids")), strict=True):
                if held and (tokens_held >= BLOCK_TOKENS or (row[1], row[2]) != (held[-1][1], held[-1][2] + 1)):
                    yield block()
                    held, tokens_held = [], 0
                held.append(row)
                tokens_held += row[3]
        if held:
            yield block()

    return rows.mapInArrow(run, _BLOCKS)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encode every row of ``docs`` (doc_id, text) with the tokenizer at ``path`` into a new file set."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = common.written(_encode_texts(docs, path, end_id), "token-ids", compression="zstd")
    freq, bits = rans.quantised(_count_ids(rows))
    table = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(table, "token int, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    parts = rows.agg(F.max("part")).first()[0]
    coded = _blocks(rows, freq, bits).repartitionById((parts or 0) + 1, F.col("part"))  # a file a part: their order by name is that of the documents
    coded.sortWithinPartitions("first").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    common.discard(spark, rows)


def _coder_table(spark: SparkSession, folder: str) -> tuple[np.ndarray, int]:
    table = spark.read.schema("token int, frequency long").parquet(f"{folder}/frequencies").toPandas()
    freq = np.zeros(int(table["token"].max()) + 1 if len(table) else 1, np.uint64)
    freq[table["token"]] = table["frequency"]
    return freq, max(1, int(freq.sum())).bit_length() - 1


def read(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Decode a file set: (doc_id, start, n_tokens, ids), or ids_crc32 in place of ids.

    start is the number of ids of all documents before: the sizes of parts, then of blocks
    in a part, then of documents in a block are summed up.
    """
    common.small_batches(spark)
    freq, bits = _coder_table(spark, folder)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    last = ("ids_crc32", "long", pa.int64()) if digests else ("ids", "array<long>", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if _crc(r) != r["crc"]:
                    raise ValueError(f"block {r['part']}:{r['first']} is damaged")
                ids = coder.decode(r["states"], r["words"], r["n_tokens"])
                ends = np.cumsum(r["counts"])
                begins = ends - r["counts"]
                data, n = ids.astype("<u4").tobytes(), len(ends)
                each = zip(begins.tolist(), ends.tolist(), strict=True)
                out = [zlib.crc32(data[4 * a : 4 * b]) for a, b in each] if digests else [ids[a:b].tolist() for a, b in each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["first"])), pa.array(r["doc_ids"], pa.int64()), pa.array(begins), pa.array(r["counts"], pa.int64()), pa.array(out, last[2])],
                    names=["part", "first", "doc_id", "begin", "n_tokens", last[0]],
                )

    rows = blocks.mapInArrow(run, f"part int, first long, doc_id long, begin long, n_tokens long, {last[0]} {last[1]}")
    rows = rows.join(_places(blocks), ["part", "first"])
    return rows.select("doc_id", (F.col("place") + F.col("begin")).alias("start"), "n_tokens", last[0])


def _places(blocks: DataFrame) -> DataFrame:
    """(part, first, place): the number of ids before each block."""
    sizes = blocks.select("part", "first", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    places = sizes.withColumnRenamed("n_tokens", "n").select("part", "first", before(Window.partitionBy("part").orderBy("first")).alias("place"))
    return places.join(parts, "part").select("part", "first", (F.col("base") + F.col("place")).alias("place"))


def between(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """(place, ids): the ids at the places from ``start`` to ``end``, a row a block that holds any, decoded from the checkpoints before them."""
    common.small_batches(spark)
    freq, bits = _coder_table(spark, folder)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    rows = blocks.join(_places(blocks), ["part", "first"]).filter((F.col("place") < end) & (F.col("place") + F.col("n_tokens") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq, bits)
        for batch in batches:
            for r in batch.to_pylist():
                if _crc(r) != r["crc"]:
                    raise ValueError(f"block {r['part']}:{r['first']} is damaged")
                a, z = max(0, start - r["place"]), min(r["n_tokens"], end - r["place"])
                ids = coder.decode(r["states"], r["words"], r["n_tokens"], r["marks"], a, z).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([r["place"] + a], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["place", "ids"])

    return rows.mapInArrow(run, "place long, ids array<long>")
