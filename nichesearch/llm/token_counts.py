"""Token counts through a digest cache.

The cache is a Parquet table of (digest, tokenizer, n_tokens): the SHA-256 of the content,
cut to 128 bits, the digest of the tokenizer (file and library version), and the count.
Contents are normalised only in that null is the empty text, since any other change could
change a count. Counting joins the documents' digests to the cache; distinct misses are encoded once and
appended; copies are dropped before they are shuffled.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and copies get
the same count from one encoding; a text of any length is counted whole; ties mean nothing here; an empty table adds nothing to the cache; other columns
are ignored. A file appended twice by a repeated task gives equal rows, which are grouped
on reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LIMIT = 1024
#: Digests of 16 bytes that may be broadcast: some 2 MB as a table of a join.
BROADCAST_DIGESTS = 20_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def content_digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens), one row a digest, of one tokenizer."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest no row before them has."""
    seen: set[bytes] = set()
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        fresh = [d not in seen and not seen.add(d) for d in digests]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def fill(docs: DataFrame, cache: str, path: str) -> str:
    """Encode the distinct contents of ``docs`` (text) that the cache lacks, and append their counts. The tokenizer's digest.

    A task passes on only the first of its copies, so that none gathers a content's copies;
    after the shuffle by digest, which sorts nothing, the first of a partition's is encoded.
    What a task remembers is the digests of its rows. With a cache, the digests that it
    lacks are found first, without texts; if they are few enough to be broadcast, no text
    moves but theirs.
    """
    spark, tokenizer = docs.sparkSession, tokens.digest(path)
    common.small_batches(spark)
    contents = docs.select(content_digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    lacking = None
    if exists(spark, cache):
        lacking = common.written(contents.select("digest").distinct().join(cached(spark, cache, tokenizer), "digest", "left_anti"), "token-misses")
        if lacking.count() <= BROADCAST_DIGESTS:
            contents, lacking = contents.join(F.broadcast(lacking), "digest", "left_semi"), None
    dealt = contents.mapInArrow(_firsts, "digest binary, text string").repartition("digest")
    if lacking is not None:
        dealt = dealt.join(lacking.hint("shuffle_hash"), "digest", "left_semi")  # where the texts are: only digests move

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in _firsts(batches):
            counts = encoder.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([tokenizer] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"]
            )

    dealt.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return tokenizer


def count(docs: DataFrame, cache: str, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text)."""
    tokenizer = fill(docs, cache, path)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("digest"))
    counts = common.written(cached(docs.sparkSession, cache, tokenizer), "token-counts")  # so that the join's skewed keys can be split
    rows = rows.join(counts, "digest")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
