"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: whole texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: ASCII white space that separates words: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
#: Java pattern of a run of such white space.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset on one machine
    (tests, a notebook) a temporary folder is made and set. On a cluster there must be one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="nichesearch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables that were written and not yet discarded, by path.
_kept: list[str] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    _kept.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables that ``written`` made, by the frame it returned or by path; nothing may read them any more.

    What a lazy result still reads can't be deleted here: the pipeline deletes it when the result is written.
    """
    for table in tables:
        path = table if isinstance(table, str) else table._written_to
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        if path in _kept:
            _kept.remove(path)


def kept() -> list[str]:
    return list(_kept)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now instead of at the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 500_000


def few(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row as the side of a join: broadcast if it is small, else the built side of a shuffled join."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ln_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1 by Stirling's series, moved up by eight; good to 1e-12."""
    y = x + F.lit(8.0)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    below = F.ln(x)
    for k in range(1, 8):
        below = below + F.ln(x + F.lit(float(k)))
    return (y - F.lit(0.5)) * F.ln(y) - y + F.lit(0.9189385332046727) + series - below


def ln_choose(n: Column, k: Column) -> Column:
    one = F.lit(1.0)
    return ln_gamma(n + one) - ln_gamma(k + one) - ln_gamma(n - k + one)
