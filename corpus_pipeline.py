"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from nichesearch.llm import common, decontamination, language_id, mixture, near_copies, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go.

    Null, empty and letterless texts have no language and go; ties between languages are
    rejected; repeated rows go or stay together; whole texts of any length count; an empty
    table, or one without labels, leaves no rows; other columns are kept as they are.
    """
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more) stays: the one with the smallest doc_id.

    Null ids come last, then the smallest hash of the text decides. Null and empty texts are
    copies of each other; repeated rows are one; rows of one id with different texts are
    different documents; texts of any length are compared whole; an empty table stays empty;
    other columns are kept, of repeated rows those of any.
    """
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts stay; repeated rows go or stay together; equal scores change nothing;
    whole texts of any length are searched; an empty table on either side drops nothing; other
    columns are kept.
    """
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mixture takes, shard by shard.

    Null and empty texts have no words and go; a null source is a source; repeated rows and
    null ids are documents of their own; order is by hashes, so that nothing ties; a text of
    any length is one block, cut once at most; an empty table stays empty; other columns are
    kept, n_chars follows a cut.
    """
    return mixture.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: (doc_id, start, n_tokens, ids_crc32) of each document in them.

    Null and empty texts are the end id alone; null ids come first, equal ids by the hash of
    their text; repeated rows are documents of their own; a text of any length is one document;
    an empty table gives no rows; other columns are ignored.
    """
    folder = common.shared_path(spark, "token-files")
    token_files.write(docs, folder, TOKENIZER)
    return token_files.read(spark, folder, digests=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again; what a stage left besides is deleted."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = {*common.kept()}
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(spark, *[x for x in common.kept() if x not in before and x != docs._written_to])
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are learned or searched, which SQL can't express.
ORACLE_SQL = None
