"""The registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, decontamination, language_id, mixture, quality_mil, quality_rules, secret_scan, simhash, token_counts, token_files, toxicity, warc, whitening


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return language_id.identify(docs, language_id.learn_from(docs))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.plan(common.documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds the benchmark's texts already; the documents are joined to it, and what it lacks is encoded."""
    cache = common.shared_path(spark, "token-cache")
    token_counts.fill(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cache, TOKENIZER)
    return token_counts.count(common.documents(spark, sf_dir), cache, TOKENIZER)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_path(spark, "token-files")
    token_files.write(common.documents(spark, sf_dir), folder, TOKENIZER)
    return token_files.read(spark, folder, digests=True)


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(common.documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(common.documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are archived, then every one of their URLs is looked up in the index and its records are read."""
    pages, folder = spark.read.parquet(f"{sf_dir}/pages.parquet"), common.shared_path(spark, "warc")
    warc.write(pages, folder)
    return warc.fetch(spark, folder, pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op10_mixture": op10_mixture,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op7_quality_mil": op7_quality_mil,
    "op9_toxicity": op9_toxicity,
    "op8_simhash": op8_simhash,
    "op6_decontamination": op6_decontamination,
    "op11_warc": op11_warc,
    "op12_whitening": op12_whitening,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle(),
    "op11_warc": warc.ORACLE,
}
