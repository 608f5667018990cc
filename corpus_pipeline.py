"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versemill.llm import decontaminate, packing, quality, secret_scan, shingle_dedup
from versemill.llm.common import read, stored
from versemill.llm.queries import tokenizer_path
from versemill.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or fall below the log-ratio threshold go."""
    configure(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word Jaccard similarity of 0.8 or more stays."""
    configure(spark)
    return shingle_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    configure(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the texts; widely copied examples stay."""
    configure(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the sequences."""
    configure(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

# Hashed n-grams, XXH64 and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
