"""The corpus pipeline: five operators in a row, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, decontam, neardup, quality, secrets
from lodestack.llm.registry import table, vocabulary
from lodestack.llm.store import Steps


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest doc_id (of repeated rows, one)."""
    return neardup.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with live-looking secrets replaced by a mark."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and their number, for documents whose ids decode to their text."""
    ranks, pattern = vocabulary()
    # Workers that go through all stages remember less than those that only tokenize.
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", digest.alias("_digest"), "text"), ranks, pattern, memory=30_000, decoded=True)
    exact = F.when(F.sha2("decoded", 256) == F.col("_digest"), F.size("ids").cast("long")).otherwise(F.raise_error(F.lit("ids do not decode to their text")))
    return coded.select("doc_id", "lang", "source", exact.alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = steps.write(stage(spark, docs, sf_dir))
    return docs


#: Tokenizing and near-duplicate classes have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
