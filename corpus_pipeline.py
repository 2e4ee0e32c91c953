"""The corpus pipeline: from raw documents to token ids, in stages that each keep the columns of documents but the last.

Every stage works on all that its predecessor kept. Rows with a null text count as empty; an empty table stays empty;
columns besides those of documents are carried along, whatever their names. Of rows that repeat an id and a text, the
second stage keeps one; if they differ in other columns, that of the least hash of all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, jaccard, mixing, quality, secrets
from barloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against trusted ones."""
    apart = [f"c{i}" for i in range(len(docs.columns))]  # names that are none of the judgement's
    ids, texts = (apart[docs.columns.index(c)] for c in ("doc_id", "text"))
    kept = quality.judge(docs.toDF(*apart), table(spark, sf_dir, "labels"), ids, texts).filter("kept")
    return kept.select(*apart).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id, and of the smallest text hash if ids repeat."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of each document's token ids, and the digest of what they decode to."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: SQL has neither the shingle components nor the token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
