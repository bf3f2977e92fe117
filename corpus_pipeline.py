"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret redaction, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as a table in the
shared folder and reads it back as the next one's docs. All but the last return docs' own columns, whatever they are
called.

Every stage judges each row by its whole text, however long; an empty table gives an empty one. Rows without an id are
judged like others; equal texts get equal decisions, so only near_duplicates has ties, which go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.bytebpe import bpe_round_trip
from assayloom.llm.common import staged, table
from assayloom.llm.decontaminate import decontaminate
from assayloom.llm.quality import judge_quality
from assayloom.llm.secrets import scan_secrets
from assayloom.llm.simhash import deduplicate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows stay or go together."""
    return judge_quality(docs, table(spark, sf_dir, "labels"), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component. Null and wordless texts are one component with others of
    fingerprint zero; all rows of the smallest id stay, and so do rows without an id."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the words that lie in benchmark windows. Null texts stay null, an empty
    benchmark changes nothing, repeated rows are cut alike."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), clean="spans")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret. No row goes; null texts stay null, repeated rows are marked alike."""
    return scan_secrets(docs, redact=True)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256, for every row. Null
    texts count as empty."""
    import public_tokenizers

    made = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the trees, the compression test or BPE; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
