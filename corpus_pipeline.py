"""A training corpus from `documents`, in five stages that each work on all that the one before kept.

Language identification leaves out what it rejects, the n-gram Jaccard join leaves one document of
each group of near duplicates, secret scans replace secrets by a mark, mixing repeats and cuts
documents so that sources get their shares, and packing lays the texts out in sequences. All but the
last return the columns of `documents`. Rows without a doc_id take no part; a document without
letters, or without text, is rejected by the first stage; no documents give no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketline.llm import jaccard, langid, mixing, packing, secrets
from basketline.llm.common import small_batches, table, written

TOKENIZER, END_ID = "byte_bpe_50k.json", 1
ORACLE_SQL = None  # SQL has no tokenizer; tests compare every stage with a brute-force version


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again."""
    rows = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            rows = written(stage(spark, rows, sf_dir), name)
    return rows
