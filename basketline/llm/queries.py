"""The operators of this folder as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.llm import (brown, collocations, conversations, fingerprints, jaccard, langid, mixing, packing, secrets, sql,
                            suffixes, token_counts, token_files, topk)
from basketline.llm.common import table
from basketline.session import scratch_path

END_ID = 1


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    counts = [F.size(secrets.of_rank(F.col("spans"), rank)).cast("bigint").alias(f"n_{rule.name}")
              for rank, rule in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), brown.input_split())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix_documents(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "source"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.token_positions(spark, folder)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_class_model": op5_class_model,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_top_k": op8_top_k,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op1_secrets": sql.SECRETS, "op4_jaccard_join": sql.JACCARD, "op6_mixing": sql.MIXING, "op8_top_k": sql.TOP_K,
                              "op11_conversation_repair": sql.REPAIR, "op12_suffix_dedup": sql.REPEATS, "op13_collocations": sql.COLLOCATIONS}
