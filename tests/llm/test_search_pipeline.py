from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketline.llm import topk

from .conftest import SCHEMA, collected, corpus


def best_by_sorting(rows, k, is_query):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        vectors[i] = min(vectors.get(i, whole), whole)
    out = set()
    for q in filter(is_query, vectors):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], c)), i) for i, c in vectors.items() if i != q)
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rnd.normal(size=(160, 6)))]
    rows += [(200 + i, rows[10][1]) for i in range(60)]  # ties
    rows += [(300, None), (350, [1.0, None]), (351, [float("nan")]), (352, [float("inf")]), (None, [1.0]), (353, []), (354, [0.5] * 9), (0, [9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {tuple(r.values()) for r in collected(topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5))}
    assert got == best_by_sorting(rows, 5, lambda i: i % 50 == 0)


def test_top_k_of_few(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0]), (50, [-1.0])], [(1, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        got = {tuple(r.values()) for r in collected(topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5))}
        assert got == best_by_sorting(rows, 5, lambda i: i % 50 == 0)


def test_pipeline(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(d, t, lang or rnd.choice(["xx", "yy"]), s, n) for d, t, lang, s, n in corpus(80, 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert kept.count() > 0
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in kept.collect()}


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
