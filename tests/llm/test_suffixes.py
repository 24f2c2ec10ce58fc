"""Removal of repeated passages against all strings in a dictionary."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from basketline.llm import suffixes
from tests.llm.conftest import SCHEMA, corpus


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])[:len(gone)]).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, "x", 5, 1) for i, t in rows], SCHEMA + ", first int").repartition(parts)


def shuffled_passages(seed, n=40, letters="abé "):
    """Few letters, so that strings repeat at every length; periodic texts, shared passages, repeated rows."""
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(shared) if rnd.random() < .4 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(rnd.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 90), (101, "a" * 200), (102, None), (103, ""), rows[3], rows[4], (rows[5][0], rows[6][1]), (104, "ab" * 7)]
    return rows


@pytest.mark.parametrize("length, gram", [(12, 3), (12, 12), (40, 10), (3, 1), (64, 16)])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_strings(spark, length, gram, seed):
    rows = shuffled_passages(seed)
    assert removed(suffixes.remove_repeats(frame(spark, rows), length, gram)) == brute(rows, length)


def test_production_length(spark):
    rows = [(r[0], r[1]) for r in corpus(60)]
    assert removed(suffixes.remove_repeats(frame(spark, rows))) == brute(rows, 200)


def test_rows_without_id_and_clashing_names(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    assert removed(suffixes.remove_repeats(odd_docs)) == brute(rows, 200)


def test_no_texts(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert removed(suffixes.remove_repeats(frame(spark, [(1, None), (2, "short")]))) == brute([(1, None), (2, "short")], 200)


def test_runs_lead_every_string_once():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    offsets = np.array([0, 0, 100, 1500, 1510, 3000])
    text, _, _, first, last, place = suffixes.runs(offsets, data, 20, 5)
    led = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert led.tolist() == [i for a, b in zip(offsets, offsets[1:]) for i in range(a, b - 19)]
    assert ((place >= last) & (place + 5 <= first + 20)).all() and (offsets[text] <= first).all()
