"""Collocations against counting in dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from basketline.llm import collocations
from tests.llm.conftest import LOWER, SCHEMA

POINT = re.compile("[.,;:!?\x0a-\x0d]")
WORD = re.compile("[^ \t]+")


def brute(rows, least, report):
    """rows of (lang, text)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in POINT.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                f[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:report], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(n=150, seed=2):
    rnd = random.Random(seed)
    words = ["of", "The", "the", "New", "york", "city", "ünder", "a-b", "x", "naïve", "\x0bbreak", "in"]
    out = []
    for i in range(n):
        parts = [rnd.choice(["new york city", "in the city", "THE  x\tof", rnd.choice(words), rnd.choice(words)]) for _ in range(rnd.randint(0, 25))]
        out.append((rnd.choice(["en", "de", None]), rnd.choice([" ", " ", ". ", "  ", "\t"]).join(parts)))
    return out + [("en", None), ("en", ""), (None, "."), ("fr", "new york"), ("en", "the x " * 3000)] + [("de", "same line in the city")] * 30


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block_bytes, bits", [(4 << 20, 48), (300, 48), (2000, 7)])
def test_equals_counting(spark, block_bytes, bits):
    """Small blocks, and fingerprints of 7 bits so that nearly all collide."""
    rows = texts()
    df = spark.createDataFrame([(i, t, lang, "s", 0, "clash") for i, (lang, t) in enumerate(rows)], SCHEMA + ", phrase string").repartition(3)
    got = collected(collocations.collocations(df, least=5, report=40, block_bytes=block_bytes, bits=bits))
    assert got == brute(rows, 5, 40)


def test_blocks_are_compressed(spark):
    text = "one two three, four five six. " * 2000
    found = collocations.blocks(spark.createDataFrame([(1, text, "xx")], "doc_id bigint, text string, lang string"), 10_000).collect()
    raw = [collocations.layout(pa.scalar(bytes(r["data"]), pa.binary())) for r in found]
    assert b"".join(x.tobytes() for x in raw) == b"one two three\nfour five six\n" * 2000
    assert len(found) > 4 and all(len(r["data"]) < len(x) / 2 for r, x in zip(found, raw))


def test_laid_out():
    data, n = collocations.laid_out(pa.array(["A  b,c", "", "D e\n\nf", "g"]))
    assert (data.tobytes(), n) == (b"a b\nc\nd e\nf\ng\n", 7)


def test_block_of_short_pieces(spark):
    """Pieces of one word and of two only: a block without any 3-gram."""
    rows = [("en", "a. b. c d")] * 12 + [("de", "x.\ny")] * 12
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], SCHEMA).coalesce(1)
    assert collected(collocations.collocations(df)) == brute(rows, 10, 2000) != []


def test_packing_round_trip():
    columns = [np.array([0, 3, 2**47]), np.array([1, 1, 70000]), np.array([5, 0, 9])]
    assert [c.tolist() for c in collocations.unpacked(collocations.packed(columns), 3)] == [c.tolist() for c in columns]


def test_scores_pass_64_bits(spark):
    rows = [("en", "a", 1, 9 * 10**11), ("en", "b", 1, 8 * 10**11), ("en", "a b", 2, 7 * 10**11)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f bigint")).first()
    assert got["score"] == 1000000 * 49 // 72


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA)).collect() == []
