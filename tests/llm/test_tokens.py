from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketline.llm import packing, token_counts, token_files
from basketline.llm.tokens import PieceIds
from basketline.session import scratch_path

from .conftest import clean, collected

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENCODERS = {p: PieceIds(p) for p in (WORD, BYTE)}
COUNTER = token_counts.PieceCounts(WORD)


def ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(b"".join(struct.pack("<I", x) for x in numbers))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c 　\x85abCZ12½'’éÉ́ßΣİ.,!?;:-_<|>endoftx漢", max_size=40), min_size=1, max_size=6))
def test_pieces_give_the_library_ids(texts):
    column = pa.array(texts, pa.string())
    for path, encoder in ENCODERS.items():
        bounds, found = encoder.encode(column)
        assert [found[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids(path, t) for t in texts]
    assert COUNTER.count(column).tolist() == [len(ids(WORD, t)) for t in texts]


def test_forgetting_pieces_changes_nothing(monkeypatch, rows):
    monkeypatch.setattr("basketline.llm.tokens.CACHE_PIECES", 50)
    encoder = PieceIds(WORD)
    for _, text in clean(rows)[:20]:
        assert encoder.encode(pa.array([text]))[1].tolist() == ids(WORD, text)


def test_whole_tokens_are_single():
    single = token_counts.whole_tokens(LIBRARY[WORD])
    assert 10_000 < len(single) < 50_000
    for word in ("the", "house", "password"):
        assert word in single and len(ids(WORD, word)) == 1


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_counts(request, name):
    df = request.getfixturevalue(name)
    texts = clean([(r["doc_id"], r["text"]) for r in df.collect()])
    want = Counter((d, len(t.encode()), len(ids(WORD, t)), len(ids(WORD, t)) > 2048) for d, t in texts)
    got = Counter(tuple(r.values()) for r in collected(token_counts.count_tokens(df, WORD)))
    assert got == want


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_files_round_trip(spark, request, name):
    df = request.getfixturevalue(name)
    folder = scratch_path(spark, "files")
    token_files.write_token_files(df, folder, WORD, 1)
    texts = clean([(r["doc_id"], r["text"]) for r in df.collect()])
    encoded = sorted((d, [*ids(WORD, t), 1]) for d, t in texts)
    got = sorted(collected(token_files.token_positions(spark, folder)), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), crc(x)) for d, x in encoded)
    assert [r["doc_id"] for r in got] == [d for d, _ in encoded]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])][:len(got)]
    shuffled = token_files.shuffled_records(spark, folder, 3).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in shuffled) == Counter((d, tuple(x)) for d, x in encoded)


def test_damage_is_found():
    good = token_files.frame(7, np.array([1, 2, 49_000]), 2) + b"\n"
    doc_id, found, after = token_files.record_at(good, 0)
    assert (doc_id, found.tolist(), after) == (7, [1, 2, 49_000], len(good))
    for at in (0, 9, 14, len(good) - 3):
        broken = bytearray(good)
        broken[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            token_files.record_at(bytes(broken), 0)


def test_packing(docs, odd_docs, no_docs):
    for df, size in ((docs, 2048), (docs, 64), (odd_docs, 128), (no_docs, 64)):
        texts = clean([(r["doc_id"], r["text"]) for r in df.collect()])
        pieces = collected(packing.pack(df, BYTE, 1, size))
        want = Counter()
        for d, t in texts:
            encoded = [*ids(BYTE, t), 1]
            want.update((d, a, len(encoded[a:a + size]), crc(encoded[a:a + size]), len(encoded)) for a in range(0, len(encoded), size))
        assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
        sequences = {}
        for p in pieces:
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        for lie in sequences.values():
            lie.sort()
            assert lie[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(lie, lie[1:])) and sum(lie[-1]) <= size
        if pieces:
            used = sum(p["length"] for p in pieces)
            assert len(sequences) <= used / size * 1.15 + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 32)
    placed = Counter()
    for packs, lengths in patterns:
        assert packs > 0 and sum(lengths) <= 32
        for length in lengths:
            placed[length] += packs
    assert placed == Counter(histogram)
    runs = packing.places(patterns)
    assert (np.diff(runs["length"]) >= 0).all()
