"""Token counts of whole texts by a whole-token shortcut.

Offline, every vocabulary string that ends a word is put through the tokenizer's own merges; those
that come out as one token are whole tokens. A pre-token that is one counts 1 without any merge,
only the other pre-tokens are merged.

Defined results: a null or empty text has no bytes and no tokens; repeated rows give repeated
results; rows without a doc_id take no part; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketline.llm.common import documents
from basketline.llm.text import pieces, slices
from basketline.llm.tokens import CACHE_PIECES, WordForm, load, text_bytes

# The pre-token pattern of the tokenizer for text in lower-case ASCII letters.
ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
WORD_END = "</w>"

_whole: dict[str, frozenset[str]] = {}  # by tokenizer file, once for each worker


def whole_tokens(tokenizer) -> frozenset[str]:
    """Strings that the merges turn into exactly one token."""
    strings = (s.removesuffix(WORD_END) for s in tokenizer.get_vocab(with_added_tokens=False) if s.endswith(WORD_END))
    return frozenset(s for s in strings if s and len(tokenizer.model.tokenize(s)) == 1)


class PieceCounts:
    """Tokens of pieces between white space, with a bounded memory of pieces and pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        if path not in _whole:
            _whole[path] = whole_tokens(self.tokenizer)
        self.single = _whole[path]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.form = WordForm(self.tokenizer)
        self.pieces: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def pretoken(self, s: str) -> int:
        if s in self.single:
            return 1
        if s not in self.merged:
            self.merged[s] = len(self.tokenizer.model.tokenize(s))
        return self.merged[s]

    def piece(self, s: str) -> int:
        word = self.form(s)
        if word is not None:
            return self.pretoken(word)
        if any(x in s for x in self.special):
            return len(self.tokenizer.encode(s, add_special_tokens=False).ids)
        if s.isascii() and s.isprintable():
            return sum(map(self.pretoken, ASCII_PRETOKEN.findall(s.lower())))
        plain = self.tokenizer.normalizer.normalize_str(s)
        return sum(self.pretoken(x) for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain))

    def count(self, texts: pa.Array) -> np.ndarray:
        first, cut = pieces(texts)
        coded = cut.dictionary_encode()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces, self.merged = {}, {}
        known, per = self.pieces, []
        for s in coded.dictionary.to_pylist():
            s = s.strip(" \t\n\r\v\f")
            n = known.get(s)
            if n is None:
                n = known[s] = self.piece(s)
            per.append(n)
        total = np.append(0, np.cumsum(np.array(per, np.int64)[coded.indices.to_numpy()]))
        return np.diff(total[first])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounts(tokenizer_path)  # what it remembers goes with the task
        for batch in batches:
            for rows, texts in slices(batch):
                n = counter.count(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_bytes": text_bytes(texts), "n_tokens": n,
                                                  "over_limit": n > limit})

    return documents(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
