"""Token ids of whole texts: pieces are encoded once and looked up afterwards.

Neither tokenizer here joins a pre-token across white space, or an ASCII letter with the point or
comma after it, so a text's ids are those of its pieces in order. The one exception, white space
outside ASCII next to a piece's edge, is found by piece, and such a text is encoded as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from basketline.llm.text import pieces

CACHE_PIECES = 400_000  # pieces that a worker remembers before it starts anew
OTHER_SPACE = re.compile(r"[^\S \t-\r]")
LATIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)")  # letters that lower-case to one letter

# The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
BYTE_ALPHABET = {b: 256 + k for k, b in enumerate(_HIDDEN)}
SPACE_FORM = chr(BYTE_ALPHABET[32])

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a .json file, once for each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def byte_form(s: str) -> str:
    if s.isascii() and s.isprintable():
        return s.replace(" ", SPACE_FORM)
    return s.encode().decode("latin-1").translate(BYTE_ALPHABET)


class WordForm:
    """The one pre-token of a piece that is a Latin word, found without the library; None for other pieces."""

    def __init__(self, tokenizer):
        plain = tokenizer.normalizer.normalize_str(" Ab") if tokenizer.normalizer else " Ab"
        shape = "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(plain))
        self.lowers, self.spaced = shape.endswith("ab"), len(shape) == 3

    def __call__(self, piece: str) -> str | None:
        found = LATIN.fullmatch(piece)
        if found is None:
            return None
        word = piece if self.spaced else found[2]
        return byte_form(word.lower() if self.lowers else word)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceIds:
    """The ids of texts under one tokenizer, with a bounded memory of pieces."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.form = WordForm(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.whole = np.zeros(1024, bool)
        self.starts = np.zeros(1025, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def _learn(self, new: list[str]) -> None:
        n, k = len(self.slots), len(new)
        ids: list = [None] * k
        tokenize = self.tokenizer.model.tokenize
        rest = []
        for i, piece in enumerate(new):
            word = self.form(piece)
            if word is None:
                rest.append(i)
            else:
                ids[i] = [t.id for t in tokenize(word)]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)):
            ids[i] = found.ids
        if n + k + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + k) + 1)
            self.whole = np.resize(self.whole, 2 * (n + k))
        self.starts[n + 1:n + k + 1] = self.starts[n] + np.cumsum([len(x) for x in ids])
        if self.starts[n + k] > len(self.pool):
            self.pool = np.resize(self.pool, 2 * int(self.starts[n + k]))
        flat = [i for x in ids for i in x]
        self.pool[self.starts[n]:self.starts[n + k]] = flat
        self.whole[n:n + k] = False
        self.whole[[n + i for i in rest if OTHER_SPACE.search(new[i])]] = True
        self.slots.update(zip(new, range(n, n + k)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start of each text's ids, one more than texts; all ids)."""
        first, cut = pieces(texts)
        coded = cut.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slots) + len(words) > CACHE_PIECES:
            self.forget()
        new = [x for x in words if x not in self.slots]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        lengths = self.starts[slot + 1] - self.starts[slot]
        ids = self.pool[ranges(self.starts[slot], lengths)]
        bounds = np.append(0, np.cumsum(lengths))[first]
        odd = np.flatnonzero(self.whole[slot])
        if len(odd):
            rows = np.unique(np.searchsorted(first, odd, "right") - 1)
            parts = np.split(ids, bounds[1:-1])
            for row in rows:
                parts[row] = np.array(self.tokenizer.encode(texts[int(row)].as_py(), add_special_tokens=False).ids, np.uint32)
            bounds = np.append(0, np.cumsum([len(x) for x in parts]))
            ids = np.concatenate(parts)
        return bounds, ids


def with_end(bounds: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return bounds + np.arange(len(bounds)), np.insert(ids, bounds[1:], end_id)


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
