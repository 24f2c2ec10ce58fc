"""Language-model scores from class-based bigrams (Brown classes by exchange clustering).

Seeds are units: a frequent word itself, else its last two bytes if they are one of the most frequent
endings, else "other"; the end of a text is a unit too. Bigrams of units are counted over all training
texts, so their matrix is bounded whatever the corpus. The exchange algorithm moves one unit at a time
to the class that raises the likelihood of the class bigrams most, until none moves.

Then each word of the training texts is exchanged by itself, on Spark: from the class of its unit to
the one that raises the likelihood most, given the classes beside all its occurrences, if by more than
it costs to name a class. All words are moved at once, each against the bigrams of the units' classes.
Only words that no training text has are left with the class of their ending.

A text's probability is the product over its tokens of

    P(class | class before) * P(word | class)

where the transition, counted over all training texts in their words' own classes, is smoothed towards
the class's own frequency and the emission adds 0.5 to each count, one unseen word for each class.

Counts and classes of all words are needed to score any text. Texts come in blocks; a block asks for
those of its own words only, which a join brings back, so no task holds the vocabulary. A frequent word is
asked for once by each block. Words are told apart by 64-bit hashes.

Defined results: a null or empty text is its end token alone; without training texts N and V are 0
and all tokens unknown; repeated rows count each; rows without a doc_id take no part; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import documents, id_fold, written
from basketline.llm.text import raw, slices, words_with_tails

HELD_OUT = 1
WORD_UNITS, TAIL_UNITS, CLASSES = 600, 400, 40
SWEEPS = 15
BLOCKS = 64  # blocks by hash of doc_id, where the caller names none
TAILS = 1 << 16
ADDED, TRANSITION_WEIGHT = 0.5, 2.0
CELLS = 2 * CLASSES  # classes before and classes after a word
NAMING = float(np.log(CLASSES - 1))  # what a word's move has to gain
TOKENS = 1 << 19  # whose neighbours are counted at once in a task


@dataclass
class Units:
    """Unit numbers: words in the order of their hashes, tails, other, end."""

    words: np.ndarray   # sorted hashes
    tails: np.ndarray   # unit of each of the 65536 tails

    @property
    def end(self) -> int:
        return WORD_UNITS + TAIL_UNITS + 1

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        unit = self.tails[tails]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            unit = np.where(self.words[at] == hashes, at, unit)
        return unit


UNITS = WORD_UNITS + TAIL_UNITS + 2
OTHER = WORD_UNITS + TAIL_UNITS


@dataclass
class ClassModel:
    units: Units
    of_unit: np.ndarray      # class of each unit
    between: np.ndarray      # (class before, class): count
    tokens: int              # N
    types: int               # V
    ends: int                # count of the end token

    @property
    def share(self) -> np.ndarray:
        return (self.between.sum(0) + ADDED) / (self.between.sum() + ADDED * CLASSES)

    @property
    def transition(self) -> np.ndarray:
        """(class before, class): log10 probability."""
        return np.log10((self.between + TRANSITION_WEIGHT * self.share) / (self.between.sum(1, keepdims=True) + TRANSITION_WEIGHT))

    def classes(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        return self.of_unit[self.units.of(hashes, tails)]


def word_rows(docs: DataFrame) -> DataFrame:
    """w, tail, n: words of the training texts with their counts by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                _, hashes, tails = words_with_tails(texts)
                known, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(tails[first]), pa.array(n)], names=["w", "tail", "n"])

    return docs.where(F.col("fold") != HELD_OUT).select("text").mapInArrow(run, "w bigint, tail bigint, n bigint")


def unit_bigrams(docs: DataFrame, units: Units) -> np.ndarray:
    """How often a unit follows a unit in the training texts; each text starts after an end. UNITS * UNITS cells at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                first, hashes, tails = words_with_tails(texts)
                line = np.insert(units.of(hashes, tails), first[1:], units.end)
                before = np.append(units.end, line[:-1])
                cells += np.bincount(before * UNITS + line, minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    rows = (docs.where(F.col("fold") != HELD_OUT).select("text").mapInArrow(run, "cell bigint, n bigint")
            .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(UNITS * UNITS, np.float64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, fixed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units by frequency start in turn in the classes; `fixed` stays alone in the last class."""
    count = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-count, kind="stable") if u != fixed]
    of = np.zeros(len(bigrams), np.int64)
    of[order] = np.arange(len(order)) % (classes - 1)
    of[fixed] = classes - 1
    hot = np.eye(classes)[of]
    between = hot.T @ bigrams @ hot
    size_out, size_in = between.sum(1), between.sum(0)
    free = np.arange(classes) < classes - 1
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not count[u]:
                continue
            a, own = of[u], bigrams[u, u]
            row = np.bincount(of, bigrams[u], classes)
            column = np.bincount(of, bigrams[:, u], classes)
            row[a] -= own
            column[a] -= own
            out, into = row.sum() + own, column.sum() + own
            between[a] -= row
            between[:, a] -= column
            between[a, a] -= own
            size_out[a] -= out
            size_in[a] -= into
            with_row, with_column = between + row, between.T + column  # class k in line k
            gain = _plogp(with_row).sum(1) - _plogp(between).sum(1) + _plogp(with_column).sum(1) - _plogp(between).sum(0)
            diagonal = np.diag(between)
            gain += (_plogp(diagonal + row + column + own) + _plogp(diagonal)
                     - _plogp(diagonal + row) - _plogp(diagonal + column))
            gain -= _plogp(size_out + out) - _plogp(size_out) + _plogp(size_in + into) - _plogp(size_in)
            gain[~free] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-6:
                best = a
            moved += best != a
            of[u] = best
            between[best] += row
            between[:, best] += column
            between[best, best] += own
            size_out[best] += out
            size_in[best] += into
        if not moved:
            break
    return of


def fit(docs: DataFrame, words: DataFrame) -> ClassModel:
    """The model of the units of the training texts; `words` has the count of every word (w, tail, n)."""
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = docs.where(F.col("fold") != HELD_OUT).count()
    top = words.orderBy(F.col("n").desc(), "w").limit(WORD_UNITS).select("w", "tail", "n").toArrow()
    by_tail = words.groupBy("tail").agg(F.sum("n").alias("n")).toArrow()  # TAILS rows at most
    tail_n = np.zeros(TAILS, np.int64)
    tail_n[by_tail["tail"].to_numpy()] = by_tail["n"].to_numpy()
    np.subtract.at(tail_n, top["tail"].to_numpy(), top["n"].to_numpy())
    chosen = np.argsort(-tail_n, kind="stable")[:TAIL_UNITS]
    of_tail = np.full(TAILS, OTHER)
    of_tail[chosen] = WORD_UNITS + np.arange(len(chosen))
    units = Units(np.sort(top["w"].to_numpy().view(np.uint64)), of_tail)

    bigrams = unit_bigrams(docs, units)
    of = exchange(bigrams, CLASSES, units.end)
    hot = np.eye(CLASSES)[of]
    return ClassModel(units, of, hot.T @ bigrams @ hot, int(tokens) + ends, int(types) + (ends > 0), ends)


def neighbour_rows(docs: DataFrame, model: ClassModel) -> DataFrame:
    """w, v: how often a word of the training texts has a class of units before or after it, by task.

    v is (count * CLASSES + the class of the word's own unit) * CELLS + cell.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by UNITS and TAILS

    def counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, own, left, right = (np.concatenate(x) for x in zip(*held))
        known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        cells, n = np.unique(np.concatenate([place * CELLS + left, place * CELLS + CLASSES + right]), return_counts=True)
        word = cells // CELLS
        return pa.RecordBatch.from_arrays([pa.array(known[word].view(np.int64)), pa.array((n * CLASSES + own[first][word]) * CELLS + cells % CELLS)], names=["w", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = shared.value, []
        end = model.of_unit[model.units.end]
        for batch in batches:
            for _, texts in slices(batch):
                first, hashes, tails = words_with_tails(texts)
                own = model.classes(hashes, tails)
                line = np.concatenate([[end], np.insert(own, first[1:], end)])
                at = 1 + np.arange(len(own)) + np.repeat(np.arange(len(texts)), np.diff(first))
                held.append((hashes, own, line[at - 1], line[at + 1]))
                if sum(len(h[0]) for h in held) > TOKENS:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    return docs.where(F.col("fold") != HELD_OUT).select("text").mapInArrow(run, "w bigint, v bigint")


def word_classes(docs: DataFrame, model: ClassModel) -> DataFrame:
    """w, n, c: count and class of every word of the training texts."""
    log = model.transition * np.log(10)
    gain = np.concatenate([log - np.log(model.share), log.T])  # of an occurrence in each class, by the class before and after
    shared = docs.sparkSession.sparkContext.broadcast((model.units.words, gain))

    def chosen(w: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        seeds, gain = shared.value
        new = np.append(True, w[1:] != w[:-1])
        first = np.flatnonzero(new)
        counts = np.bincount((np.cumsum(new) - 1) * CELLS + v % CELLS, v // (CELLS * CLASSES), len(first) * CELLS).reshape(-1, CELLS)
        own = v[first] // CELLS % CLASSES
        score = np.round(counts @ gain, 6)
        score[:, CLASSES - 1] = -np.inf
        best, line = score.argmax(1), np.arange(len(first))
        moves = score[line, best] > score[line, own] + NAMING
        if len(seeds):
            known = w[first].view(np.uint64)
            moves &= seeds[np.minimum(np.searchsorted(seeds, known), len(seeds) - 1)] != known
        n = counts[:, :CLASSES].sum(1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(n), pa.array(np.where(moves, best, own).astype(np.int8))], names=["w", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            w, v = np.append(w, batch.column("w").to_numpy()), np.append(v, batch.column("v").to_numpy())
            whole = int(np.searchsorted(w, w[-1])) if len(w) else 0  # the last word may go on in the next batch
            if whole:
                yield chosen(w[:whole], v[:whole])
                w, v = w[whole:], v[whole:]
        if len(w):
            yield chosen(w, v)

    return neighbour_rows(docs, model).repartition("w").sortWithinPartitions("w").mapInArrow(run, "w bigint, n bigint, c tinyint")


def class_bigrams(lines: DataFrame) -> np.ndarray:
    """How often a class follows a class in training texts, given the classes of their tokens as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            _, line = raw(batch.column("line"))
            # each text starts after an end, which is the last token of the text before
            before = np.append(CLASSES - 1, line[:-1].astype(np.int64))
            cells += np.bincount(before * CLASSES + line, minlength=len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = (lines.where("NOT held_out").select("line").mapInArrow(run, "cell bigint, n bigint")
            .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(CLASSES * CLASSES)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def score(docs: DataFrame, block: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    `block` names the block of a row: the rows of one block must fit into a task. Rows that lie
    together anyway, as those of one input split, ask for fewer words than rows by hash.
    """
    block = F.xxhash64(block) if block is not None else F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS))
    docs = docs.withColumn("_block", block)
    docs = documents(docs, "_block").withColumn("fold", id_fold())
    words = written(word_rows(docs).groupBy("w").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "word-counts")
    model = fit(docs, words)
    words = written(word_classes(docs, model), "word-classes")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by UNITS and TAILS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for rows, texts in slices(batch):
                first, hashes, _ = words_with_tails(texts)
                names = rows.column("_block").to_numpy()
                for name in np.unique(names).tolist():
                    seen = asked.setdefault(name, [])
                    seen.append(np.unique(hashes[np.repeat(names == name, np.diff(first))]))
                    if sum(map(len, seen)) > 4 * len(seen[0]) + 200_000:
                        asked[name] = [np.unique(np.concatenate(seen))]
        for name, seen in asked.items():
            known = np.unique(np.concatenate(seen)).view(np.int64)
            for k in range(0, len(known), 1 << 16):
                part = known[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(part)], names=["_block", "w"])

    asked = docs.select("_block", "text").mapInArrow(ask, "_block bigint, w bigint")
    answers = asked.join(words, "w")

    def classed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value
        known, counts, own = right["w"].to_numpy().view(np.uint64), right["n"].to_numpy(), right["c"].to_numpy()
        order = np.argsort(known)
        known, counts, own = known[order], counts[order], own[order]
        every = model.tokens + ADDED * (model.types + 1)
        end_count = np.array([model.ends])
        out = []
        for batch in left.to_batches():
            for rows, texts in slices(batch):
                first, hashes, tails = words_with_tails(texts)
                c, group = np.zeros(len(hashes), np.int64), model.classes(hashes, tails)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    seen = known[at] == hashes
                    c, group = np.where(seen, counts[at], 0), np.where(seen, own[at], group)
                c, group = np.insert(c, first[1:], end_count), np.insert(group, first[1:], CLASSES - 1).astype(np.uint8)
                first = first + np.arange(len(first))
                add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  a text has its end at least
                line = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(group)])
                out.append(pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "held_out": pa.array(rows.column("fold").to_numpy() == HELD_OUT),
                    "n_tokens": pa.array(np.diff(first)), "n_known": pa.array(add((c > 0).astype(np.int64))),
                    "base_score": pa.array(add(np.log10((c + ADDED) / every))), "counts": pa.array(add(np.log10(c + ADDED))), "line": line.cast(pa.binary())}))
        return pa.Table.from_batches(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("counts", pa.float64()), ("line", pa.binary())])
    lines = written(docs.select("_block", "doc_id", "fold", "text").groupBy("_block").cogroup(answers.groupBy("_block"))
                    .applyInArrow(classed, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                           "base_score double, counts double, line binary"), "class-lines")

    final = replace(model, between=class_bigrams(lines))
    sizes, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        sizes[r["c"]], kinds[r["c"]] = r["n"], r["kinds"]
    sizes[CLASSES - 1] += model.ends
    cost = final.transition - np.log10(sizes + ADDED * (kinds + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, line = raw(batch.column("line"))
            if len(line):
                before = np.append(CLASSES - 1, line[:-1])
                sums = np.add.reduceat(cost[before, line], first[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(batch.column("counts").to_numpy() + sums)], names=[*kept, "score"])

    kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    return (lines.mapInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"))


def input_split() -> Column:
    """The block of rows that one read task gets from a file."""
    return F.concat_ws("@", F.input_file_name(), F.input_file_block_start().cast("string"))
