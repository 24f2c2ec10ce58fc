"""Language identification with interpolated Kneser-Ney character models.

Words are runs of letters, lower-cased; a model predicts each letter, and the end of the word, from
up to three letters before it in the word. Counts of four-letter windows are gathered by Spark from
a sample of the labelled documents (about `sample_rows` for each language, by a hash of doc_id;
whole texts), and the lower orders use continuation counts, each order with its own discount. The
model is kept as one sorted array of 64-bit window hashes for each order, with one column of
log-probabilities for each language.

A text's cross-entropy is its mean cost by letter; the language with the lowest wins, and ties go
to the first language by name. For rejection, each line, or window of `WINDOW` pieces of it, is costed in its own best
language, so that a text that mixes learned languages costs no more than one of each. The limits are
calibrated on labelled documents that the model did not see, whole and cut short: for each language,
the middle, the spread by length and a quantile of the distance in spreads give a limit for texts of
any length, and what lies above it is rejected. A language with few such documents has the limit of
all languages; if there is none, what costs more than letters drawn evenly is rejected.

Defined results: a null text, or one without a letter, is `und`, score 0 and rejected; if nothing
is labelled, every text is `und`; equal texts have equal results; rows without a doc_id take no
part; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import id_fold
from basketline.llm.text import mix, pieces, slices, text_slices

ORDER = 4
SAMPLE_ROWS = 1500     # labelled documents of a language that its model is fitted on, about
MAX_LANGUAGES = 1000   # the most frequent languages are learned
HELD_OUT, CALIBRATION = 0, 1  # folds of the id that are not learned from, and that the limits are set on
WINDOW = 8             # pieces of a line that are costed in one language
CUTS, LEAST_LETTERS = (8, 32, 128), 20  # pieces that calibration texts are cut to, and letters that are left at least
QUANTILE, MARGIN = 0.99, 3.0  # the limit is MARGIN times as far from the middle as this quantile, in spreads
LEAST_SPREADS, MOST_SPREADS = 10.0, 25.0
LEAST_ROWS = 10        # calibration texts of a language, below which it has the limit of all languages
UNKNOWN = "und"
CACHE_PIECES = 250_000


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(item of each prediction, the symbol with the ORDER - 1 before it); 0 stands for a word's edge."""
    joined = "\n".join(words).lower() + "\n"
    symbols = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    item = np.cumsum(symbols == 10)
    item -= symbols == 10
    known, place = np.unique(symbols, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in known], bool)[place]
    symbols = np.where(letter, symbols, 0)
    before = np.zeros((len(symbols), ORDER), np.int64)
    before[:, 0] = symbols
    for k in range(1, ORDER):
        before[1:, k] = before[:-1, k - 1]
        if k > 1:
            before[before[:, k - 1] == 0, k] = 0
    wanted = letter | (before[:, 1] != 0)
    return item[wanted], before[wanted]


def hashes(before: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last `order` symbols of each window."""
    out = np.full(len(before), order, np.uint64)
    for k in range(order):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + before[:, k].astype(np.uint64))
    return out


def context_hashes(before: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` - 1 symbols before the predicted one."""
    return hashes(before[:, 1:], order - 1) + np.uint64(1)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]      # for orders 1..ORDER: sorted hashes
    costs: list[np.ndarray]      # (grams, languages): -log2 of the interpolated probability
    contexts: list[np.ndarray]   # for orders 2..ORDER: sorted hashes of contexts
    backoffs: list[np.ndarray]   # (contexts, languages): -log2 of the weight of the lower order
    unseen: np.ndarray           # (languages): cost of a symbol that no language has
    limits: np.ndarray | None = None  # (languages, 4), see limit_at()

    def cost(self, before: np.ndarray) -> np.ndarray:
        """(windows, languages) costs in bits."""
        total = np.zeros((len(before), len(self.languages)), np.float32)
        open_rows = np.arange(len(before))
        for order in range(ORDER, 0, -1):
            rest = before[open_rows]
            at, found = _find(self.grams[order - 1], hashes(rest, order))
            total[open_rows[found]] += self.costs[order - 1][at[found]]
            open_rows, rest = open_rows[~found], rest[~found]
            if order > 1:
                at, found = _find(self.contexts[order - 2], context_hashes(rest, order))
                total[open_rows[found]] += self.backoffs[order - 2][at[found]]
        total[open_rows] += self.unseen
        return total


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def kneser_ney(languages: list[str], language: np.ndarray, before: np.ndarray, counts: np.ndarray) -> Model:
    """Fit all orders from the counts of full windows by language."""
    n_lang = len(languages)
    full, place = np.unique(before, axis=0, return_inverse=True)
    table = np.zeros((len(full), n_lang))
    np.add.at(table, (place.ravel(), language), counts)
    symbols = len(np.unique(full[:, 0])) + 1
    levels = []  # (windows, counts by language), from the highest order down
    for order in range(ORDER, 0, -1):
        levels.append((full, table))
        if order > 1:
            full, place = np.unique(full[:, :order - 1], axis=0, return_inverse=True)
            below = np.zeros((len(full), n_lang))
            np.add.at(below, place.ravel(), table > 0)
            table = below
    grams, costs, contexts, backoffs = [], [], [], []
    lower = np.full((1, n_lang), 1.0 / symbols)
    for order, (rows, table) in enumerate(reversed(levels), 1):
        ones, twos = (table == 1).sum(0), (table == 2).sum(0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
        context, place = np.unique(rows[:, 1:], axis=0, return_inverse=True) if order > 1 else (np.zeros((1, 0), np.int64), np.zeros(len(rows), np.int64))
        place = place.ravel()
        sums, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
        np.add.at(sums, place, table)
        np.add.at(kinds, place, table > 0)
        weight = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        own = np.where(sums[place] > 0, np.maximum(table - discount, 0) / np.maximum(sums[place], 1), 0.0)
        if order == 1:
            probability = own + weight * lower
            unseen = -np.log2(weight[0] * lower[0])
        else:
            shorter = _match(previous, rows[:, :order - 1])
            probability = own + weight[place] * lower[shorter]
            keys = context_hashes(rows, order)
            keys, first = np.unique(keys, return_index=True)
            contexts.append(keys)
            backoffs.append(-np.log2(weight[place[first]]).astype(np.float32))
        keys = hashes(rows, order)
        sort = np.argsort(keys)
        grams.append(keys[sort])
        costs.append(-np.log2(probability[sort]).astype(np.float32))
        lower, previous = probability, rows
    return Model(languages, grams, costs, contexts, backoffs, unseen.astype(np.float32))


def _match(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row of each of `rows` in `table`, which holds them all."""
    both = np.unique(np.concatenate([table, rows]), axis=0, return_inverse=True)[1].ravel()
    place = np.empty(both.max() + 1, np.int64)
    place[both[:len(table)]] = np.arange(len(table))
    return place[both[len(table):]]


class Scorer:
    """Costs of texts under a model, with a bounded memory of pieces."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.costs = np.zeros((1024, len(self.model.languages) + 1))

    def texts(self, texts: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(predictions in each text, (texts, languages) mean costs in bits, mean costs with the best language of each window).

        With `most`, of the first pieces of each text only.
        """
        first, cut = pieces(texts)
        coded = cut.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slots) + len(words) > CACHE_PIECES:
            self.forget()
        new = [w for w in words if w not in self.slots]
        if new:
            n, k = len(self.slots), len(new)
            item, before = windows([w.strip().replace("\n", " ") for w in new])
            cost = self.model.cost(before)
            if n + k > len(self.costs):
                self.costs = np.resize(self.costs, (2 * (n + k), self.costs.shape[1]))
            for j in range(cost.shape[1]):
                self.costs[n:n + k, j] = np.bincount(item, cost[:, j], k)[:k]
            self.costs[n:n + k, -1] = np.bincount(item, minlength=k)[:k]
            self.slots.update(zip(new, range(n, n + k)))
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        held = np.diff(first) if most is None else np.minimum(np.diff(first), most)
        text, at = np.repeat(np.arange(len(texts)), np.diff(first)), np.arange(len(slot))
        line = np.array(["\n" in w for w in words], bool)[coded.indices.to_numpy()] | (at == first[text])
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(line, at, 0))) % WINDOW == 0)
        stops = np.append(starts[1:], len(slot))
        text = text[starts]
        used = starts < (first[:-1] + held)[text]
        starts, text = starts[used], text[used]
        stops = np.minimum(stops[used], (first[:-1] + held)[text])
        total = np.zeros((len(texts), self.costs.shape[1]))
        least = np.full(len(text), np.inf)
        for j in range(total.shape[1]):
            upto = np.append(0.0, np.cumsum(self.costs[slot, j]))
            total[:, j] = upto[first[:-1] + held] - upto[first[:-1]]
            if j < total.shape[1] - 1:
                least = np.minimum(least, upto[stops] - upto[starts])
        n = np.rint(total[:, -1]).astype(np.int64)
        return n, total[:, :-1] / np.maximum(n, 1)[:, None], np.bincount(text, least, len(texts)) / np.maximum(n, 1)


def spread_at(limits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sqrt(limits[..., 1] ** 2 / np.maximum(n, 1) + limits[..., 2] ** 2)


def limit_at(limits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The highest accepted cost for n predictions, given rows (middle, spread at one prediction, spread of long texts, accepted spreads)."""
    return limits[..., 0] + limits[..., 3] * spread_at(limits, n)


def sampled(docs: DataFrame, sample_rows: int) -> tuple[list[str], DataFrame]:
    """(languages by name, rows lang, fold, text of the labelled sample)."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.withColumn("fold", id_fold()).where(F.col("fold") != HELD_OUT)
    per = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES).collect()
    if not per:
        return [], usable
    share = F.create_map(*[F.lit(x) for r in per for x in (r["lang"], min(1.0, sample_rows / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return sorted(r["lang"] for r in per), usable.where(draw < share[F.col("lang")]).select("lang", "fold", "text")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the labelled rows outside the held-out fold, with its limits."""
    languages, sample = sampled(docs, sample_rows)
    if not languages:
        return None
    names = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                spoken = rows.column("lang").to_pylist()
                for language in sorted(set(spoken)):
                    _, cut = pieces(texts.filter(pa.array([x == language for x in spoken])))
                    coded = cut.dictionary_encode()
                    times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    item, before = windows([w.strip().replace("\n", " ") for w in coded.dictionary.to_pylist()])
                    _, first, place = np.unique(hashes(before, ORDER), return_index=True, return_inverse=True)
                    n = np.bincount(place, times[item], len(first)).astype(np.int64)
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), names[language])), *(pa.array(c) for c in before[first].T), pa.array(n)],
                                                         names=["language", *(f"s{k}" for k in range(ORDER)), "n"])

    keys = ["language", *(f"s{k}" for k in range(ORDER))]
    schema = ", ".join(f"{c} bigint" for c in [*keys, "n"])
    counted = (sample.where(F.col("fold") != CALIBRATION).mapInArrow(count, schema)
               .groupBy(*keys).agg(F.sum("n").alias("n")).toArrow())  # bounded by the sample
    columns = [counted[c].to_numpy() for c in counted.column_names]
    if not len(columns[0]):
        return None
    model = kneser_ney(languages, columns[0], np.column_stack(columns[1:-1]), columns[-1])

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for rows, texts in slices(batch):
                n, cost, mixed = scorer.texts(texts)
                best, right = cost.argmin(1), np.array([names[x] for x in rows.column("lang").to_pylist()])
                use = (n > 0) & (best == right)
                yield _rows(best[use], n[use], mixed[use], True)
                for most in CUTS:
                    some, _, mixed = scorer.texts(texts, most)
                    cut = use & (some >= LEAST_LETTERS) & (some < n)
                    yield _rows(best[cut], some[cut], mixed[cut], False)

    seen = (sample.where(F.col("fold") == CALIBRATION).mapInArrow(calibrate, "language bigint, n bigint, cost double, whole boolean")
            .toArrow())  # bounded by the sample
    language, n, cost, whole = (seen[c].to_numpy() for c in ("language", "n", "cost", "whole"))
    even = (float(np.log2(len(model.grams[0]) + 1)), 0.0, 0.0, 0.0)
    together = _limits(n, cost, whole) if whole.any() else even
    own = [language == k for k in range(len(languages))]
    model.limits = np.array([_limits(n[k], cost[k], whole[k]) if whole[k].sum() >= LEAST_ROWS else together for k in own])
    return model


def _rows(language: np.ndarray, n: np.ndarray, cost: np.ndarray, whole: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"language": pa.array(language), "n": pa.array(n), "cost": pa.array(cost), "whole": pa.array(np.full(len(n), whole))})


def _limits(n: np.ndarray, cost: np.ndarray, whole: np.ndarray) -> tuple[float, float, float, float]:
    """A row for limit_at(): middle and spreads are those of whole texts, their number of cut ones too."""
    middle = float(np.median(cost[whole]))
    away = np.abs(cost[whole] - middle)
    short = float(np.median(away * np.sqrt(n[whole]))) * 1.4826
    row = np.array([middle, max(short, 1.0), float(np.median(away)) * 1.4826])
    far = float(np.quantile((cost - middle) / spread_at(row, n), QUANTILE))
    return *map(float, row), float(np.clip(MARGIN * far, LEAST_SPREADS, MOST_SPREADS))


def judged(scorer: Scorer | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, rejected, bits) of each text."""
    if not scorer:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
    n, cost, mixed = scorer.texts(texts)
    best, bits = cost.argmin(1), cost.min(1)
    gap = (bits[:, None] - cost) * np.log(2) * np.minimum(n, 50)[:, None]
    score = np.where(n > 0, 1 / np.exp(gap).sum(1), 0.0)
    rejected = (n == 0) | (mixed > limit_at(scorer.model.limits[best], n))
    return [scorer.model.languages[b] if k else UNKNOWN for b, k in zip(best, n)], score, rejected, bits


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, bits (mean cost) of every document, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kept = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), id_fold().alias("fold"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            for rows, texts in slices(batch):
                language, score, rejected, bits = judged(scorer, texts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "held_out": pa.array(rows.column("fold").to_numpy() == HELD_OUT),
                    "lang_pred": pa.array(language, pa.string()), "score": pa.array(score), "rejected": pa.array(rejected), "bits": pa.array(bits)})

    return kept.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean, bits double")


def accepted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are not rejected, with all their columns; only texts go through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_rows))  # bounded by the sample

    @F.arrow_udf("boolean")
    def accepts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            yield pa.array(np.concatenate([~judged(scorer, texts)[2] for texts in text_slices(batch)] or [np.zeros(0, bool)]))

    return docs.where(F.col("doc_id").isNotNull()).where(accepts(F.col("text").cast("string")))
