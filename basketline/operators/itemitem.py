"""Item-item collaborative filtering over the whole catalogue, or its n most popular articles.

Co-occurrence is counted sparsely: each task counts the pairs of its customers' baskets in bounded
batches, and only counted cells are shuffled. No task holds a matrix of the catalogue and nothing
comes back to the driver; a large basket is cut into slices that are counted in different tasks.

Lists are a sparse product by slices of the catalogue. An article that few customers hold is scored with their
baskets, which give its similarity row; only the others have a similarity row of their own. Baskets and rows are
written once, cut into slices of columns. A block of customers, packed with the numbers of the customers that hold
their articles, meets every slice in a cartesian product, which reads the written slices and shuffles nothing. A
customer keeps the k best columns of a slice, and lists are merged from these: no row per (customer, owned article,
neighbour) exists, and what goes to disk doesn't grow with the number of blocks times the baskets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.functions import blocks
from basketline.functions.ids import dense_index, numbered
from basketline.functions.lists import to_lists
from basketline.operators.popularity import K, article_counts, count_order
from basketline.session import materialize, release, spread

PAIR_COLUMNS = 1024  # of a basket, paired with the rest of it in one go
BUCKET_ARTICLES = 64  # whose pairs are added up in one group
HELD, ROW = 0, 1  # kinds of entries of a slice: of a customer's basket, of an article's similarity row
LIGHT_CUSTOMERS = 1024  # at most, of an article that is scored with its customers' baskets
ROW_COLUMNS = 8192  # a similarity row is cut at multiples of it
BASKET_COLUMNS = 4096  # of a basket, scored in one block
BLOCK_COLUMNS = 1 << 18  # basket entries of a block of customers
ARTICLE_BLOCK = 1 << 20  # basket entries of a block of articles
SLICE_ENTRIES = 1 << 22  # of baskets in a slice of the catalogue; an entry of a similarity row counts for three


def catalogue(history: DataFrame, n_items: int | None = None) -> DataFrame:
    """(article_id, col): articles numbered 0.. in popularity order, all of them or the n best sellers."""
    counts = article_counts(history)
    if n_items is None:
        return dense_index(counts.select((-F.col("cnt")).alias("less"), "article_id"), ["less", "article_id"], "col").drop("less")
    w = Window.orderBy(*count_order())  # at most n_items rows
    return counts.orderBy(*count_order()).limit(n_items).select("article_id", (F.row_number().over(w) - 1).cast("bigint").alias("col"))


def interactions(history: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (customer_id, article_id, col) over the catalogue."""
    return history.select("customer_id", "article_id").distinct().join(items, "article_id").select("customer_id", "article_id", "col")


def weighted_interactions(history: DataFrame) -> DataFrame:
    """Purchase counts per (customer, article) over the full catalogue."""
    return history.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("weight"))


def baskets(pairs: DataFrame) -> DataFrame:
    """(customer_id, cols): the sorted columns of each customer, at most n."""
    return pairs.groupBy("customer_id").agg(F.sort_array(F.collect_set("col")).alias("cols"))


def sliced(customer_baskets: DataFrame, columns: int, *more: str | Column) -> DataFrame:
    """customer_id, part, own, ...: each basket in slices of at most `columns` columns."""
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("cols") / columns).cast("int") - 1),
                        lambda p: F.slice("cols", p * columns + 1, columns))
    return customer_baskets.select("customer_id", *more, F.posexplode(parts).alias("part", "own"))


def cooccurrence(customer_baskets: DataFrame, columns: int = PAIR_COLUMNS) -> DataFrame:
    """(a, b, together) for a <= b: customers holding both columns."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = ((np.asarray(own, np.int64), np.asarray(rest, np.int64)) for own, rest in zip(batch["own"], batch["rest"]))
            for a, b, n in blocks.pair_counts(pairs):
                yield pd.DataFrame({"a": a, "b": b, "together": n})

    rest = F.slice("cols", F.col("part") * columns + 1, F.size("cols")).alias("rest")  # from the slice's first column on
    halves = sliced(customer_baskets, columns, "cols").select("own", rest)
    partial = spread(halves).mapInPandas(count, "a bigint, b bigint, together bigint")
    return partial.groupBy("a", "b").agg(F.sum("together").alias("together"))


def cosine(together: DataFrame) -> DataFrame:
    """(a, b, sim) for a <= b: together / sqrt(n_a * n_b). The diagonal stays in."""
    sizes = together.filter("a = b").select(F.col("a").alias("item"), F.col("together").alias("n"))
    left = sizes.select(F.col("item").alias("a"), F.col("n").alias("n_a"))
    right = sizes.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
    sim = F.col("together") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b"))
    return together.join(left, "a").join(right, "b").select("a", "b", sim.alias("sim"))


def both_ways(upper: DataFrame) -> DataFrame:
    """A symmetric table out of its upper half."""
    return upper.unionByName(upper.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def similarity_rows(customer_baskets: DataFrame, n_items: int, columns: int = ROW_COLUMNS) -> DataFrame:
    """(a, cols, sims): what each of the first n articles gives to its neighbours, together / sqrt(n_a), in slices of `columns` columns.

    Sums over articles are to be multiplied by 1 / sqrt(n_b) of every column b. Pairs are counted, shuffled
    and added up as packed arrays by buckets of articles: no cell is a row.
    """
    buckets = max(1, -(-n_items // BUCKET_ARTICLES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = zip(*(batch.column(c) for c in ("own", "rest")))
            for a, b, n in blocks.pair_counts((own.values.to_numpy(), rest.values.to_numpy()) for own, rest in halves):
                other = (a < b) & (b < n_items)
                codes = np.concatenate([a << 31 | b, b[other] << 31 | a[other]])
                n = np.concatenate([n, n[other]])
                bucket = (codes >> 31) % buckets
                order = np.argsort(bucket, kind="stable")
                codes, n, bucket = codes[order], n[order], bucket[order]
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]]), pa.array([codes[i:j].tobytes() for i, j in spans], pa.binary()),
                    pa.array([n[i:j].astype(np.int64).tobytes() for i, j in spans], pa.binary())], ["bucket", "codes", "counts"])

    def merge(parts: pa.Table) -> pa.Table:
        codes, n = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in parts[c]]) for c in ("codes", "counts"))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        codes, n = codes[first], np.add.reduceat(n, first)
        a, b = codes >> 31, codes & 0x7FFFFFFF
        own = a == b  # every article that is in a basket meets itself there
        scale = 1 / np.sqrt(n[own].astype(np.float64))
        sims = n * scale[np.searchsorted(a[own], a)]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] // columns != b[:-1] // columns)))
        offsets = pa.array(np.append(starts, len(a)).astype(np.int32))
        return pa.table({"a": a[starts], "cols": pa.ListArray.from_arrays(offsets, pa.array(b.astype(np.int32))),
                         "sims": pa.ListArray.from_arrays(offsets, pa.array(sims))})

    # columns ascend, so those of the first articles begin a basket
    begun = customer_baskets.select("customer_id", F.col("cols").alias("whole"), F.filter("cols", lambda c: c < n_items).alias("cols"))
    rest = F.slice("whole", F.col("part") * PAIR_COLUMNS + 1, F.size("whole")).alias("rest")
    packed = spread(sliced(begun.filter(F.size("cols") > 0), PAIR_COLUMNS, "whole").select("own", rest)).mapInArrow(count, "bucket bigint, codes binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(merge, "a bigint, cols array<int>, sims array<double>")


def _packed(rows: DataFrame, key: str, n: int, pack: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `pack` makes of the rows of each of the n keys; a task holds one key, and there is a partition for each."""
    return rows.repartitionById(n, F.col(key).cast("int")).mapInArrow(pack, schema)


def _numbers(values: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(values.as_buffer(), kind)


def _offsets(places: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of n places begin, and the end, once they are sorted by place."""
    return np.append(0, np.cumsum(np.bincount(places, minlength=n))).astype(np.int32)


SLICE = "slice int, counts binary, held_at binary, held binary, row_at binary, rows binary, sims binary"


class Slice:
    """Columns number, number + n, ... of all baskets and similarity rows, by customer and by article; a column goes by its place."""

    def __init__(self, number: int, n: int, counts: np.ndarray, held_at: np.ndarray, held: np.ndarray, row_at: np.ndarray, rows: np.ndarray, sims: np.ndarray):
        self.number, self.n, self.counts = number, n, counts  # counts: customers of each column
        self.held_at, self.held, self.row_at, self.rows, self.sims = held_at, held, row_at, rows, sims
        self.scale = 1 / np.sqrt(np.maximum(counts, 1))

    @classmethod
    def of(cls, row: dict[str, pa.Scalar], n: int) -> Slice:
        kinds = {"sims": np.float64}
        return cls(row["slice"].as_py(), n, *(_numbers(row[c], kinds.get(c, np.int32)) for c in ("counts", "held_at", "held", "row_at", "rows", "sims")))

    def columns(self, places: np.ndarray) -> np.ndarray:
        return places.astype(np.int64) * self.n + self.number

    def cells(self, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(part, entries, how many) of the baskets or rows `which` that begin `at`, a bounded number of entries at once."""
        starts = at[which].astype(np.int64)
        sizes = at[which + 1] - starts
        group = np.cumsum(sizes) // blocks.CELLS
        cuts = np.flatnonzero(np.diff(group)) + 1 if len(group) and group[-1] else []
        for lo, hi in zip([0, *cuts], [*cuts, len(which)]):
            yield slice(lo, hi), blocks.ranges(starts[lo:hi], sizes[lo:hi]), sizes[lo:hi]


class Holders:
    """Articles of a block in their order, and the numbers of the customers that hold each."""

    def __init__(self, articles: np.ndarray, starts: np.ndarray, who: np.ndarray):
        self.articles, self.starts, self.who = articles, starts.astype(np.int64), who

    def of(self, articles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(customers, how many): those of each article, one article after the other."""
        at = np.searchsorted(self.articles, articles)
        n = self.starts[at + 1] - self.starts[at]
        return self.who[blocks.ranges(self.starts[at], n)], n

    @staticmethod
    def packed(a: Sequence[np.ndarray], sizes: Sequence[np.ndarray], who: Sequence[np.ndarray]) -> list[bytes]:
        none = [np.empty(0, np.int64)]
        a, sizes, who = (np.concatenate([*x, *none]) for x in (a, sizes, who))
        order = np.argsort(a, kind="stable")
        who = who[blocks.ranges((np.cumsum(sizes) - sizes)[order], sizes[order])]
        return [a[order].astype(np.int32).tobytes(), np.append(0, np.cumsum(sizes[order])).astype(np.int32).tobytes(), who.astype(np.int32).tobytes()]


def row_sums(part: Slice, acc: np.ndarray, own: np.ndarray, holders: Holders, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums): the sum of the similarity rows of a basket in a slice; articles below n_rows have a row, the others are in
    baskets. `acc` has a zero for each column, and again at the end."""
    light, found = own >= n_rows, []
    if light.any():
        who, n = holders.of(own[light])
        weights = np.repeat(1 / np.sqrt(n), n)
        for at, cells, sizes in part.cells(part.held_at, who):
            found.append(part.held.take(cells))
            np.add.at(acc, found[-1], np.repeat(weights[at], sizes))
            found[-1] = blocks.distinct(found[-1])
    if not light.all():
        for _, cells, _ in part.cells(part.row_at, own[~light]):
            found.append(part.rows.take(cells))
            np.add.at(acc, found[-1], part.sims.take(cells))
            found[-1] = blocks.distinct(found[-1])
    places = found[0] if len(found) == 1 else blocks.distinct(np.concatenate(found))
    sums = acc.take(places) * part.scale.take(places)
    acc[places] = 0
    return places, sums


def neighbours(part: Slice, articles: np.ndarray, holders: Holders) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in `articles`, column, similarity) of the articles' neighbours in a slice, some articles at once."""
    who, n = holders.of(articles)
    starts = part.held_at[who].astype(np.int64)
    sizes = part.held_at[who + 1] - starts
    article = np.repeat(np.arange(len(articles)), n)
    group = np.cumsum(np.bincount(article, sizes, len(articles))) // (blocks.CELLS // 4)  # several arrays of them are held
    ends = np.cumsum(n)
    for at in np.split(np.arange(len(articles)), np.flatnonzero(np.diff(group)) + 1):
        if not len(at):
            continue
        some = slice(ends[at[0]] - n[at[0]], ends[at[-1]])
        code = np.repeat(article[some], sizes[some]) * len(part.counts) + part.held[blocks.ranges(starts[some], sizes[some])]
        code = np.sort(code)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
        code, together = code[first], np.diff(np.append(first, len(code)))
        which, place = code // len(part.counts), code % len(part.counts)
        yield which, part.columns(place), together / np.sqrt(n[which] * part.counts[place].astype(np.float64))


def best(cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k best are, best first, the lower column on a tie."""
    among = np.arange(len(scores))
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return among[np.lexsort((cols[among], -scores[among]))[:k]]


def filled(cols: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int, n_items: int, exclusion: bool) -> np.ndarray:
    """The k best columns of those with a score; columns without one follow in their order, owned ones never with exclusion."""
    if exclusion:
        kept = ~np.isin(cols, own)
        cols, scores = cols[kept], scores[kept]
    found = cols[best(cols, scores, k)]
    if len(found) == k:
        return found
    # k of these are neither scored nor owned, if there are so many
    rest = np.setdiff1d(np.arange(min(n_items, 2 * k + len(own))), found)
    return np.append(found, (np.setdiff1d(rest, own) if exclusion else rest)[:k - len(found)])


BLOCK = "block int, at binary, own_at binary, own binary, articles binary, holders_at binary, holders binary"
FOUND = "block int, at bigint, cols array<int>, scores array<double>"
LISTS = "customer_id {key}, exclusion boolean, cols array<bigint>"


class ItemItem:
    """Fitted item-item model: catalogue, customer baskets and similarity, each a table."""

    def __init__(self, history: DataFrame, n_items: int | None = None):
        self.items = materialize(catalogue(history, n_items))
        self.baskets = materialize(baskets(history.select("customer_id", "article_id").join(self.items, "article_id")))
        release(history.sparkSession)

    @cached_property
    def upper(self) -> DataFrame:
        """The similarity as a written table of cells, a <= b."""
        return materialize(cosine(materialize(cooccurrence(self.baskets, PAIR_COLUMNS))))

    @property
    def similarity(self) -> DataFrame:
        return both_ways(self.upper)

    @cached_property
    def counts(self) -> DataFrame:
        """(col, n): customers of each column."""
        return materialize(self.baskets.select(F.explode("cols").alias("col")).groupBy("col").agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def n_pairs(self) -> int:
        return self.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @cached_property
    def n_rows(self) -> int:
        """So many of the first articles have a similarity row: up to the last one whose customers' baskets would be longer, or too many."""
        most = min(LIGHT_CUSTOMERS, self.items.count() * self.baskets.count() / max(1, self.n_pairs))
        last = self.counts.filter(F.col("n") > most).agg(F.max("col")).first()[0]
        return 0 if last is None else last + 1

    @cached_property
    def held(self) -> DataFrame:
        """who, cols: the baskets, customers numbered in the order they are written."""
        return numbered(self.baskets, "who").select("who", "cols")

    @cached_property
    def holders(self) -> DataFrame:
        """a, who: the numbers of the customers of each article that has no similarity row."""
        pairs = self.held.select(F.col("who").cast("int").alias("who"), F.explode("cols").alias("a")).filter(F.col("a") >= self.n_rows)
        return pairs.groupBy("a").agg(F.collect_list("who").alias("who"))

    @cached_property
    def rows(self) -> DataFrame:
        """The similarity as written rows of the articles that have one; lists need no table of cells."""
        return materialize(similarity_rows(self.baskets, self.n_rows, ROW_COLUMNS))

    @cached_property
    def n_slices(self) -> int:
        cells = self.rows.agg(F.coalesce(F.sum(F.size("cols")), F.lit(0))).first()[0] if self.n_rows else 0
        return max(1, min(-(-(self.n_pairs + 3 * cells) // SLICE_ENTRIES), self.items.count()))

    @cached_property
    def slices(self) -> DataFrame:
        """The baskets and similarity rows as written slices of the catalogue, one in a partition."""
        n, n_items, n_people, n_rows = self.n_slices, self.items.count(), self.baskets.count(), self.n_rows

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = batch.column("cols")
                ids = np.repeat(batch.column("id").to_numpy(), cols.value_lengths().to_numpy()).astype(np.int32)
                cols = cols.flatten().to_numpy()
                sims = batch.column("sims").flatten().to_numpy() if "sims" in batch.schema.names else np.empty(0)
                order = np.argsort(cols % n, kind="stable")
                ends = np.cumsum(np.bincount(cols % n, minlength=n))
                spans = [order[lo:hi] for lo, hi in zip(np.append(0, ends[:-1]), ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, ROW if len(sims) else HELD, np.int32)),
                    pa.array([ids[x].tobytes() for x in spans], pa.binary()), pa.array([(cols[x] // n).astype(np.int32).tobytes() for x in spans], pa.binary()),
                    pa.array([sims[x].tobytes() if len(sims) else b"" for x in spans], pa.binary())], ["slice", "kind", "ids", "cols", "sims"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, parts = None, {HELD: [], ROW: []}
            for batch in batches:
                for x in zip(*(batch.column(c) for c in ("slice", "kind", "ids", "cols", "sims"))):
                    number = x[0].as_py()
                    parts[x[1].as_py()].append((_numbers(x[2]), _numbers(x[3]), _numbers(x[4], np.float64)))
            if number is None:
                return
            out = [np.bincount(np.concatenate([c for _, c, _ in parts[HELD]] or [np.empty(0, np.int32)]), minlength=-(-(n_items - number) // n)).astype(np.int32)]
            for kind, places in ((HELD, n_people), (ROW, n_rows)):
                ids, cols, sims = (np.concatenate(x) for x in zip(*parts[kind])) if parts[kind] else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
                parts[kind] = []
                order = np.argsort(ids, kind="stable")
                out += [_offsets(ids, places), cols[order], *([sims[order]] if kind == ROW else [])]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in out)],
                                             ["slice", "counts", "held_at", "held", "row_at", "rows", "sims"])

        kept = "slice int, kind int, ids binary, cols binary, sims binary"
        entries = self.held.select(F.col("who").alias("id"), "cols").mapInArrow(split, kept)
        if n_rows:
            entries = entries.unionByName(self.rows.select(F.col("a").alias("id"), "cols", "sims").mapInArrow(split, kept))
        made = materialize(_packed(entries, "slice", n, pack, SLICE))
        release(self.baskets.sparkSession)
        return made

    def neighbour_counts(self) -> DataFrame:
        """(a, n_neighbours, total, closest) of each column: columns that share a customer with it, itself included, the sum of their
        similarities and the highest of another column. No table of cells is made."""
        n_slices, n_rows = self.n_slices, self.n_rows
        n_blocks = max(1, -(-self.n_pairs // ARTICLE_BLOCK), min(self.items.sparkSession.sparkContext.defaultParallelism, self.n_pairs // 4096))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, parts = None, []
            for batch in batches:
                if batch.num_rows:
                    block = batch.column("block")[0].as_py()
                    who = batch.column("who")
                    parts.append((batch.column("a").to_numpy(), who.value_lengths().to_numpy(), who.flatten().to_numpy()))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in Holders.packed(*zip(*parts)))],
                                                 ["block", "articles", "holders_at", "holders"])

        def summed(a: np.ndarray, groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            n, total, closest = np.zeros(len(a), np.int64), np.zeros(len(a)), np.full(len(a), -np.inf)
            for which, b, sims in groups:
                first = np.flatnonzero(np.append(True, which[1:] != which[:-1])[:len(which)])
                n[which[first]] += np.diff(np.append(first, len(which)))
                if len(which):
                    total[which[first]] += np.add.reduceat(sims, first)
                    closest[which[first]] = np.maximum(closest[which[first]], np.maximum.reduceat(np.where(b == a[which], -np.inf, sims), first))
            met = n > 0
            return pa.RecordBatch.from_arrays([pa.array(a[met].astype(np.int64)), pa.array(n[met]), pa.array(total[met]),
                                               pa.array(closest[met], mask=np.isinf(closest[met]))], ["a", "n_neighbours", "total", "closest"])

        def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    holders = Holders(*(_numbers(row[c]) for c in ("articles", "holders_at", "holders")))
                    yield summed(holders.articles, neighbours(Slice.of(row, n_slices), holders.articles, holders))

        def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part = Slice.of({c: batch.column(c)[i] for c in batch.schema.names}, n_slices)
                    a = np.arange(n_rows)
                    yield summed(a, ((np.repeat(a[at], sizes), part.columns(part.rows[cells]), part.sims[cells] * part.scale[part.rows[cells]])
                                     for at, cells, sizes in part.cells(part.row_at, a)))

        schema = "a bigint, n_neighbours bigint, total double, closest double"
        dealt = self.holders.select((F.col("a") % n_blocks).cast("int").alias("block"), "a", "who")
        articles = materialize(_packed(dealt, "block", n_blocks, pack, "block int, articles binary, holders_at binary, holders binary"))
        out = articles.hint("shuffle_replicate_nl").crossJoin(self.slices).mapInArrow(light, schema)
        if n_rows:
            out = out.unionByName(self.slices.mapInArrow(heavy, schema))
        release(self.baskets.sparkSession)
        return out.groupBy("a").agg(*(f(c).alias(c) for f, c in ((F.sum, "n_neighbours"), (F.sum, "total"), (F.max, "closest"))))

    def similarity_by_article(self) -> DataFrame:
        a = self.items.select(F.col("article_id").alias("item_a"), F.col("col").alias("a"))
        b = self.items.select(F.col("article_id").alias("item_b"), F.col("col").alias("b"))
        return self.similarity.join(a, "a").join(b, "b").select("item_a", "item_b", "sim")

    def recommend(self, customers: DataFrame, k: int = K, settings: Sequence[bool] = (True, False)) -> DataFrame:
        """(customer_id, exclusion, items) for customers with a basket; all settings from one scoring.

        Zero-score articles fill short lists in popularity order, which is the column order.
        """
        wanted = self.baskets.join(customers.select("customer_id"), "customer_id", "left_semi")
        wanted = dense_index(wanted, ["customer_id"], "at")
        n_people, n_owned, largest = wanted.agg(F.count(F.lit(1)), F.sum(F.size("cols")), F.max(F.size("cols"))).first()
        n_items = self.items.count()
        key = wanted.schema["customer_id"].dataType
        n_blocks = max(1, -(-(n_owned or 0) // BLOCK_COLUMNS), min(wanted.sparkSession.sparkContext.defaultParallelism, n_people // 64))
        base = F.expr(f"cast(at * {n_blocks} div {max(1, n_people)} as int)")
        parts = sliced(wanted, BASKET_COLUMNS, "cols", "at").withColumn("block", F.pmod(base + F.col("part"), F.lit(n_blocks)))

        def merged(people: pa.Table, found: pa.Table) -> pa.Table:
            at, sizes = found["at"].to_numpy(), found["cols"].combine_chunks().value_lengths().to_numpy()
            order = np.argsort(at, kind="stable")
            cells = blocks.ranges((np.cumsum(sizes) - sizes)[order], sizes[order])
            cols, scores = (found[c].combine_chunks().flatten().to_numpy()[cells] for c in ("cols", "scores"))
            ends = np.append(0, np.cumsum(sizes[order]))
            out: dict[str, list] = {"exclusion": [], "cols": []}
            for person, own in zip(people["at"].to_numpy(), people["cols"]):
                lo, hi = ends[np.searchsorted(at[order], [person, person + 1])]
                mine, inverse = np.unique(cols[lo:hi], return_inverse=True)
                # equal sums must tie whatever the summation order
                sums = np.round(np.bincount(inverse, scores[lo:hi], len(mine)), 9)
                for setting in settings:
                    out["exclusion"].append(setting)
                    out["cols"].append(filled(mine[sums > 0], sums[sums > 0], own.values.to_numpy(), k, n_items, setting))
            names = people["customer_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(people)), len(settings))))
            return pa.table({"customer_id": names, "exclusion": pa.array(out["exclusion"], pa.bool_()), "cols": pa.array(out["cols"], pa.list_(pa.int64()))})

        people = wanted.withColumn("block", base)
        schema = LISTS.format(key=key.simpleString())
        found = self._scored(parts.filter(F.size("cols") <= BASKET_COLUMNS), n_blocks, k, settings)
        out = people.filter(F.size("cols") <= BASKET_COLUMNS).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(merged, schema)
        if (largest or 0) > BASKET_COLUMNS:  # someone's basket is more than a slice: its sums come from several blocks
            heavy = people.filter(F.size("cols") > BASKET_COLUMNS)
            sums = self._scored(parts.filter(F.size("cols") > BASKET_COLUMNS), n_blocks, k, None)
            out = out.unionByName(heavy.groupBy("at").cogroup(sums.groupBy("at")).applyInArrow(merged, schema))
        release(self.baskets.sparkSession)
        ranked = out.select("customer_id", "exclusion", F.posexplode("cols").alias("rank", "col")).join(self.items, "col")
        return to_lists(ranked, ["customer_id", "exclusion"])

    def _scored(self, people: DataFrame, n_blocks: int, k: int, settings: Sequence[bool] | None) -> DataFrame:
        """(block, at, cols, scores): in each slice the k best columns of everyone (at, own, block) under each setting at least; without settings all sums."""
        n_slices, n_rows = self.n_slices, self.n_rows

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, who, asked = None, [], []
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = batch.column("block")[0].as_py()
                known = batch.column("at").is_valid()
                people, rest = batch.filter(known), batch.filter(batch.column("at").is_null())
                who.append((people.column("at").to_numpy(), people.column("own").value_lengths().to_numpy(), people.column("own").flatten().to_numpy()))
                asked.append((rest.column("a").to_numpy(), rest.column("who").value_lengths().to_numpy(), rest.column("who").flatten().to_numpy()))
            if block is not None:
                at, sizes, own = (np.concatenate(x) for x in zip(*who))
                mine = [at.astype(np.int64).tobytes(), np.append(0, np.cumsum(sizes)).astype(np.int32).tobytes(), own.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in [*mine, *Holders.packed(*zip(*asked))])],
                                                 ["block", "at", "own_at", "own", "articles", "holders_at", "holders"])

        def kept(part: Slice, places: np.ndarray, sums: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if settings is None:
                return part.columns(places), sums
            n = k + (np.count_nonzero(own % n_slices == part.number) if True in settings else 0)  # with exclusion k of these are not owned
            if len(sums) > n:  # sums that differ less than that may tie
                among = np.flatnonzero(sums >= np.partition(sums, len(sums) - n)[len(sums) - n] - 2e-9)
                places, sums = places[among], sums[among]
            scores = np.round(sums, 9)
            chosen = best(places, scores, n)
            return part.columns(places[chosen]), scores[chosen]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    part, acc = Slice.of(row, n_slices), None
                    at, starts, own = _numbers(row["at"], np.int64), _numbers(row["own_at"]), _numbers(row["own"])
                    holders = Holders(*(_numbers(row[c]) for c in ("articles", "holders_at", "holders")))
                    acc = np.zeros(len(part.counts))
                    for first in range(0, len(at), 1024):
                        found = []
                        for j in range(first, min(first + 1024, len(at))):
                            mine = own[starts[j]:starts[j + 1]]
                            found.append(kept(part, *row_sums(part, acc, mine, holders, n_rows), mine))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(found), row["block"].as_py(), np.int32)), pa.array(at[first:first + 1024]),
                            pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))],
                            ["block", "at", "cols", "scores"])

        asked = people.select("block", F.explode("own").alias("a")).filter(F.col("a") >= n_rows).distinct().join(self.holders, "a")
        none = {"at": "bigint", "own": "array<bigint>", "a": "bigint", "who": "array<int>"}
        mine, theirs = (rows.select("block", *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items())) for rows in (people, asked))
        packed = materialize(_packed(mine.unionByName(theirs), "block", n_blocks, pack, BLOCK))
        return packed.hint("shuffle_replicate_nl").crossJoin(self.slices).mapInArrow(score, FOUND)


def with_fallback(personal: DataFrame, customers: DataFrame, fallback: DataFrame,
                  keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Personal lists, and the one-row fallback list for customers without any.

    Another fallback swaps in without scoring anyone again. ``fallback`` has one list per value of
    the columns it shares with ``customers``.
    """
    shared = [c for c in fallback.columns if c in customers.columns]
    given = customers.join(F.broadcast(fallback.withColumnRenamed("items", "_fallback")), shared)
    return (given.join(personal, list(keys), "left")
            .withColumn("items", F.coalesce("items", "_fallback")).drop("_fallback"))
