"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Sets are of 64-bit hashes of `shingle` consecutive words; A-Z are lower-cased. With all hashes in
one global order, two sets can only reach the similarity if they share a hash among the first
n - ceil(s * n) + 1 of each (their prefixes). Documents with identical prefixes and size are one
group, and only groups are indexed. Groups that share hashes become pairs if their sizes allow it
and if the number of shared prefix hashes does: what two sets share beyond their prefixes is at most
the rest of one of them. Pairs of groups are then expanded to their members and verified exactly.

Nothing is capped, and no group is paired with itself:

* Hashes that more than `BUCKET` prefixes hold (lines and passages that many documents share), and
  frequent ones beside them in the texts, come last in the global order, so that prefixes are made
  of rare hashes. Which ones do decides the work and not the result.
* In each list of groups that share a hash, all are first verified against one leader. Of the pairs
  that are left, only those are made whose two sides are not connected yet. As any link between
  sets of one component is one of that component, components lose nothing.
* In long lists, which only sets of frequent hashes are in, groups whose frequent hashes are too few
  to link them with anything are left out first. What is left is compared by parity sketches before a
  pair is made: bit i is the parity of the number of hashes of a set that fall to i, so that two
  sketches differ in no more bits than their sets do in hashes. Nothing that links is left out; sets
  that differ in more hashes than half the bits are only told apart by their prefixes and texts.

Sets are identified by 64-bit hashes, like shingles: among N different sets, the chance that any two
are taken for one another is about N * N / 2^65.

Defined results: a text with fewer words is one shingle of all its words; a null text, or one
without words, has the empty set and is linked with nothing; repeated rows and copies are linked;
rows without a doc_id take no part; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import documents, written
from basketline.llm.components import components
from basketline.llm.text import mix, slices, text_slices, word_hashes

BUCKET = 32            # groups that share a hash, beyond which it counts as frequent
REACH, SPREADS = 16, 2  # shingles around a frequent one that are counted too, and how often that is repeated
SKETCH = 8             # first long lists of a group that a pair looks up to be made once
PARITY_BITS = 1024     # of a set's parity sketch
SLICE = 1 << 18        # bytes of text worked on at once
MOST_IN_TASKS = 4_000_000  # hashes that are sent to the tasks as one array (32 MB); beyond, see each use


def shingles_in_order(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The shingle hashes of each text, in the order of the text."""
    first, h = word_hashes(texts)
    weights = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(words)]
    n = len(h)
    if n >= words:
        total = np.zeros(n - words + 1, np.uint64)
        for k, weight in enumerate(weights):
            total += mix(h[k:n - words + 1 + k] * weight)
        total = mix(total)
    out = []
    for begin, end in zip(first[:-1], first[1:]):
        if end - begin >= words:
            out.append(total[begin:end - words + 1])
        elif end > begin:
            parts = [mix(h[begin + k:begin + k + 1] * weights[k]) for k in range(end - begin)]
            out.append(mix(np.sum(parts, axis=0, dtype=np.uint64) + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(s) for s in shingles_in_order(texts, words)]


def digest(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def text_keys(doc_ids: np.ndarray, sids: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair of a doc_id and a set."""
    return mix(mix(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ sids.astype(np.int64).view(np.uint64))


def parities(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as signed 64-bit words."""
    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(x: str, y: str, a: Column, b: Column, percent: int) -> Column:
    """Whether the sketches x and y of sets of a and b hashes, where both are known, differ in as few bits as the hashes of linked sets."""
    differing = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return F.coalesce(differing <= a + b - 2 * least_overlap(a, b, percent), F.lit(True))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def around(s: np.ndarray, new: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Distinct hashes up to REACH shingles before or after one of `new` in a text, but for the known ones."""
    at = np.flatnonzero(member(s, new))
    if not len(at):
        return s[:0]
    marks = np.zeros(len(s) + 1, np.int64)
    np.add.at(marks, np.maximum(at - REACH, 0), 1)
    np.add.at(marks, np.minimum(at + REACH + 1, len(s)), -1)
    near = np.unique(s[np.cumsum(marks)[:-1] > 0])
    return near[~member(near, known)]


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first hashes of a set in the global order: by hash, the frequent ones last."""
    length = prefix_length(len(s), percent)
    last = member(s, frequent)
    return np.concatenate([s[~last][:length], s[last][:max(0, length - int((~last).sum()))]])


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The smallest intersection of sets of these sizes that reaches the similarity."""
    return F.ceil((a + b) * percent / F.lit(100 + percent))


def links_by_size(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return overlap * (100 + percent) >= (a + b) * percent


class SetJoin:
    """The join of one table with itself at one threshold."""

    def __init__(self, docs: DataFrame, shingle: int = 5, percent: int = 80):
        self.docs, self.shingle, self.percent = documents(docs), shingle, percent
        self.spark = docs.sparkSession

    def _over_sets(self, emit, schema: str, in_order: bool = False) -> DataFrame:
        """emit(doc_id, set) gives rows of the schema; the texts are read anew, which is cheaper than to keep all sets."""
        shingle, read = self.shingle, shingles_in_order if in_order else shingle_sets
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.list_(pa.int64()) if c.endswith("array<bigint>") else pa.int64() for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, texts in slices(batch, limit=SLICE):
                    out = [r for d, s in zip(rows.column("doc_id").to_pylist(), read(texts, shingle)) for r in emit(d, s)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        return self.docs.mapInArrow(run, schema)

    def prefixed(self, frequent: np.ndarray) -> DataFrame:
        """doc_id, sid (set), gid (group), n, prefix, parities (only with a frequent hash in the prefix, as in long lists) of every document; nulls and 0 for one without words."""
        percent, shared = self.percent, self.spark.sparkContext.broadcast(frequent)

        def emit(doc_id: int, s: np.ndarray):
            if len(s):
                final = prefix(s, shared.value, percent)
                yield doc_id, digest(s), _group(final, len(s)), len(s), final.view(np.int64), parities(s) if member(final[-1:], shared.value)[0] else None
            else:
                yield doc_id, None, None, 0, None, None

        return self._over_sets(emit, "doc_id bigint, sid bigint, gid bigint, n bigint, prefix array<bigint>, parities array<bigint>")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """sid, tokens of the sets named in `wanted` (sid): as one array in the tasks up to MOST_IN_TASKS of them, else by a join."""
        wanted = wanted.distinct()
        count = wanted.count()
        if count <= MOST_IN_TASKS:
            known = np.sort(wanted.toArrow()["sid"].to_numpy())
            known = self.spark.sparkContext.broadcast(known)

            def emit(doc_id: int, s: np.ndarray):
                if len(s):
                    sid = digest(s)
                    if member(np.array([sid]), known.value)[0]:
                        yield sid, s.view(np.int64)
        else:
            def emit(doc_id: int, s: np.ndarray):
                if len(s):
                    yield digest(s), s.view(np.int64)

        sets = self._over_sets(emit, "sid bigint, tokens array<bigint>")
        if count > MOST_IN_TASKS:
            sets = sets.join(wanted, "sid", "left_semi")
        return sets.groupBy("sid").agg(F.any_value("tokens").alias("tokens"))

    def frequent_hashes(self) -> np.ndarray:
        """Hashes that more than BUCKET documents have in their prefixes, or near such a hash in their texts.

        Any set of hashes may come last without harm to the result. A passage that many documents share
        has some of its hashes in their prefixes, and the others beside those in the texts. There are
        MOST_IN_TASKS at most, which a higher bound than BUCKET ensures in very large tables.
        """
        percent, none = self.percent, np.zeros(0, np.uint64)

        def plain(doc_id: int, s: np.ndarray):
            if len(s):
                yield (prefix(s, none, percent).view(np.int64),)

        found = self._over_sets(plain, "hashes array<bigint>")
        frequent = none
        for _ in range(SPREADS + 1):
            counted = written(found.select(F.explode("hashes").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("m"))
                              .where(F.col("m") > BUCKET), "frequent")
            bound = BUCKET
            while counted.where(F.col("m") > bound).count() > MOST_IN_TASKS - len(frequent):
                bound *= 2
            new = np.sort(counted.where(F.col("m") > bound).select("t").toArrow()["t"].to_numpy().view(np.uint64))
            if not len(new):
                break
            frequent = np.sort(np.concatenate([frequent, new]))
            shared = self.spark.sparkContext.broadcast((new, frequent))

            def near(doc_id: int, s: np.ndarray, shared=shared):
                hashes = around(s, *shared.value)
                if len(hashes):
                    yield (hashes.view(np.int64),)

            found = self._over_sets(near, "hashes array<bigint>", in_order=True)
        return frequent

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of sets that link, with their overlap."""
        pairs = written(pairs.distinct(), "pairs")
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        left, right = (sets.select(F.col("sid").alias(s), F.col("tokens").alias(f"t{s}")) for s in "ab")
        both = pairs.join(left, "a").join(right, "b")
        both = both.withColumn("overlap", F.size(F.array_intersect("ta", "tb")).cast("bigint"))
        return both.where(links_by_size(F.col("overlap"), F.size("ta"), F.size("tb"), self.percent)).select("a", "b", "overlap")

    def classed(self) -> DataFrame:
        """doc_id, sid, n, component (a set's name) of every document; nulls and 0 for one without words."""
        frequent = self.frequent_hashes()
        members = written(self.prefixed(frequent), "members")
        rows = members.where("n > 0").groupBy("gid", "n").agg(F.any_value("prefix").alias("prefix"))
        rows = rows.select("gid", "n", F.explode("prefix").alias("t"))
        rows = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("t"))).where("m > 1")
        rows = written(rows, "lists")
        groups = written(members.where("n > 0").groupBy("gid", "sid").agg(F.any_value("parities").alias("parities")), "sets")
        members = members.select("doc_id", "sid", "gid", "n")

        links = self._links(rows, groups.select("gid", "sid"), groups)
        joined = components(links).withColumnRenamed("node", "sid")
        return members.join(joined, "sid", "left").withColumn("component", F.coalesce("component", "sid"))

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        classed = written(self.classed(), "classed")
        least = classed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return classed.join(least, "component", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

    def representatives(self, docs: DataFrame) -> DataFrame:
        """The documents, all their columns, with one for each class: the smallest doc_id, and of its rows one.

        A document without words is a class of its own. Rows to leave out are known by doc_id and set; up
        to MOST_IN_TASKS of them are sent to the tasks as hashes, more are found by a join. Texts go
        through one Python worker of a task only.
        """
        classed = written(self.classed().where("n > 0"), "classed")
        rows = F.count(F.lit(1)).alias("rows")
        texts = classed.groupBy("component", "doc_id", "sid").agg(rows)
        first = texts.groupBy("component").agg(F.min(F.struct("doc_id", "sid")).alias("first"))
        texts = written(texts.join(first, "component").select(
            "doc_id", "sid", "rows", (F.struct("doc_id", "sid") == F.col("first")).alias("stays")), "texts")
        dropped, repeated = texts.where("NOT stays").select("doc_id", "sid"), texts.where("stays AND rows > 1").select("doc_id", "sid")
        columns, shingle = docs.columns, self.shingle
        many, keys = dropped.count() > MOST_IN_TASKS, np.zeros(0, np.uint64)
        if not many:
            named = dropped.toArrow()
            keys = np.sort(text_keys(named["doc_id"].to_numpy(), named["sid"].to_numpy()))
        known = self.spark.sparkContext.broadcast(keys)

        @F.arrow_udf("struct<sid: bigint, stays: boolean>")
        def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for ids, column in batches:
                sid = pa.array([digest(s) if len(s) else None for texts in text_slices(column, SLICE) for s in shingle_sets(texts, shingle)], pa.int64())
                out = member(text_keys(ids.to_numpy(), sid.fill_null(0).to_numpy()), known.value) & sid.is_valid().to_numpy(zero_copy_only=False)
                yield pa.StructArray.from_arrays([sid, pa.array(~out)], names=["sid", "stays"])

        whole = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
        whole = whole.withColumn("doc_id", F.col("row.doc_id").cast("bigint"))
        # not computed again for each column that is made from it
        whole = whole.withColumn("is", judged.asNondeterministic()("doc_id", F.col("row.text").cast("string")))
        whole = whole.where("is.stays").select("row", "doc_id", F.col("is.sid").alias("sid"))
        if many:
            whole = whole.join(dropped, ["doc_id", "sid"], "left_anti")
        if not repeated.isEmpty():
            twice = whole.join(repeated, ["doc_id", "sid"], "left_semi").withColumn(
                "k", F.row_number().over(Window.partitionBy("doc_id", "sid").orderBy(F.xxhash64("row"))))
            whole = whole.join(repeated, ["doc_id", "sid"], "left_anti").select("row").unionByName(twice.where("k = 1").select("row"))
        return whole.select("row.*")

    def _links(self, rows: DataFrame, groups: DataFrame, sketched: DataFrame) -> DataFrame:
        percent = self.percent
        # of groups of one set: no sketch stands for several
        sketches = sketched.groupBy("gid").agg(F.when(F.count(F.lit(1)) == 1, F.any_value("parities")).alias("parities"))
        frequent = rows.where(F.col("m") > BUCKET)
        weight = frequent.groupBy("gid").agg(F.count(F.lit(1)).alias("f"))
        rows = rows.join(weight, "gid", "left").withColumn("f", F.coalesce("f", F.lit(0)))
        leader = F.min(F.struct((-F.col("f") / F.col("n")).alias("cold"), "n", "gid"))
        led = rows.join(rows.groupBy("t").agg(leader.alias("l")), "t")
        size_ok = F.least("n", "l.n") * 100 >= F.greatest("n", "l.n") * percent
        star = led.where(size_ok & (F.col("gid") != F.col("l.gid"))).select("gid", F.col("l.gid").alias("leader")).distinct()
        held = rows.groupBy("gid", "n").agg(F.collect_list("t").alias("held"))  # of a prefix
        shared = F.size(F.array_intersect("held", "led.held"))
        star = (star.join(held, "gid").join(held.select(F.col("gid").alias("leader"), F.struct("n", "held").alias("led")), "leader")
                .where(shared >= self._shared_needed(F.least("n", "led.n"), F.greatest("n", "led.n"))).select("gid", "leader"))
        heads = groups.groupBy("gid").agg(F.min("sid").alias("head"))
        star = (star.join(groups, "gid").join(heads.withColumnRenamed("gid", "leader"), "leader").select(F.col("sid").alias("a"), F.col("head").alias("b"))
                .unionByName(groups.join(heads, "gid").where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))))
        first = written(self.verified(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "star-links")

        label = components(first).withColumnRenamed("node", "sid")
        placed = written(groups.join(label, "sid", "left").select("gid", "sid", F.coalesce("component", "sid").alias("c")), "labels")
        group = placed.groupBy("gid").agg(F.min("c").alias("c"), (F.min("c") != F.max("c")).alias("split"), F.count(F.lit(1)).alias("size"))
        tagged = rows.join(group.drop("size"), "gid")
        # lists all of whose groups are connected are done
        whole = tagged.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bool_or("split").alias("any"),
                                        F.min("n").alias("n_min"), F.max("n").alias("n_max"))
        open_lists = whole.where("any OR lo <> hi").select("t", "n_min", "n_max")
        tagged = tagged.join(open_lists, "t")
        stays = (F.col("f") >= self._least_needed(F.col("n"), F.col("n_min"), F.col("n_max"))) | (F.col("m") <= BUCKET)
        # a group may stay in one long list and not in another: `left` counts those that it is left out of
        left = F.sum(F.when(F.col("stays"), 0).otherwise(1)).over(Window.partitionBy("gid"))
        tagged = written(tagged.withColumn("stays", stays).withColumn("left", left).where("stays")
                         .select("t", "gid", "n", "f", "c", "split", "left", (F.col("m") > BUCKET).alias("long")), "open-lists")
        pairs = self._pairs_of_short(tagged.where("NOT long")).unionByName(self._pairs_of_long(tagged.where("long"), held, sketches))
        same = group.where("split").select(F.col("gid").alias("gid_x"), F.col("gid").alias("gid_y"))
        members = [placed.select(F.col("gid").alias(f"gid_{s}"), F.col("sid").alias(f"sid_{s}"), F.col("c").alias(f"c_{s}")) for s in "xy"]
        expanded = (pairs.unionByName(same).join(members[0], "gid_x").join(members[1], "gid_y").where("c_x <> c_y")
                    .select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b")))
        return first.unionByName(self.verified(expanded)).select("a", "b")

    def _sides(self, left: DataFrame, right: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame, Column, Column]:
        """Both sides of a join by t, whether x comes first in the order, and whether their sizes and components allow a new link."""
        x, y = (side.select("t", *[F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "c", "split", *columns)]) for side, s in ((left, "x"), (right, "y")))
        ordered = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("gid_x") < F.col("gid_y")))
        apart = (F.col("c_x") != F.col("c_y")) | F.col("split_x") | F.col("split_y")
        size_ok = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * self.percent
        return x, y, ordered, apart & size_ok

    def _pairs_of_short(self, tagged: DataFrame) -> DataFrame:
        """gid_x, gid_y of short lists that share enough hashes, if they meet in no long list."""
        x, y, ordered, possible = self._sides(tagged, tagged, "f", "left")
        hidden = F.least("f_x", "f_y", F.col("left_x") + F.col("left_y"))  # lists that both hold and do not meet in, at most
        return (x.join(y, "t").where(ordered & possible).groupBy("gid_x", "gid_y")
                .agg(F.count(F.lit(1)).alias("shared"), F.first("n_x").alias("n_x"), F.first("n_y").alias("n_y"), F.first(hidden).alias("hidden"))
                .where(F.col("shared") + F.col("hidden") >= self._shared_needed(F.col("n_x"), F.col("n_y"))).select("gid_x", "gid_y"))

    def _pairs_of_long(self, tagged: DataFrame, held: DataFrame, sketches: DataFrame) -> DataFrame:
        """gid_x, gid_y that meet in long lists and share enough hashes.

        In each list only the groups outside its largest component look for partners. Near copies meet
        in many lists: a pair is made in the first list that both are in, as far as the first SKETCH
        lists of each tell, and if their sketches allow a link; what the two share is counted from their
        prefixes afterwards.
        """
        sketch = tagged.groupBy("gid").agg(F.slice(F.sort_array(F.collect_list("t")), 1, SKETCH).alias("sketch"))
        main = (tagged.where("NOT split").groupBy("t", "c").agg(F.count(F.lit(1)).alias("k"))
                .groupBy("t").agg(F.max_by("c", F.struct("k", "c")).alias("main")))
        tagged = written(tagged.join(sketch, "gid").join(sketches, "gid").join(main, "t", "left")
                         .withColumn("outside", F.col("split") | (F.col("c") != F.col("main"))), "long-lists")
        x, y, ordered, possible = self._sides(tagged.where("outside"), tagged, "sketch", "outside", "parities")
        earlier = F.coalesce(F.array_min(F.array_intersect("sketch_x", "sketch_y")), F.col("t")) < F.col("t")
        near = may_link("parities_x", "parities_y", F.col("n_x"), F.col("n_y"), self.percent)
        pairs = x.join(y, "t").where((~F.col("outside_y") | ordered) & possible & near & ~earlier).select("gid_x", "gid_y").distinct()
        for s in "xy":
            pairs = pairs.join(held.select(F.col("gid").alias(f"gid_{s}"), F.col("n").alias(f"n_{s}"), F.col("held").alias(f"held_{s}")), f"gid_{s}")
        shared = F.size(F.array_intersect("held_x", "held_y"))
        return pairs.where(shared >= self._shared_needed(F.least("n_x", "n_y"), F.greatest("n_x", "n_y"))).select("gid_x", "gid_y")

    def _shared_needed(self, smaller: Column, larger: Column) -> Column:
        """How many hashes the prefixes of two linked sets share at least."""
        rest = F.greatest(F.ceil(smaller * self.percent / F.lit(100)), F.ceil(larger * self.percent / F.lit(100))) - 1
        return F.greatest(F.lit(1), least_overlap(smaller, larger, self.percent) - rest)

    def _least_needed(self, n: Column, n_min: Column, n_max: Column) -> Column:
        """The smallest _shared_needed of a set of n hashes and any of n_min to n_max that it can link with.

        It rises with the smaller size. With the larger one it falls by p * p / (1 + p) a hash, p being the
        similarity, but for two roundings up, so that its smallest value is among the last few sizes.
        """
        last = -(-100 * (100 + self.percent) // self.percent ** 2)
        larger = F.least(n_max, F.floor(n * 100 / F.lit(self.percent)))
        smaller = F.greatest(n_min, F.ceil(n * self.percent / F.lit(100)))
        return F.least(self._shared_needed(smaller, n), *[self._shared_needed(n, F.greatest(n, larger - k)) for k in range(last)])


def _group(prefix_hashes: np.ndarray, n: int) -> int:
    return digest(np.append(np.sort(prefix_hashes), np.uint64(n)))


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document."""
    return SetJoin(docs, shingle, percent).classes()


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one left of each group of near duplicates."""
    return SetJoin(docs, shingle, percent).representatives(docs)
