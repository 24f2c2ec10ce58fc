"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line that is not empty, its digest a 64-bit hash; a text has the set of its
digests. A sketch is three tables of cells, and a digest goes into one cell of each, which adds up
a count, the digests and their checks (both by xor). The difference of two sketches holds only the
digests that differ: a cell with one digest left gives it away, it is taken out of its other cells,
and so on until all cells are empty. What is found on either side gives the likeness of the texts,
shared paragraphs over all paragraphs.

The fingerprint is a sketch of 12 cells. If the difference of two does not peel, the digests are
parted by hash into blocks of about 16, whose sketches have 48 cells, and those that do not peel are
tried again with twice the cells until all do. All of it is DataFrame and SQL expressions; work
grows with the number of paragraphs, however they are spread over documents.

The document that follows is found in buckets of the id's range, cut at quantiles, so that the texts
are shuffled once; the first document of the next bucket follows the last of a bucket.

Defined results: a null or empty text has no paragraphs, two such texts have the likeness 1; rows
that share a doc_id follow one another in the order of their texts' hashes; rows without a doc_id
take no part; a single document follows itself; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import documents, written

TABLES = 3
BASE_CELLS = 12
BLOCK_DIGESTS, BLOCK_CELLS = 16, 48
ROUNDS = 24          # of taking out digests; each empties at least one cell or is the last that does
BUCKET_ROWS, MOST_BUCKETS = 3000, 1 << 16


def digests(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _place(key: str, cell: str, cells: int) -> str:
    """Whether `key` goes into the cell with this number."""
    wide = cells // TABLES
    return f"pmod(xxhash64({key}, CAST({cell} div {wide} AS INT), {cells}), {wide}) = {cell} % {wide}"


def sketch(keys: str, cells: int) -> str:
    """SQL for the sketch of an array of digests: an array of cells (n, key, chk)."""
    return f"""transform(sequence(0, {cells - 1}), i -> aggregate({keys}, named_struct('n', 0, 'key', 0L, 'chk', 0L),
      (s, k) -> IF({_place('k', 'i', cells)}, named_struct('n', s.n + 1, 'key', s.key ^ k, 'chk', s.chk ^ xxhash64(k)), s)))"""


def difference(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'chk', x.chk ^ y.chk))"


def peeled(cells_sql: str, cells: int) -> str:
    """SQL for (cells left, only_a, only_b): digests found on either side of a difference."""
    pure = "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.chk = xxhash64(c.key)), c -> named_struct('n', c.n, 'key', c.key)))"
    taken = f"""transform(s.cells, (c, i) -> aggregate(p, c, (t, q) -> IF({_place('q.key', 'i', cells)},
        named_struct('n', t.n - q.n, 'key', t.key ^ q.key, 'chk', t.chk ^ xxhash64(q.key)), t)))"""
    step = f"""transform(array({pure}), p -> named_struct('cells', {taken},
        'only_a', s.only_a + size(filter(p, q -> q.n = 1)), 'only_b', s.only_b + size(filter(p, q -> q.n = -1)), 'more', size(p) > 0))[0]"""
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells_sql}, 'only_a', 0, 'only_b', 0, 'more', true),
      (s, r) -> IF(s.more, {step}, s))"""


EMPTY = "NOT exists({0}.cells, c -> c.n <> 0 OR c.key <> 0 OR c.chk <> 0)"


def printed(cells: str) -> str:
    return f"array_join(transform({cells}, c -> concat_ws(':', c.n, hex(c.key), hex(c.chk))), ',')"


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, following: the text of the next document by doc_id; the first follows the last."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    n = docs.count()
    buckets = max(1, min(-(-n // BUCKET_ROWS), MOST_BUCKETS))
    cuts = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets))).first()[0]))  # bounded by MOST_BUCKETS
    if cuts:
        steps = len(cuts).bit_length()  # binary search for the number of cuts below the id
        docs = docs.withColumn("bucket", F.expr(f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}),
          (s, r) -> IF(s.lo < s.hi, IF(array({','.join(f'{c}L' for c in cuts)})[(s.lo + s.hi) div 2] < doc_id,
            named_struct('lo', CAST((s.lo + s.hi) div 2 + 1 AS INT), 'hi', s.hi),
            named_struct('lo', s.lo, 'hi', CAST((s.lo + s.hi) div 2 AS INT))), s), s -> s.lo)"""))
    else:
        docs = docs.withColumn("bucket", F.lit(0))
    firsts = docs.groupBy("bucket").agg(F.min_by("text", F.struct("doc_id", "h")).alias("first_text"))
    around = Window.orderBy("bucket").rowsBetween(1, 1)  # one row for a bucket
    start = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("bucket", F.coalesce(F.first("first_text").over(around), F.first("first_text").over(start)).alias("after"))
    order = Window.partitionBy("bucket").orderBy("doc_id", "h")
    return (docs.withColumn("lead", F.lead("text").over(order)).join(firsts, "bucket")
            .select("doc_id", "text", F.coalesce("lead", "after").alias("following")))


def edited(text: str, following: str) -> Column:
    """The last quarter of the code points replaced by as many of what follows."""
    return F.expr(f"""concat(substring({text}, 1, char_length({text}) - char_length({text}) div 4),
      substring({following}, 1, char_length({text}) div 4))""")


def compared(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (with a unique `id` and columns of digests) with a likeness of 0 to 1 for each named pair of digest columns.

    Equal sets are known by their sketches; others are told apart by peeling.
    """
    base = rows
    for column in dict.fromkeys(c for pair in pairs.values() for c in pair):
        base = base.withColumn(f"s_{column}", F.expr(sketch(column, BASE_CELLS)))
    for name, (a, b) in pairs.items():
        base = base.withColumn(f"p_{name}", F.expr(peeled(difference(f"s_{a}", f"s_{b}"), BASE_CELLS)))
    base = base.select(
        *rows.columns, *[F.expr(printed(f"s_{c}")).alias(f"f_{c}") for c in dict.fromkeys(c for pair in pairs.values() for c in pair)],
        *[F.expr(f"IF({EMPTY.format('p_' + n)}, named_struct('only_a', p_{n}.only_a, 'only_b', p_{n}.only_b), NULL)").alias(f"d_{n}") for n in pairs])
    base = written(base, "sketches")

    todo = None
    for name, (a, b) in pairs.items():
        part = base.where(F.col(f"d_{name}").isNull()).select(
            "id", F.lit(name).alias("pair"), F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / F.lit(BLOCK_DIGESTS))).alias("blocks"),
            F.explode(F.concat(F.transform(a, lambda k: F.struct(k.alias("key"), F.lit(True).alias("in_a"))),
                               F.transform(b, lambda k: F.struct(k.alias("key"), F.lit(False).alias("in_a"))))).alias("k"))
        todo = part if todo is None else todo.union(part)
    block = F.pmod(F.xxhash64("k.key", F.lit("block")), F.col("blocks"))
    todo = (todo.groupBy("id", "pair", block.alias("block"))
            .agg(F.array_compact(F.collect_list(F.when(F.col("k.in_a"), F.col("k.key")))).alias("a"),
                 F.array_compact(F.collect_list(F.when(~F.col("k.in_a"), F.col("k.key")))).alias("b")))
    done, cells = None, BLOCK_CELLS
    while True:
        tried = todo.withColumn("p", F.expr(peeled(difference(sketch("a", cells), sketch("b", cells)), cells)))
        tried = written(tried.select("id", "pair", "block", "p.only_a", "p.only_b", F.expr(EMPTY.format("p")).alias("ok"),
                                     F.when(~F.expr(EMPTY.format("p")), F.col("a")).alias("a"),
                                     F.when(~F.expr(EMPTY.format("p")), F.col("b")).alias("b")), "peeled")
        good = tried.where("ok").select("id", "pair", "only_a", "only_b")
        done = good if done is None else done.union(good)
        todo, cells = tried.where(~F.col("ok")).select("id", "pair", "block", "a", "b"), cells * 2
        if todo.isEmpty():
            break
    found = done.groupBy("id").agg(*[F.sum(F.when(F.col("pair") == n, F.col(side))).alias(f"{side}_{n}") for n in pairs for side in ("only_a", "only_b")])
    out = base.join(found, "id", "left")
    for name, (a, b) in pairs.items():
        only_a, only_b = (F.coalesce(F.col(f"d_{name}.{side}").cast("bigint"), F.col(f"{side}_{name}"), F.lit(0)) for side in ("only_a", "only_b"))
        every = F.size(a) + only_b
        out = out.withColumn(name, F.when(every == 0, F.lit(1.0)).otherwise((F.size(a) - only_a) / every))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs of every document."""
    rows = followed(documents(docs)).withColumn("edited", edited("text", "following"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"),
                       digests(F.col("following")).alias("next"))
    rows = written(rows, "digests")
    out = compared(rows, {"near_edited": ("own", "changed"), "near_next": ("own", "next")})
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("f_own").alias("fingerprint"), F.col("f_changed").alias("edited_fingerprint"),
                      "near_edited", "near_next", F.size("own").cast("bigint").alias("n_paragraphs"))
