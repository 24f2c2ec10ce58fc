"""Item-item, factor scoring, ALS and ranking against brute force and invariants."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketline.functions.blocks import pair_counts, top_columns
from basketline.operators import als, boosting, factors, itemitem, ranker
from basketline.operators.guards import export_checks
from basketline.operators.itemitem import ItemItem, with_fallback
from basketline.session import release


@pytest.fixture(scope="module")
def purchases():
    rng = random.Random(3)
    rows = [(c, rng.choice([rng.randint(0, 8), rng.randint(0, 30)])) for c in range(60) for _ in range(rng.randint(1, 9))]
    return rows + [(99, a) for a in range(25)]  # one customer with most of the catalogue


@pytest.fixture(scope="module")
def history(spark, purchases):
    return spark.createDataFrame(purchases, "customer_id bigint, article_id bigint")


def brute_lists(purchases, n_items, k, exclude):
    counts = {a: sum(1 for _, x in purchases if x == a) for a in {a for _, a in purchases}}
    items = sorted(counts, key=lambda a: (-counts[a], a))[:n_items]
    owners = {a: {c for c, x in purchases if x == a} for a in items}
    sim = {(a, b): len(owners[a] & owners[b]) / math.sqrt(len(owners[a]) * len(owners[b])) for a in items for b in items}
    out = {}
    for c in {c for c, _ in purchases}:
        owned = [a for a in items if c in owners[a]]
        if owned:
            score = {b: round(sum(sim[a, b] for a in owned), 9) for b in items if not (exclude and b in owned)}
            out[c] = sorted(score, key=lambda b: (-score[b], items.index(b)))[:k]
    return out


@pytest.mark.parametrize("n_items", [6, 20, None])
def test_item_item_matches_brute_force(history, purchases, n_items):
    people = history.select("customer_id").distinct()
    got = ItemItem(history, n_items).recommend(people).collect()
    for exclude in (True, False):
        mine = {r.customer_id: r["items"] for r in got if r.exclusion == exclude and r["items"]}
        want = {c: l for c, l in brute_lists(purchases, n_items, 12, exclude).items() if l}
        assert mine == want, exclude


def test_item_item_in_small_blocks(monkeypatch, spark, history, purchases):
    """Baskets in slices of three and six columns, rows in slices of four, many blocks: the same lists."""
    for name, size in (("PAIR_COLUMNS", 3), ("ROW_COLUMNS", 4), ("BASKET_COLUMNS", 6), ("BLOCK_COLUMNS", 16)):
        monkeypatch.setattr(itemitem, name, size)
    model = ItemItem(history)
    rows = model.rows.filter("a = 0").collect()  # the best seller's row travels in slices
    assert len(rows) > 3 and all(len(r["cols"]) <= 4 and len({c // 4 for c in r["cols"]}) == 1 for r in rows)
    lists = model.recommend(history.select("customer_id").distinct())
    plan = lists._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(sim" not in plan  # no rows of (customer, owned, neighbour) are added up
    for exclude in (True, False):
        mine = {r.customer_id: r["items"] for r in lists.collect() if r.exclusion == exclude and r["items"]}
        assert mine == {c: l for c, l in brute_lists(purchases, None, 12, exclude).items() if l}, exclude


@pytest.mark.parametrize("light", [0, 6, 1024])
def test_item_item_by_baskets_or_rows(monkeypatch, history, purchases, light):
    """All articles with a row of their own, some of them answered with their customers' baskets, nearly all: the same lists."""
    monkeypatch.setattr(itemitem, "LIGHT_CUSTOMERS", light)
    monkeypatch.setattr(itemitem, "BLOCK_COLUMNS", 50)
    lists = ItemItem(history).recommend(history.select("customer_id").distinct()).collect()
    for exclude in (True, False):
        mine = {r.customer_id: r["items"] for r in lists if r.exclusion == exclude and r["items"]}
        assert mine == {c: l for c, l in brute_lists(purchases, None, 12, exclude).items() if l}, exclude


def test_sparse_catalogue_has_no_similarity_rows(spark):
    """Articles with few customers each: no similarity row is made, shuffled or written."""
    rng = random.Random(4)
    rows = [(c, rng.randint(0, 7) + c // 10 * 8) for c in range(200) for _ in range(4)]
    model = ItemItem(spark.createDataFrame(rows, "customer_id bigint, article_id bigint"))
    got = model.recommend(model.baskets.select("customer_id"), settings=(False,)).collect()
    assert {r.customer_id: r["items"] for r in got} == brute_lists(rows, None, 12, False)
    assert model.rows.filter("a >= 0").isEmpty()


@pytest.mark.parametrize("light", [0, 6, 1024])
def test_item_item_in_slices_of_the_catalogue(monkeypatch, history, purchases, light):
    """Baskets and rows are written once, however many blocks of customers meet them: no block gets baskets by a shuffle."""
    for name, size in (("LIGHT_CUSTOMERS", light), ("BLOCK_COLUMNS", 50), ("SLICE_ENTRIES", 40)):
        monkeypatch.setattr(itemitem, name, size)
    model = ItemItem(history)
    lists = model.recommend(history.select("customer_id").distinct())
    assert "CartesianProduct" in lists._jdf.queryExecution().executedPlan().toString()
    assert model.slices.count() == model.n_slices > 4
    parts = [itemitem.Slice.of({c: pa.scalar(r[c], pa.int32() if c == "slice" else pa.binary()) for c in r.asDict()}, model.n_slices) for r in model.slices.collect()]
    assert sum(len(p.held) for p in parts) == len(set(purchases)) == sum(p.counts.sum() for p in parts)
    for exclude in (True, False):
        mine = {r.customer_id: r["items"] for r in lists.collect() if r.exclusion == exclude and r["items"]}
        assert mine == {c: l for c, l in brute_lists(purchases, None, 12, exclude).items() if l}, exclude


def test_shuffles_are_released(spark, history):
    """What a written step has shuffled does not stay on disk for the rest of the query."""
    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toList()
        return sum(found.apply(i).name().startswith("shuffle_") for i in range(found.size()))
    release(spark)
    time.sleep(3)
    before = shuffled()
    model = ItemItem(history)
    assert model.slices.count() == 1
    for _ in range(20):
        if shuffled() <= before + 20:  # of the last counts, which wrote nothing
            break
        time.sleep(0.5)
    assert shuffled() <= before + 20


@pytest.mark.parametrize("light", [0, 6, 1024])
def test_neighbour_counts(monkeypatch, history, purchases, light):
    monkeypatch.setattr(itemitem, "LIGHT_CUSTOMERS", light)
    monkeypatch.setattr(itemitem, "ARTICLE_BLOCK", 40)
    model = ItemItem(history)
    names = {r.col: r.article_id for r in model.items.collect()}
    owners = {a: {c for c, x in purchases if x == a} for a in names.values()}
    sim = {(a, b): len(owners[a] & owners[b]) / math.sqrt(len(owners[a]) * len(owners[b])) for a in owners for b in owners if owners[a] & owners[b]}
    got = {names[r.a]: r for r in model.neighbour_counts().collect()}
    assert len(got) == len(owners)
    for a, r in got.items():
        mine = {b: s for (x, b), s in sim.items() if x == a}
        assert r.n_neighbours == len(mine) and r.total == pytest.approx(sum(mine.values()))
        assert r.closest == pytest.approx(max(s for b, s in mine.items() if b != a))


@pytest.mark.parametrize("light", [0, 1024])
def test_neighbour_counts_in_slices(monkeypatch, history, light):
    """Articles in many blocks, the catalogue in many slices: the same figures, and no basket is shuffled to a block of articles."""
    def counts():
        return {r.a: (r.n_neighbours, round(r.total, 9), round(r.closest, 9)) for r in model.neighbour_counts().collect()}
    model = ItemItem(history)
    want = counts()
    for name, size in (("LIGHT_CUSTOMERS", light), ("ARTICLE_BLOCK", 40), ("SLICE_ENTRIES", 40)):
        monkeypatch.setattr(itemitem, name, size)
    model = ItemItem(history)
    plan = model.neighbour_counts()._jdf.queryExecution().executedPlan().toString()
    assert model.n_slices > 4 and "CartesianProduct" in plan and "CoGroups" not in plan
    assert counts() == want


@pytest.mark.parametrize("cells", [1, 50, 4_000_000])
def test_pairs_of_short_and_long_baskets(cells):
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(40, size=s, replace=False)) for s in [1, 2, 5, 8, 9, 30, 40, 0]]
    total = np.zeros((40, 40), dtype=int)
    for a, b, n in pair_counts([(s[i:i + 7], s[i:]) for s in sets for i in range(0, len(s), 7)], cells):
        np.add.at(total, (a, b), n)
    want = np.zeros((40, 40), dtype=int)
    for s in sets:
        for a, b in itertools.product(s, s):
            want[a, b] += a <= b
    assert (total == want).all()


def test_more_articles_than_any_former_cut(spark, log, day):
    """A catalogue of over 5,000 articles: the rarest still have neighbours and get recommended."""
    rows = [(c, a, day(0), 1.0) for c in range(520) for a in range(c * 10, c * 10 + 12)]
    model = ItemItem(log(rows))
    assert model.items.count() == 5202
    got = model.recommend(spark.createDataFrame([(519,), (3,)], "customer_id bigint"), settings=(True,))
    lists = {r.customer_id: r["items"] for r in got.collect()}
    assert set(lists[519][:10]) == set(range(5180, 5190)) and len(lists[3]) == 12


def test_growing_tables_are_not_broadcast(spark, history):
    """Factors of a sweep and bought pairs of an export grow with the log: they are joined by shuffles, not through the driver."""
    data = als.index_interactions(history)
    items = als.random_factors(data.article_ids, "article_idx", 3, 1)
    sweep = als.solved(data.customers, items, np.eye(3), 1.0)
    owned = history.withColumn("customer_id", F.col("customer_id").cast("string"))
    lists = spark.createDataFrame([("1", "discover", [1, 2])], "customer_id string, mode string, items array<bigint>")
    checks = export_checks(lists, owned, 2)
    for df, join in ((sweep, ["other"]), (checks, ["customer_id", "article_id"])):
        df.collect()
        lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and all(f"{c}#" in x for c in join)]
        assert lines and not any("BroadcastHashJoin" in x for x in lines)


def test_top_columns_breaks_ties_by_column():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 4, size=(200, 30)).astype(float)
    cols, values = top_columns(scores, 7)
    for row, c, v in zip(scores, cols, values):
        want = sorted(range(30), key=lambda j: (-row[j], j))[:7]
        assert list(c) == want and list(v) == [row[j] for j in want]


def test_fallback_only_for_customers_without_a_list(spark):
    people = spark.createDataFrame([(1, 1), (1, 2)], "week int, customer_id int")
    personal = spark.createDataFrame([(1, [7])], "customer_id int, items array<bigint>")
    fallback = spark.createDataFrame([(1, [8, 9])], "week int, items array<bigint>")
    got = {r.customer_id: r["items"] for r in with_fallback(personal, people, fallback).collect()}
    assert got == {1: [7], 2: [8, 9]}


def test_factor_scoring_agrees_with_numpy(monkeypatch, spark):
    monkeypatch.setattr(factors, "USER_BLOCK", 16)
    monkeypatch.setattr(factors, "ITEM_BLOCK", 8)
    rng = np.random.default_rng(2)
    u, v = np.round(rng.normal(size=(50, 5)), 1), np.round(rng.normal(size=(30, 5)), 1)
    users = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "user_id bigint, features array<double>")
    items = spark.createDataFrame([(100 + i, r.tolist()) for i, r in enumerate(v)], "item_id bigint, features array<double>")
    pairs = sorted({(int(a), 100 + int(b)) for a, b in zip(rng.integers(0, 50, 400), rng.integers(0, 30, 400))})
    owned = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    scores = np.round(u @ v.T, 9)
    got = factors.score_top_k(users, items, 6, owned, factors.MODES).collect()
    assert len(got) == 100
    for r in got:
        skip = {i for c, i in pairs if c == r.user_id} if r["mode"] == factors.DISCOVER else set()
        order = sorted((j for j in range(30) if 100 + j not in skip), key=lambda j: (-scores[r.user_id, j], j))[:6]
        assert r["items"] == [100 + j for j in order], r["mode"]


def test_a_task_scores_one_block_in_small_rows(monkeypatch, spark):
    for name, value in (("USER_BLOCK", 4), ("ITEM_BLOCK", 8), ("ITEM_PIECE", 3)):
        monkeypatch.setattr(factors, name, value)
    rng = np.random.default_rng(5)
    u, v = np.round(rng.normal(size=(100, 3)), 1), np.round(rng.normal(size=(30, 3)), 1)
    users = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "user_id bigint, features array<double>")
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "item_id bigint, features array<double>")
    assert max(len(r["ids"]) for r in factors.item_blocks(items).collect()) == 3
    found = factors.score_top_k(users, items, 4).withColumn("task", F.spark_partition_id()).collect()
    block = {r.user_id: r.block for r in users.select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(25)).alias("block")).collect()}
    assert len({r["task"] for r in found}) == len(set(block.values())) == len({(r["task"], block[r["user_id"]]) for r in found})
    scores = np.round(u @ v.T, 9)
    assert len(found) == 100
    for r in found:
        assert r["items"] == sorted(range(30), key=lambda j: (-scores[r["user_id"], j], j))[:4]


def test_blocks_that_cannot_win_are_skipped():
    """Norms fall fast: after the first blocks nothing can enter the lists, and nothing does."""
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(40, 4)), rng.normal(size=(400, 4))
    v *= (0.97 ** np.arange(400) / np.sqrt((v ** 2).sum(axis=1)))[:, None]
    top = factors.RunningTop(u, None, 5)
    for at in range(0, 400, 20):
        top.add(np.arange(at, at + 20), v[at:at + 20], 0.97 ** at)
    scores = np.round(u @ v.T, 9)
    for row, (ids, found) in enumerate(top.lists_between(0, 40)):
        assert ids.tolist() == sorted(range(400), key=lambda j: (-scores[row, j], j))[:5]
    assert top.seen == 20 and 5 < top.skipped < 20


@pytest.mark.parametrize("kind", ["mixed", "close", "equal", "large"])
def test_blocks_are_multiplied_once_for_both_modes(monkeypatch, kind):
    """After the first blocks only pairs that may enter a list are scored exactly; near and exact ties are settled as before."""
    rng = np.random.default_rng(7)
    u, v = rng.normal(size=(70, 6)), rng.normal(size=(600, 6))
    if kind == "close":  # scores that differ in the ninth place, far below single precision
        v = np.tile(v[0], (600, 1)) + rng.integers(0, 5, (600, 1)) * 1e-9
    elif kind == "equal":
        v = np.tile(v[:3], (200, 1))
    elif kind == "large":
        v *= 1e16
    v = v[np.argsort(-np.sqrt((v ** 2).sum(axis=1)), kind="stable")]
    owned = [np.sort(rng.choice(600, 20, replace=False)) for _ in range(70)]
    calls = []
    whole = factors.RunningTop.add_whole
    monkeypatch.setattr(factors.RunningTop, "add_whole", lambda self, *a: (calls.append(1), whole(self, *a)))
    tops = [factors.RunningTop(u, None, 5), factors.RunningTop(u, owned, 5)]
    for at in range(0, 600, 50):
        factors.add_block(tops, np.arange(at, at + 50), v[at:at + 50], np.sqrt((v[at:at + 50] ** 2).sum(axis=1)).max())
    scores = np.round(u @ v.T, 9)
    for top, skip in zip(tops, ([()] * 70, owned)):
        for row, (ids, found) in enumerate(top.lists_between(0, 70)):
            assert ids.tolist() == sorted(set(range(600)) - set(skip[row]), key=lambda j: (-scores[row, j], j))[:5], kind
            assert (found == scores[row, ids]).all()
    if kind == "mixed":
        assert len(calls) == 2  # the first block of each mode


CONFIG = {"factors": 4, "regularization": 0.1, "alpha": 10.0, "iterations": 4}


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups of customers who buy from two disjoint halves of the catalogue."""
    rng = random.Random(5)
    rows = [(c, (c % 2) * 20 + rng.randint(0, 19)) for c in range(80) for _ in range(10)]
    return spark.createDataFrame(rows, "customer_id bigint, article_id bigint")


def test_als_invariants(planted):
    data = als.index_interactions(planted)
    fitted = als.fit_als(data, CONFIG)
    again = als.fit_als(data, CONFIG)
    people = planted.select("customer_id").distinct()
    owned = {(r.customer_id, r.article_id) for r in planted.distinct().collect()}
    rows = als.recommend(fitted, people, planted, 12).collect()
    assert len(rows) == 160
    inside = 0
    for r in rows:
        assert len(r["items"]) == len(set(r["items"])) and len(r["items"]) <= 12
        if r["mode"] == "discover":
            assert not any((r.customer_id, a) in owned for a in r["items"])
        else:
            inside += sum((a // 20) == r.customer_id % 2 for a in r["items"])
    assert inside / (80 * 12) > 0.9  # a shuffled ranking would give a half
    same = {(r.customer_id, r["mode"]): r["items"] for r in als.recommend(again, people, planted, 12).collect()}
    assert same == {(r.customer_id, r["mode"]): r["items"] for r in rows}


def test_als_loss_matches_the_dense_objective_and_falls(planted):
    data = als.index_interactions(planted)
    fitted = als.fit_als(data, CONFIG)
    u = {r.idx: np.array(r.features, dtype=float) for r in fitted.users.collect()}
    v = {r.idx: np.array(r.features, dtype=float) for r in fitted.items.collect()}
    w = {(r.customer_idx, r.article_idx): r.weight for r in data.pairs.collect()}
    dense = sum((1 + CONFIG["alpha"] * w.get((i, j), 0)) * ((1 if (i, j) in w else 0) - u[i] @ v[j]) ** 2 for i in u for j in v)
    dense += CONFIG["regularization"] * (sum(x @ x for x in u.values()) + sum(x @ x for x in v.values()))
    confidence = len(u) * len(v) + CONFIG["alpha"] * sum(w.values())
    assert fitted.losses[-1] == (4, pytest.approx(dense / confidence, rel=1e-9))
    losses = [r.loss for r in als.loss_curve(data, CONFIG, (1, 2, 4)).orderBy("iteration").collect()]
    assert losses[0] > losses[1] > losses[2] and losses[2] == pytest.approx(fitted.losses[-1][1], rel=1e-12)


def dense_als(w, v, alpha, reg, sweeps):
    c = 1 + alpha * w
    p = (w > 0).astype(float)
    for _ in range(sweeps):
        u = np.stack([np.linalg.solve((v * c[i][:, None]).T @ v + reg * np.eye(v.shape[1]), (c[i] * p[i]) @ v) for i in range(len(w))])
        v = np.stack([np.linalg.solve((u * c[:, j][:, None]).T @ u + reg * np.eye(v.shape[1]), (c[:, j] * p[:, j]) @ u) for j in range(w.shape[1])])
    return u, v


@pytest.mark.parametrize("small", [False, True])
def test_als_equals_dense_solving(monkeypatch, planted, small):
    """Also with rows cut over several blocks, and when a fit goes on from another."""
    if small:
        monkeypatch.setattr(als, "BLOCK_PAIRS", 50)
        monkeypatch.setattr(als, "ROW_PAIRS", 7)
    data = als.index_interactions(planted)
    w = np.zeros((80, 40))
    for r in data.pairs.collect():
        w[r.customer_idx, r.article_idx] = r.weight
    first = als.random_factors(data.article_ids, "article_idx", 4, als.SEED).orderBy("idx").collect()
    u, v = dense_als(w, np.array([r.features for r in first]), CONFIG["alpha"], CONFIG["regularization"], 3)
    one = als.fit_als(data, {**CONFIG, "iterations": 2})
    for fitted in (als.fit_als(data, {**CONFIG, "iterations": 3}), als.fit_als(data, {**CONFIG, "iterations": 1}, start=one)):
        assert np.allclose([r.features for r in fitted.users.orderBy("idx").collect()], u)
        assert np.allclose([r.features for r in fitted.items.orderBy("idx").collect()], v)
        assert [n for n, _ in fitted.losses] == [1, 2, 3]


def brute_lambdas(rows, truncation):
    out = {}
    for c in {r["customer_id"] for r in rows}:
        group = sorted((r for r in rows if r["customer_id"] == c), key=lambda r: (-r["score"], r["article_id"]))
        disc = [1 / math.log2(p + 2) if p < truncation else 0.0 for p in range(len(group))]
        best = sum(1 / math.log2(p + 2) for p in range(min(sum(r["label"] for r in group), truncation)))
        g, h = [0.0] * len(group), [0.0] * len(group)
        for i in range(min(truncation, len(group))):
            for j in range(i + 1, len(group)):
                if group[i]["label"] == group[j]["label"]:
                    continue
                hi, lo = (i, j) if group[i]["label"] > group[j]["label"] else (j, i)
                rho = 1 / (1 + math.exp(group[hi]["score"] - group[lo]["score"]))
                delta = abs(disc[i] - disc[j]) / best
                for p, sign in ((hi, 1), (lo, -1)):
                    g[p] += sign * rho * delta
                    h[p] += rho * (1 - rho) * delta
        for p, r in enumerate(group):
            out[c, r["article_id"]] = (g[p], h[p])
    return out


def test_lambda_gradients_match_brute_force():
    rng = random.Random(7)
    rows = [{"customer_id": c, "article_id": a, "label": int(a == c or rng.random() < 0.2), "score": rng.choice([0.0, 0.5, -0.3, 1.2])}
            for c in range(6) for a in range(15)]
    want = brute_lambdas(rows, 5)
    for c in range(6):
        own = [r for r in rows if r["customer_id"] == c]
        g, h = boosting.lambda_gradients(np.array([r["score"] for r in own]), np.array([r["label"] for r in own]), 5)
        for r, x, y in zip(own, g, h):
            assert (x, y) == pytest.approx(want[c, r["article_id"]])


def test_gradients_of_many_customers_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr("basketline.functions.blocks.CELLS", 500)
    sizes = rng.integers(0, 30, 200)
    n = int(sizes.sum())
    scores, labels = np.round(rng.normal(size=n), 1), (rng.random(n) < 0.15).astype(np.int64)
    g, h = boosting.group_gradients(scores, labels, sizes, 12)
    at = 0
    for size in sizes:
        want = boosting.lambda_gradients(scores[at:at + size], labels[at:at + size], 12)
        assert np.array_equal(g[at:at + size], want[0]) and np.array_equal(h[at:at + size], want[1])  # to the last bit
        at += size


def test_histograms_of_many_nodes():
    rng = np.random.default_rng(4)
    bins, node = rng.integers(0, 256, (500, 3)).astype(np.uint8), rng.integers(0, 6, 500)
    g, h = rng.integers(-2 ** 40, 2 ** 40, 500), rng.integers(0, 2 ** 40, 500)
    found = boosting.histograms(bins, node, g, h, [4, 1, 9])
    assert list(found) == [4, 1, 9] and not found[9].any()
    for w in (4, 1):
        for f in range(3):
            for b in range(256):
                own = (node == w) & (bins[:, f] == b)
                assert found[w][f, b].tolist() == [g[own].sum(), h[own].sum(), own.sum()]


def brute_tree(bins, g, h, leaves, min_rows):
    """Best leaf first, by trying every cut of every leaf: {row: value}."""
    groups, gains = [np.arange(len(bins))], []

    def power(r):
        return g[r].sum() ** 2 / h[r].sum()

    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for cut in range(255):
                low, high = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(len(low), len(high)) >= min_rows and min(h[low].sum(), h[high].sum()) >= 1e-3:
                    gain = power(low) + power(high) - power(rows)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, f, low, high)
        return found

    while len(groups) < leaves:
        options = [(best(r), i) for i, r in enumerate(groups)]
        options = [(o, i) for o, i in options if o]
        if not options:
            break
        (gain, f, low, high), i = max(options, key=lambda x: x[0][0])
        groups[i:i + 1] = [low, high]
        gains.append((f, gain))
    return {int(r): g[rows].sum() / h[rows].sum() for rows in groups for r in rows}, gains


@pytest.mark.parametrize("leaves", [2, 5, 9])
def test_one_tree_matches_every_cut_tried(spark, leaves):
    rng = np.random.default_rng(leaves)
    bins = rng.integers(0, 12, (400, 3)).astype(np.uint8)
    g = np.rint((rng.normal(size=400) + (bins[:, 1] > 5) - (bins[:, 0] % 3)) * boosting.UNIT)
    h = np.rint((rng.random(400) + 0.1) * boosting.UNIT)
    parts = [(bytes(bins[i:i + 90].tobytes()), g[i:i + 90].astype(np.int64).tobytes(), h[i:i + 90].astype(np.int64).tobytes()) for i in range(0, 400, 90)]
    rows = spark.createDataFrame([(bytearray(b), bytearray(x), bytearray(y)) for b, x, y in parts], "bins binary, gradient binary, hessian binary").repartition(3)
    jobs = []
    count = boosting.counter(rows, 3)
    tree, gains = boosting.grow(lambda t, nodes: jobs.append(nodes) or count(t, nodes), leaves, 15)
    want, want_gains = brute_tree(bins, g / boosting.UNIT, h / boosting.UNIT, leaves, 15)
    assert tree.values(bins).tolist() == pytest.approx([want[i] for i in range(400)])
    assert [f for f, _ in gains] == [f for f, _ in want_gains] and [x for _, x in gains] == pytest.approx([x for _, x in want_gains])
    assert len(jobs) <= leaves  # leaves are counted together


def test_bins_keep_missing_below_and_cuts_whole():
    cuts = [np.array([1.0, 2.0]), np.array([])]
    assert boosting.binned([np.array([np.nan, 0, 1, 1.5, 2, 9]), np.array([np.nan, 1, 1, 1, 1, 1])], cuts).tolist() == [
        [0, 0], [1, 1], [1, 1], [2, 1], [2, 1], [3, 1]]


def test_chunks_hold_whole_groups(monkeypatch, spark, day):
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 10)
    rows = [(day(0), c, a, int(a == 1), float(a)) for c in range(30) for a in range(c % 5 + 1)]
    df = spark.createDataFrame(rows, "week date, customer_id bigint, article_id bigint, label int, x double")
    found = boosting.chunks(df, ["x"], [np.array([0.0, 1.0, 2.0, 3.0])], ["week", "customer_id"], "article_id").collect()
    sizes = [np.frombuffer(r["sizes"], np.int32) for r in found]
    assert sorted(np.concatenate(sizes)) == sorted(c % 5 + 1 for c in range(30)) and len(found) > 4
    for r, n in zip(found, sizes):
        assert np.frombuffer(r["bins"], np.uint8).tolist() == [a + 1 for size in n for a in range(size)]


def test_ranker_learns_a_planted_feature(spark, day):
    rng = random.Random(11)
    rows = []
    for c in range(120):
        good = rng.sample(range(20), 3)
        rows += [(day(0), c, a, int(a in good), float(a in good) + rng.gauss(0, 0.3), rng.random(), float(a)) for a in range(20)]
    names = ("signal", "noise", "source_rank")
    df = spark.createDataFrame(rows, "week date, customer_id bigint, article_id bigint, label int, signal double, noise double, source_rank double")
    fitted = ranker.train_ranker(df, rounds=6, learning_rate=0.3, leaves=6, min_rows=5, truncation=5, checkpoint_every=2, columns=names)
    shares = dict(fitted.importances())
    assert shares["signal"] > 0.9 and sum(shares.values()) == pytest.approx(1.0)
    lists = ranker.lists_by(fitted.score(df), [F.desc("score")], 3)
    truth = df.filter("label = 1").select("customer_id", "article_id")
    hits = lists.select("customer_id", F.explode("items").alias("article_id")).join(truth, ["customer_id", "article_id"], "left_semi").count()
    assert hits / 360 > 0.6  # a shuffled ranking would find 3 in 20
