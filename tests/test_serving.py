"""Export, load, refresh, lookup and the stores."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketline.functions.lists import array_literal, parse_array_literal
from basketline.operators import als, folds, guards
from basketline.operators.lookup import FALLBACK_SOURCE, resolve
from basketline.plans import reranking, serving
from basketline.sources import artifact, sinks, versions
from basketline.sources.keyed import KeyedTable
from basketline.sources.score_store import ScoreStore
from basketline.streaming.lookup import answer_stream, request_stream

HEX = {n: format(n, "064x") for n in range(1, 6)}
TWELVE = list(range(100, 112))


@pytest.fixture
def lists(spark):
    rows = [(HEX[c], m, [a + c + (50 if m == "discover" else 0) for a in TWELVE]) for c in (1, 2) for m in ("repurchase", "discover")]
    return spark.createDataFrame(rows, "customer_id string, mode string, items array<bigint>")


@pytest.fixture
def owned(spark):
    return spark.createDataFrame([(HEX[1], 101)], "customer_id string, article_id bigint")


@pytest.fixture
def fallback(spark):
    rows = [(FALLBACK_SOURCE, dt.date(2024, 1, d), 7, [d] + TWELVE[1:], f"v{d}") for d in (8, 1)]
    return spark.createDataFrame(rows, "source string, as_of date, window_days int, items array<bigint>, model_version string")


def test_literal_round_trip(spark):
    row = spark.createDataFrame([([3, 1, 2],)], "items array<bigint>").select(
        array_literal("items").alias("t")).select("t", parse_array_literal(F.concat(F.lit(" "), "t")).alias("items")).first()
    assert (row.t, row["items"]) == ("{3,1,2}", [3, 1, 2])


META = {"history_end": dt.date(2024, 1, 8)}


def test_export_is_checked_and_shown_last(spark, lists, owned, fallback, tmp_path):
    root = str(tmp_path / "export")
    summary = sinks.export_lists(lists, owned, root, "v", fallback, META)
    assert (summary["rows"], summary["customers_exported"], summary["partial_export"]) == (4, 2, False)
    assert summary["checks_passed"] == ["row_count_and_distinct", "no_bought_in_discover"]  # no input for the others
    folder = sinks.export_folder(spark, root)
    assert guards.list_parity(lists, sinks.load_recommendations(spark, f"{folder}/recommendations"), ["customer_id", "mode"]).first().share_identical == 1.0
    manifest = sinks.load_manifest(spark, root)
    assert manifest == summary and manifest["history_end"] == "2024-01-08" and all(n > 0 for n in manifest["files"].values())
    assert sinks.load_fallbacks(spark, f"{folder}/fallback").count() == 2
    with pytest.raises(FileExistsError):
        sinks.export_lists(lists, owned, root, "v", fallback, META)
    part = sinks.export_lists(lists, owned, root, "v2", fallback, META, overwrite=True, limit=1)
    assert (part["rows"], part["partial_export"]) == (2, True) and sinks.load_manifest(spark, root)["model_version"] == "v2"


def gate_inputs(spark, lists, owned, fallback):
    """Arguments with which all six gates run and pass."""
    articles = spark.createDataFrame([(a,) for a in range(1, 200)], "article_id bigint")
    return {"lists": lists, "owned": owned, "version": "v", "fallback": fallback.limit(1), "meta": META, "customers": lists.select("customer_id").distinct(),
            "articles": articles, "history_end": dt.date(2024, 1, 8), "recompute": lambda some: lists.join(some, "customer_id", "left_semi")}


def test_all_gates_pass_in_order(spark, lists, owned, fallback, tmp_path):
    summary = sinks.export_lists(root=str(tmp_path / "e"), **gate_inputs(spark, lists, owned, fallback))
    assert summary["checks_passed"] == list(sinks.GATES)


@pytest.mark.parametrize("gate, message", [
    ("ids", "bad_customer_ids"), ("articles", "repeated_article_ids"), ("fallback", "bad_fallback"), ("history_end", "the history ends"), ("sizes", "wrong_size"),
    ("repeats", "with_repeats"), ("rows", "rows for"), ("modes", "without_both_modes"), ("bought", "owned_in_discover"), ("parity", "recomputation")])
def test_each_gate_refuses_and_the_old_export_stays(spark, lists, owned, fallback, tmp_path, gate, message):
    root, good = str(tmp_path / "e"), gate_inputs(spark, lists, owned, fallback)
    sinks.export_lists(root=root, **good)
    bad = {
        "ids": {"customers": good["customers"].unionByName(spark.createDataFrame([("xyz",)], "customer_id string"))},
        "articles": {"articles": good["articles"].unionByName(good["articles"].limit(1))},
        "fallback": {"articles": good["articles"].filter("article_id <> 105")},
        "history_end": {"history_end": dt.date(2024, 1, 9)},
        "sizes": {"lists": lists.withColumn("items", F.slice("items", 1, 11))},
        "repeats": {"lists": lists.withColumn("items", F.concat(F.slice("items", 1, 11), F.slice("items", 1, 1)))},
        "rows": {"customers": good["customers"].unionByName(spark.createDataFrame([(HEX[4],)], "customer_id string"))},
        "modes": {"lists": lists.filter(f"NOT (mode = 'discover' AND customer_id = '{HEX[1]}')")},
        "bought": {"owned": spark.createDataFrame([(HEX[2], 152)], "customer_id string, article_id bigint")},
        "parity": {"recompute": lambda some: lists.withColumn("items", F.reverse("items"))},
    }[gate]
    with pytest.raises(ValueError, match=message):
        sinks.export_lists(root=root, overwrite=True, **{**good, "version": "new", **bad})
    assert sinks.load_manifest(spark, root)["model_version"] == "v"


def test_a_run_that_dies_before_the_switch_changes_nothing(monkeypatch, spark, lists, owned, fallback, tmp_path):
    root, good = str(tmp_path / "e"), gate_inputs(spark, lists, owned, fallback)
    sinks.export_lists(root=root, **good)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "switch", dies)
    with pytest.raises(KeyboardInterrupt):
        sinks.export_lists(root=root, overwrite=True, **{**good, "version": "new"})
    assert sinks.load_manifest(spark, root)["model_version"] == "v"
    assert sinks.load_recommendations(spark, f"{sinks.export_folder(spark, root)}/recommendations").count() == 4


def test_load_replaces_both_tables_or_neither(spark, lists, owned, fallback, tmp_path):
    root, tables, good = str(tmp_path / "e"), str(tmp_path / "t"), gate_inputs(spark, lists, owned, fallback)
    sinks.export_lists(root=root, **good)
    assert {(r["mode"], r.model_version, r.customers) for r in sinks.load_export(spark, root, tables).collect()} == {("repurchase", "v", 2), ("discover", "v", 2)}
    assert sinks.served_fallbacks(spark, tables).read().count() == 1
    sinks.export_lists(root=root, overwrite=True, limit=1, **{**good, "version": "part"})
    with pytest.raises(ValueError, match="partial"):
        sinks.load_export(spark, root, tables)
    assert sinks.served_recommendations(spark, tables).select("model_version").distinct().first()[0] == "v"
    assert sinks.load_export(spark, root, tables, partial=True).first().customers == 1


@pytest.mark.parametrize("column, rows, lists_", [
    ("customer_id", "concat(customer_id, 'x')", {}), ("mode", None, {"mode": "'other'"}), ("items", None, {"items": "slice(items, 1, 11)"}),
    ("model_version", None, {"model_version": "cast(null as string)"})])
def test_constraints_of_the_recommendations(spark, lists, fallback, column, rows, lists_):
    loaded = lists.withColumn("model_version", F.lit("v"))
    broken = loaded.withColumn(column, F.expr(rows or lists_[column]))
    assert not any(sinks.broken_constraints(loaded, fallback).first().asDict().values())
    assert sinks.broken_constraints(broken, fallback).first()[column] == 4
    assert sinks.broken_constraints(loaded.unionByName(loaded.limit(1)), fallback).first().repeated_keys == 1


def test_constraints_of_the_fallback_lists(spark, lists, fallback):
    loaded = lists.withColumn("model_version", F.lit("v"))
    for name, column, value in (("fallback_window", "window_days", "0"), ("fallback_items", "items", "slice(items, 1, 3)"),
                                ("fallback_key", "source", "cast(null as string)"), ("fallback_version", "model_version", "cast(null as string)")):
        assert sinks.broken_constraints(loaded, fallback.withColumn(column, F.expr(value))).first()[name] == 2
    assert sinks.broken_constraints(loaded, fallback.unionByName(fallback)).first().repeated_fallback_keys == 2


def test_keyed_table_writes_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), ["a", "b"], "a int, b string, v int", buckets=8)
    assert table.read().count() == 0 and table.upsert(table.read()) == []
    table.upsert(spark.createDataFrame([(n, None if n % 3 else "x", n) for n in range(40)], "a int, b string, v int"))
    before = table.index()
    touched = table.upsert(spark.createDataFrame([(1, None, 100), (50, "y", 50)], "a int, b string, v int"))
    after = table.index()
    assert {b for b in before if before[b] != after[b]} <= set(touched) and 1 <= len(touched) <= 2 < len(before)
    got = {(r.a, r.b): r.v for r in table.read().collect()}
    assert got == {**{(n, None if n % 3 else "x"): n for n in range(40)}, (1, None): 100, (50, "y"): 50}
    with pytest.raises(ValueError, match="repeat a key"):
        table.upsert(spark.createDataFrame([(7, "q", 1), (7, "q", 2)], "a int, b string, v int"))
    assert table.index() == after


@pytest.fixture
def served(spark, lists, owned, fallback, tmp_path):
    """Served tables whose newest fallback list is of 2024-01-08."""
    root, tables = str(tmp_path / "e"), str(tmp_path / "t")
    good = gate_inputs(spark, lists, owned, fallback)
    sinks.export_lists(root=root, **{**good, "fallback": fallback.filter("model_version = 'v8'")})
    sinks.load_export(spark, root, tables)
    return tables


def sales(spark, n_articles=14):
    rows = [(a, dt.date(2024, 1, d)) for d in range(1, 16) for a in range(1, n_articles + 1) for _ in range(a if d > 8 else 1)]
    return spark.createDataFrame(rows, "article_id bigint, t_dat date")


def test_refresh_writes_and_reads_back(spark, served):
    found = serving.refresh_fallback(spark, served, sales(spark), dt.date(2024, 1, 15), dry_run=True)
    assert not found.written and sinks.served_fallbacks(spark, served).read().count() == 1
    found = serving.refresh_fallback(spark, served, sales(spark), dt.date(2024, 1, 15))
    assert found.items == list(range(14, 2, -1)) and found.served_as_of == dt.date(2024, 1, 8) and found.kept == 1
    assert (found.window_start, found.first_sale, found.last_sale) == (dt.date(2024, 1, 9), dt.date(2024, 1, 1), dt.date(2024, 1, 15))
    rows = {r.as_of.day: (r.model_version, r["items"][0]) for r in sinks.served_fallbacks(spark, served).read().collect()}
    assert rows == {8: ("v8", 8), 15: ("v8", 14)}  # the version is carried over
    assert serving.refresh_fallback(spark, served, sales(spark), dt.date(2024, 1, 15)).kept == 12  # again: the same row


@pytest.mark.parametrize("day, days, articles, message", [
    (16, 7, 14, "future day"), (8, 8, 14, "not covered"), (7, 3, 14, "already newer"), (15, 7, 11, "11 articles")])
def test_each_refusal_leaves_the_served_list(spark, served, day, days, articles, message):
    with pytest.raises(ValueError, match=message):
        serving.refresh_fallback(spark, served, sales(spark, articles), dt.date(2024, 1, day), days)
    assert [r.as_of.day for r in sinks.served_fallbacks(spark, served).read().collect()] == [8]


def test_refresh_needs_a_served_list(spark, served):
    with pytest.raises(LookupError, match="load an export first"):
        serving.refresh_fallback(spark, served, sales(spark), dt.date(2024, 1, 15), source="other")


def test_a_saved_model_is_exported_through_all_gates(spark, tmp_path):
    rng = random.Random(2)
    rows = [(HEX[c], a, dt.date(2024, 1, 1 + a % 8)) for c in HEX for a in [*rng.sample(range(1, 31), 9), 7, 12]]
    history = spark.createDataFrame(rows, "customer_id string, article_id bigint, t_dat date")
    fitted = als.fit_als(als.index_interactions(history), {"factors": 3, "regularization": 0.1, "alpha": 15.0, "iterations": 2})
    popular = [r.article_id for r in history.groupBy("article_id").count().orderBy(F.desc("count"), "article_id").limit(12).collect()]
    path, root = str(tmp_path / "model"), str(tmp_path / "e")
    artifact.save_artifact(fitted, path, popular, max(r[2] for r in rows))
    summary = serving.export_artifact(spark, path, history, root)
    assert summary["checks_passed"] == list(sinks.GATES) and summary["rows"] == 10 and not summary["partial_export"]
    assert summary["model_version"] == "als-f3-r0.1-a15-i2-h2024-01-08"
    with pytest.raises(ValueError, match="the history ends"):
        serving.export_artifact(spark, path, history.filter("t_dat < '2024-01-05'"), str(tmp_path / "f"))


def test_a_saved_model_gives_its_recorded_map(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, a, dt.date(2024, 1, 1 + a % 8)) for c in range(12) for a in rng.sample(range(30), 9)]
    history = spark.createDataFrame(rows, "customer_id bigint, article_id bigint, t_dat date")
    truth = spark.createDataFrame([(1, c, a) for c in range(15) for a in rng.sample(range(30), 4)], "week int, customer_id bigint, article_id bigint")
    fitted = als.fit_als(als.index_interactions(history), {"factors": 3, "regularization": 0.1, "alpha": 15.0, "iterations": 2})
    popular, end = list(range(12)), dt.date(2024, 1, 8)
    artifact.save_artifact(fitted, str(tmp_path / "m"), popular, end)
    found = serving.reproduced_map(artifact.load_artifact(spark, str(tmp_path / "m")), history, truth)
    lists = {(r.customer_id, r["mode"]): r["items"] for r in als.recommend(fitted, truth, history).collect()}
    for mode, value in found.items():
        total = 0.0
        for c in range(15):
            want, hits, gain = {r.article_id for r in truth.collect() if r.customer_id == c}, 0, 0.0
            for rank, a in enumerate(lists.get((c, mode), popular), 1):
                if a in want:
                    hits += 1
                    gain += hits / rank
            total += gain / 4 / 15
        assert value == pytest.approx(total)
    artifact.save_artifact(fitted, str(tmp_path / "n"), popular, end, recorded_map={**found, "discover": found["discover"] + 0.001})
    with pytest.raises(ValueError, match="recorded"):
        serving.reproduced_map(artifact.load_artifact(spark, str(tmp_path / "n")), history, truth)


def test_ranker_runs_are_logged_beside_each_other(spark, tmp_path):
    metrics = spark.createDataFrame([("ranker", "aggregate", 3, 0.2, 0.5), ("pop7d", "aggregate", 3, 0.1, 0.4)],
                                    "model string, scope string, n_customers bigint, map double, hit_rate double")
    gaps = spark.createDataFrame([("ranker", "pop7d", "aggregate", 100.0, "[+0.1, +0.2] *")], "a_model string, b_model string, scope string, rel_pct double, ci string")
    reranking.log_run(str(tmp_path / "r"), reranking.run_rows(metrics, gaps, "one", {"rounds": 6}))
    log = reranking.log_run(str(tmp_path / "r"), reranking.run_rows(metrics.filter("model = 'ranker'"), gaps, "two", {"rounds": 9, "leaves": 15}))
    rows = {r.run: r for r in log.collect()}
    assert (rows["one"].rounds, rows["one"].leaves, rows["one"]["pop7d map"], rows["one"]["ranker vs pop7d ci"]) == (6, None, 0.1, "[+0.1, +0.2] *")
    assert (rows["two"].leaves, rows["two"]["pop7d map"], rows["two"]["ranker hit_rate"]) == (15, None, 0.5)


def test_candidates_must_cover_the_evaluated_customers(spark, log, day):
    fold = folds.build_folds(log([(1, 1, day(0), 1.0), (1, 2, day(8), 1.0), (2, 2, day(8), 1.0)]), [day(7)])
    both = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    reranking.require_covering(fold, both)
    reranking.require_covering(fold, both.filter("customer_id = 1"), discover=True)
    for bad, message in ((both.filter("customer_id = 1"), "have no candidates"), (spark.createDataFrame([(1,), (2,), (3,)], "customer_id bigint"), "not evaluated")):
        with pytest.raises(ValueError, match=message):
            reranking.require_covering(fold, bad)


def test_upsert_is_idempotent_and_carries_the_version(spark, fallback):
    items = spark.createDataFrame([(TWELVE,)], "items array<bigint>")
    added = sinks.upsert_fallback(fallback, items, F.lit(dt.date(2024, 1, 15)), FALLBACK_SOURCE)
    rows = {r.as_of.day: (r.model_version, r["items"][0]) for r in added.collect()}
    assert rows == {1: ("v1", 1), 8: ("v8", 8), 15: ("v8", 100)}
    again = sinks.upsert_fallback(added, items, F.lit(dt.date(2024, 1, 15)), FALLBACK_SOURCE)
    assert sorted(map(str, again.collect())) == sorted(map(str, added.collect()))
    replaced = sinks.upsert_fallback(fallback, items, F.lit(dt.date(2024, 1, 1)), FALLBACK_SOURCE)
    assert {r.as_of.day: (r.model_version, r["items"][0]) for r in replaced.collect()} == {1: ("v1", 100), 8: ("v8", 8)}
    assert sinks.upsert_fallback(fallback.filter("false"), items, F.lit(dt.date(2024, 1, 1)), FALLBACK_SOURCE).count() == 0


def test_refresh_dates(spark):
    lo, hi, latest = dt.date(2024, 1, 1), dt.date(2024, 3, 1), dt.date(2024, 2, 20)

    def dates(as_of, served=latest):
        return spark.createDataFrame([(as_of, lo, hi, served)], "as_of date, first_sale date, last_sale date, served date")

    for good in (latest, hi, dt.date(2024, 2, 25)):
        guards.require_refreshable(dates(good))
    for bad, served, why in ((dt.date(2024, 3, 2), latest, "future day"), (dt.date(2024, 2, 19), latest, "already newer"),
                             (dt.date(2024, 1, 7), lo, "not covered")):
        with pytest.raises(ValueError, match=why):
            guards.require_refreshable(dates(bad, served))


def requests(spark):
    rows = [(1, HEX[1], "discover"), (2, HEX[1], None), (3, HEX[5], "repurchase"), (4, HEX[1].upper().replace("0", "A"), None),
            (5, " " + HEX[1], None), (6, HEX[1], "other"), (7, None, None), (8, HEX[1] + "\n", None)]
    return spark.createDataFrame(rows, "request_id bigint, customer_id string, mode string")


def test_lookup_statuses(spark, lists, fallback):
    recs = lists.withColumn("model_version", F.lit("m"))
    got = {r.request_id: r for r in resolve(requests(spark), recs, fallback).collect()}
    assert {n: r.status for n, r in got.items()} == {1: 200, 2: 200, 3: 200, 4: 400, 5: 400, 6: 400, 7: 400, 8: 400}
    assert (got[1].source, got[1]["items"][0], got[1].model_version) == ("als", 151, "m")
    assert (got[2]["mode"], got[2]["items"][0]) == ("repurchase", 101)
    assert (got[3].source, got[3].model_version, got[3]["items"][0]) == (FALLBACK_SOURCE, "v8", 8)
    assert (got[6].source, got[6]["items"]) == (None, None)
    empty = {r.request_id: r.status for r in resolve(requests(spark), recs, fallback.filter("false")).collect()}
    assert (empty[1], empty[3], empty[6]) == (200, 503, 400)


def test_lookup_over_a_stream(spark, lists, fallback, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    asked = requests(spark).filter("request_id <= 3").toJSON().collect()
    (source / "a.json").write_text("\n".join(asked))
    run = answer_stream(request_stream(spark, str(source)), lists.withColumn("model_version", F.lit("m")), fallback, out, str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert {r.request_id: r.source for r in spark.read.parquet(out).collect()} == {1: "als", 2: "als", 3: FALLBACK_SOURCE}


def test_result_table_replaces_keys(spark):
    old = spark.createDataFrame([(1, "x", 1), (1, "old", 2), (2, "old", 3)], "week int, config string, v int")
    new = spark.createDataFrame([(1, "y", 9)], "week int, config string, v int")
    got = sinks.replace_keys(old, new, ["week", "config"], {"config": {"old": "y"}}).collect()
    assert {(r.week, r.config, r.v) for r in got} == {(1, "x", 1), (2, "y", 3), (1, "y", 9)}


def test_store_resumes(spark, tmp_path):
    store, calls = ScoreStore(spark, str(tmp_path / "s")), []

    def score(week, config):
        calls.append((week, config))
        return spark.createDataFrame([("m", 1, 0.5)], "model string, customer_id bigint, ap double")

    weeks = [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    assert store.fill(weeks[:1], ["a", "b"], score) == 2
    assert store.missing(weeks, ["a", "b"]) == [(weeks[1], "a"), (weeks[1], "b")]
    assert store.fill(weeks, ["a"], score) == 1 and len(calls) == 3
    assert store.read(weeks).count() == 3 and store.read(weeks[1:]).first().config == "a"


def test_structure_checks_find_bad_vectors(spark):
    rows = [(1, [0.0, 0.0]), (1, [1.0, float("nan")]), (2, [1.0])]
    r = guards.structure_checks(spark.createDataFrame(rows, "id bigint, features array<double>"), "id").first()
    assert (r.n_rows, r.min_size, r.max_size, r.non_finite, r.repeated_ids, r.zero_vectors) == (3, 1, 2, 1, 1, 1)
