"""Windowed popularity counts and the lists built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.functions.lists import to_lists, top_k
from basketline.functions.windows import days_ending_at, days_of_history, history_ends, window_label
from basketline.session import materialize

K = 12


def count_order() -> tuple[Column, Column]:
    """Count descending, then the lower article id: the one tie rule used everywhere."""
    return F.desc("cnt"), F.asc("article_id")


def article_counts(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return log.groupBy(*by, "article_id").agg(F.count(F.lit(1)).alias("cnt"))


def top_articles(log: DataFrame, k: int = K) -> DataFrame:
    """All-time top k of a log, ranked."""
    ranked = article_counts(log).orderBy(*count_order()).limit(k)
    return top_k(ranked.withColumn("_all", F.lit(1)), ["_all"], count_order(), k).drop("_all")


def recent_top(log: DataFrame, as_of: Column, days: int = 7, k: int = K) -> DataFrame:
    """Top k of the days ending at a given date, for a dated refresh."""
    return top_articles(days_ending_at(log, as_of, days), k)


def window_counts(history: DataFrame, windows: Sequence[int | None]) -> DataFrame:
    """Counts per (week, window, article) for several trailing windows in one aggregation.

    A window covers t_dat > last history day - days, per week; None is all of the history. Each row
    is tagged with the windows it falls in before the partial aggregate, so the log is read once; the
    last days are literals, so short windows read few files.
    """
    bounded = [d for d in windows if d is not None]
    ends = history_ends(history) if bounded else []
    rows = history if None in windows else days_of_history(history, ends, max(bounded))
    end = F.coalesce(*[F.when(F.col("week") == F.lit(w), F.lit(e)) for w, e in ends], F.lit(None).cast("date"))
    tags = F.array(*[F.lit(window_label(None)) if d is None else F.when(F.datediff(end, "t_dat") < d, window_label(d)) for d in windows])
    tagged = rows.select("week", "article_id", F.explode(tags).alias("window")).filter(F.col("window").isNotNull())
    return article_counts(tagged, ["week", "window"])


def popularity_lists(history: DataFrame, windows: Sequence[int | None], k: int) -> DataFrame:
    """(week, window, items): the k best sellers of each window as one short array per week."""
    ranked = top_k(window_counts(history, windows), ["week", "window"], count_order(), k)
    return to_lists(ranked, ["week", "window"])


def same_list_for_all(customers: DataFrame, lists: DataFrame, k: int = K) -> DataFrame:
    """Everyone in a week gets that week's list; the lists table has one row per week and window."""
    short = lists.withColumn("items", F.slice("items", 1, k))
    return customers.join(F.broadcast(short), "week")


def owned_in_pool(history: DataFrame, lists: DataFrame, customers: DataFrame) -> DataFrame:
    """(week, customer_id, owned): pool articles that each of the customers has bought.

    The history shrinks to pool articles first; the array of a customer is never longer than a list.
    """
    pool = lists.select("week", F.explode("items").alias("article_id")).distinct()
    return (history.select("week", "customer_id", "article_id")
            .join(customers.select("week", "customer_id"), ["week", "customer_id"], "left_semi")
            .join(pool, ["week", "article_id"], "left_semi")
            .groupBy("week", "customer_id").agg(F.collect_set("article_id").alias("owned")))


def _missing_first(lists: DataFrame, counts: DataFrame, people: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Lists of customers whose purchases fill most of the short lists: week, customer_id, window, items.

    The n-th article that a customer does not own stands at the n-th position that none of the own
    purchases takes, so each list costs the customer's own basket and k positions to look up. The
    ranking goes as deep as the largest of these baskets and is joined, never broadcast.
    """
    bought = materialize(history.select("week", "customer_id", "article_id").join(people, ["week", "customer_id"], "left_semi").distinct())
    largest = bought.groupBy("week", "customer_id").count().agg(F.max("count")).first()[0] or 0
    ranked = materialize(top_k(counts, ["week", "window"], count_order(), k + largest).select("week", "window", "article_id", "rank"))
    taken = bought.join(ranked, ["week", "article_id"]).groupBy("week", "window", "customer_id").agg(F.collect_list("rank").alias("taken"))
    asked = people.join(lists.select("week", "window"), "week").join(taken, ["week", "window", "customer_id"], "left")
    taken = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.size(taken) + k), taken), 1, k)
    places = asked.select("week", "window", "customer_id", F.posexplode(free).alias("at", "rank"))
    found = to_lists(places.join(ranked, ["week", "window", "rank"]), ["week", "window", "customer_id"], rank="at")
    return (asked.select("week", "window", "customer_id").join(found, ["week", "window", "customer_id"], "left")
            .withColumn("items", F.coalesce("items", F.array().cast("array<bigint>"))))


def _lists(customers: DataFrame, history: DataFrame, windows: Sequence[int | None], k: int, settings: Sequence[bool]) -> DataFrame:
    counts = materialize(window_counts(history, windows))
    lists = materialize(to_lists(top_k(counts, ["week", "window"], count_order(), 2 * k), ["week", "window"]))
    owned = materialize(owned_in_pool(history, lists, customers))
    many = F.size("owned") > k  # with more, 2 k positions may not hold k articles that are new
    given = customers.join(owned.filter(~many), ["week", "customer_id"], "left").join(F.broadcast(lists), "week")
    new = F.slice(F.array_except("items", F.coalesce("owned", F.array().cast("array<bigint>"))), 1, k)
    kinds = {True: F.struct(F.lit(True).alias("exclusion"), new.alias("items")),
             False: F.struct(F.lit(False).alias("exclusion"), F.slice("items", 1, k).alias("items"))}
    deep = owned.filter(many).select("week", "customer_id")
    if deep.isEmpty():
        return given.select(*customers.columns, "window", F.inline(F.array(*[kinds[s] for s in settings])))
    plain = given.select(*customers.columns, "window", F.inline(F.array(kinds[False]))) if False in settings else None
    if True not in settings:
        return plain
    shallow = given.join(deep, ["week", "customer_id"], "left_anti").select(*customers.columns, "window", F.inline(F.array(kinds[True])))
    rest = customers.join(_missing_first(lists, counts, deep, history, k), ["week", "customer_id"]).select(
        *customers.columns, "window", F.lit(True).alias("exclusion"), "items")
    out = shallow.unionByName(rest)
    return out if plain is None else out.unionByName(plain)


def exclusion_lists(customers: DataFrame, history: DataFrame, windows: Sequence[int | None], k: int = K) -> DataFrame:
    """The first k articles of each window that each customer does not own; fewer only if the window sold fewer.

    Everyone gets the first k new ones out of 2 k positions; the few who own more than k of these
    get theirs by position, however deep.
    """
    return _lists(customers, history, windows, k, (True,)).drop("exclusion")


def recency_lists(customers: DataFrame, history: DataFrame, windows: Sequence[int | None], k: int = K) -> DataFrame:
    """Lists of every window under both exclusion settings: week, customer_id, window, exclusion, items."""
    return _lists(customers, history, windows, k, (True, False))
