"""Preparation flow: clean, number customers, split by date, check, write."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketline.operators import prepare
from basketline.operators.folds import check_split, temporal_split
from basketline.sources.sinks import write_prepared


def prepared_log(log: DataFrame, lookup: DataFrame, val_weeks: int = 1, test_weeks: int = 1) -> DataFrame:
    return temporal_split(prepare.apply_customer_idx(prepare.clean_transactions(log), lookup), val_weeks, test_weeks)


def run(log: DataFrame, customers: DataFrame, articles: DataFrame, out_dir: str, val_weeks: int = 1,
        test_weeks: int = 1) -> dict[str, int]:
    """Write the prepared tables and return the rows per split."""
    people = prepare.clean_customers(customers)
    lookup = prepare.customer_id_lookup(people)
    split_log = prepared_log(log, lookup, val_weeks, test_weeks)
    counts = check_split(split_log, prepare.clean_transactions(log).count())
    write_prepared(out_dir, split_log, prepare.apply_customer_idx(people, lookup), prepare.clean_articles(articles), lookup)
    return counts
