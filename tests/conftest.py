from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def day():
    """day(n): n days after a fixed start."""
    return lambda n: dt.date(2024, 3, 1) + dt.timedelta(days=n)


@pytest.fixture
def log(spark):
    """log([(customer, article, date, price)]) as a frame."""
    return lambda rows: spark.createDataFrame(rows, "customer_id bigint, article_id bigint, t_dat date, price double")
