"""Every registered query on the smallest tables, against its SQL where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def printed(frame, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SF_DIR).toPandas()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetch_df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert printed(got, columns) == printed(want, columns)


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.count() > 0 and "map" in rows.columns
