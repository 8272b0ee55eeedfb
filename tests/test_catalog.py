"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cartoloom.plans import registry as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return str(x)
    try:
        return round(float(x), 4)
    except (TypeError, ValueError):
        return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    assert have == want


def test_entry_gives_three_rows_a_passage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 120
