"""Every query of the relational tables against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from curriq.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.SQL) == set(plans.QUERIES) <= set(__spark_entry__.queries())
