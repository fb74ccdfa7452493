"""Queries against their SQL on tables that are longer than a page or a walk's default bound."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from curriq.plans import queries as plans

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def longer(spark, tmp_path_factory):
    """Nation 3 with 2,100 customers of an order each; 300 documents, 166 of them with one code."""
    path = tmp_path_factory.mktemp("longer")
    for name in ("region", "nation"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").coalesce(1).write.parquet(f"{path}/{name}.parquet")
    k = F.col("id")
    made = {
        "customer": spark.range(2100).select(k.alias("c_custkey"), F.lit(3).alias("c_nationkey")), "orders": spark.range(2100).select(k.alias("o_orderkey"), k.alias("o_custkey")),
        "documents": spark.range(300).select((7 + F.when(k < 250, 350 * k).otherwise(k)).alias("doc_id"), F.lit("text").alias("text"), F.when(k % 3 == 0, "en").otherwise("es").alias("lang"), F.concat(F.lit("s"), k % 4).alias("source")),
    }
    for name, rows in made.items():
        rows.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("region", "nation", *made):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name,rows", [("code_page", 150), ("context_sections", 6)])
def test_longer_tables(spark, longer, name, rows):
    path, con = longer
    got, want = plans.QUERIES[name](spark, path).toPandas(), con.execute(plans.SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want) >= rows
    listed = lambda d: sorted(map(repr, d[columns].values.tolist()))
    assert listed(got) == listed(want)
