"""The Bloom filter keeps filtering on long lists, broadcast or met by block."""

import pytest
from pyspark.sql import functions as F

from curriq.llm import op9_urls as op9


@pytest.mark.parametrize("broadcast", [op9.BROADCAST_BLOCKS, 0])
def test_share_of_unlisted_urls_that_pass(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op9, "BROADCAST_BLOCKS", broadcast)
    n = 5_000_000 if broadcast else 200_000
    url = F.concat(F.lit("host.org/page/"), F.col("id").cast("string"))
    listed = spark.range(n).select(url.alias("canonical"))
    others = spark.range(n, n + 200_000).select("id", url.alias("canonical"))
    own = spark.range(0, n, n // 1000).select("id", url.alias("canonical"))
    tried = op9.filtered(others.unionByName(own), listed, n)
    row = tried.agg(F.count_if((F.col("id") >= n) & F.col("maybe")).alias("false"), F.count_if((F.col("id") < n) & F.col("maybe")).alias("true")).first()
    assert row["true"] == 1000 and row["false"] < 0.05 * 200_000


def test_listed_urls_are_found_whatever_the_filter_passes(spark):
    listed = spark.createDataFrame([("a/1",), ("a/1",), ("b",), ("",)], "canonical string")
    urls = spark.createDataFrame([(1, "a/1"), (2, "b"), (3, "c"), (4, ""), (5, "a/1")], "page_id long, canonical string")
    assert {r.page_id: r.listed for r in op9.listed_hits(urls, listed).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert op9.blocks_for(0) == op9.LEAST_BLOCKS and op9.blocks_for(5_000_000) * op9.URLS_PER_BLOCK >= 5_000_000
