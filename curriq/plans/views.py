"""Graph views over relational tables: hierarchies, supports and progressions between parts, as canonical nodes and edges.

Each view is a DataFrame; SQL has the same views for checks in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.session import cut, dealt, forget, loop_dir, table


def ident(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _edges(rows: DataFrame, source: Column, target: Column, seo: str | None) -> DataFrame:
    return rows.select(F.concat(F.lit("h:"), source, F.lit(">"), target).alias("edge_id"), source.alias("source"), target.alias("target"), (F.col(seo) if seo else F.lit(0)).cast("long").alias("seo"))


def upper_tree(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    return _edges(region, F.lit("root"), ident("R", "r_regionkey"), "r_regionkey").unionByName(_edges(nation, ident("R", "n_regionkey"), ident("N", "n_nationkey"), "n_nationkey"))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """root > region > nation > customer > order."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    return upper_tree(spark, sf).unionByName(_edges(customer, ident("N", "c_nationkey"), ident("C", "c_custkey"), "c_custkey")).unionByName(_edges(orders, ident("C", "o_custkey"), ident("O", "o_orderkey"), "o_orderkey"))


def supplier_tree(spark: SparkSession, sf: str) -> DataFrame:
    """root > region > nation > supplier."""
    return upper_tree(spark, sf).unionByName(_edges(table(spark, sf, "supplier"), ident("N", "s_nationkey"), ident("S", "s_suppkey"), "s_suppkey"))


def dag(spark: SparkSession, sf: str) -> DataFrame:
    """root > region > nation > supplier > part, a part below each of its suppliers."""
    sold = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return supplier_tree(spark, sf).unionByName(_edges(sold, ident("S", "l_suppkey"), ident("P", "l_partkey"), "l_partkey"))


def supports(spark: SparkSession, sf: str) -> DataFrame:
    """component (order), standard (part), confidence: of a pair's lines, the one of the least discount.

    Lines are dealt by order to tasks of bounded size and sorted there, so no task holds a map of its pairs, and what is
    grouped by l_orderkey, or by l_orderkey and l_partkey, isn't shuffled again.
    """
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount"), "l_orderkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy(F.asc_nulls_last("l_discount")))
    rows = lines.withColumn("nth", nth).where("nth = 1").withColumn("confidence", 1 - F.col("l_discount"))
    return rows.select(F.concat(F.lit("s:"), ident("O", "l_orderkey"), F.lit(">"), ident("P", "l_partkey")).alias("edge_id"), ident("O", "l_orderkey").alias("component"), ident("P", "l_partkey").alias("standard"), "confidence", "l_orderkey", "l_partkey")


def _pairs(pairs: DataFrame, label: str, letter: str) -> DataFrame:
    s, t = ident("P", "s"), ident("P", "t")
    return pairs.select(F.concat(F.lit(f"{letter}:"), s, F.lit(">"), t).alias("edge_id"), F.lit(label).alias("label"), s.alias("source"), t.alias("target"), "s", "t")


def _part_pairs(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    """s, t, next: pairs of parts of one order with s < t, once each, and whether lines n and n + 1 of an order hold them.

    One self-join of narrow rows and one aggregate give both labels: nothing is joined or read again for the other one.
    by: s or t, by which the pairs are dealt to tasks of bounded size, as lines are by order then.
    """
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"))
    if by:
        count = lines.count()
        lines = dealt(lines, "o", count=count)
    a, b = lines.select("o", F.col("p").alias("s"), "n"), lines.select("o", F.col("p").alias("t"), F.col("n").alias("m"))
    pairs = a.join(b, "o").where("s < t").select("s", "t", F.coalesce(F.col("m") == F.col("n") + 1, F.lit(False)).alias("next"))  # an order has a handful of lines
    if by:
        pairs = dealt(pairs, by, count=2 * count)  # of four lines come six pairs
    return pairs.groupBy("s", "t").agg(F.max("next").alias("next"))


def builds_towards(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("s"), (F.col("l_linenumber") + 1).alias("n"))
    b = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("t"), F.col("l_linenumber").alias("n"))
    return _pairs(a.join(b, ["o", "n"]).where("s < t").select("s", "t").distinct(), "buildsTowards", "b")


def relates_to(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(_part_pairs(spark, sf).where("NOT next"), "relatesTo", "r")


def progressions(spark: SparkSession, sf: str) -> DataFrame:
    return _progressions(_part_pairs(spark, sf))


def _progressions(pairs: DataFrame, *more: str) -> DataFrame:
    s, t = ident("P", "s"), ident("P", "t")
    letter, label = F.when(F.col("next"), "b:").otherwise("r:"), F.when(F.col("next"), "buildsTowards").otherwise("relatesTo")
    return pairs.select(F.concat(letter, s, F.lit(">"), t).alias("edge_id"), label.alias("label"), s.alias("source"), t.alias("target"), "s", "t", *more)


def placed_progressions(spark: SparkSession, sf: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Progressions with what sources (s, ...; others go) and targets (t, ...) tell of their ends, met while a pair is two numbers.

    Pairs are dealt by t, written, dealt by s and written again: no shuffle moves texts or waits for the next one to end, and
    texts are made of the written numbers whenever they are read.
    """
    folder = loop_dir(spark)
    pairs = cut(_part_pairs(spark, sf, by="t").join(targets, "t", "left"), folder, "pairs")
    placed = cut(dealt(pairs, "s").join(sources, "s").sortWithinPartitions("s", "t"), folder, "placed")
    forget(spark, folder, "pairs")
    return _progressions(placed, *[c for c in (*targets.columns, *sources.columns) if c not in ("s", "t")])


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, code (brand.size), brand, p_* columns."""
    brand = F.replace("p_brand", F.lit("#"), F.lit("."))
    return table(spark, sf, "part").select(ident("P", "p_partkey").alias("node_id"), brand.alias("brand"), F.concat(brand, F.lit("."), F.col("p_size").cast("string")).alias("code"), "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")


UPPER = """
upper_ AS (SELECT 'h:root>R:' || r_regionkey AS edge_id, 'root' AS source, 'R:' || r_regionkey AS target, r_regionkey::BIGINT AS seo FROM region
  UNION ALL SELECT 'h:R:' || n_regionkey || '>N:' || n_nationkey, 'R:' || n_regionkey, 'N:' || n_nationkey, n_nationkey::BIGINT FROM nation)"""
SUPPLIERS = UPPER + """,
sup AS (SELECT * FROM upper_ UNION ALL SELECT 'h:N:' || s_nationkey || '>S:' || s_suppkey, 'N:' || s_nationkey, 'S:' || s_suppkey, s_suppkey FROM supplier)"""
DAG = SUPPLIERS + """,
dag AS (SELECT * FROM sup UNION ALL SELECT 'h:S:' || l_suppkey || '>P:' || l_partkey, 'S:' || l_suppkey, 'P:' || l_partkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))"""
TREE = UPPER + """,
tree AS (SELECT * FROM upper_ UNION ALL SELECT 'h:N:' || c_nationkey || '>C:' || c_custkey, 'N:' || c_nationkey, 'C:' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'h:C:' || o_custkey || '>O:' || o_orderkey, 'C:' || o_custkey, 'O:' || o_orderkey, o_orderkey FROM orders)"""
SUPPORTS = """
supports AS (SELECT 's:O:' || l_orderkey || '>P:' || l_partkey AS edge_id, 'O:' || l_orderkey AS component, 'P:' || l_partkey AS standard, 1 - min(l_discount) AS confidence, l_orderkey, l_partkey FROM lineitem GROUP BY l_orderkey, l_partkey)"""
BUILDS = """
bt AS (SELECT 'b:P:' || s || '>P:' || t AS edge_id, 'buildsTowards' AS label, 'P:' || s AS source, 'P:' || t AS target, s, t FROM (
  SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey < b.l_partkey))"""
PROGRESSIONS = BUILDS + """,
rel AS (SELECT 'r:P:' || s || '>P:' || t AS edge_id, 'relatesTo' AS label, 'P:' || s AS source, 'P:' || t AS target, s, t FROM (
  SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey < b.l_partkey EXCEPT SELECT s, t FROM bt)),
lp AS (SELECT * FROM bt UNION ALL SELECT * FROM rel)"""
PARTS = """
parts AS (SELECT 'P:' || p_partkey AS node_id, replace(p_brand, '#', '.') AS brand, replace(p_brand, '#', '.') || '.' || p_size AS code, p_partkey, p_name, p_type, p_size, p_retailprice FROM part)"""
