"""Exact counts of a framework: value counts with a null bucket, exploded arrays, parents, depths and supports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): null is a value of its own, sorted last."""
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("value").asc_nulls_last())


def element_counts(rows: DataFrame, column: str) -> DataFrame:
    """value_counts over an array's elements; a null or empty array counts once as null."""
    filled = F.when(F.size(column) > 0, F.col(column))
    return value_counts(rows.select(F.explode_outer(filled).alias("value")), "value")


def parent_distribution(edges: DataFrame, items: DataFrame, distinct_sources: bool = False) -> DataFrame:
    """(parents, items): how many items (node_id) have so many incoming edges, or different sources; none included."""
    n = F.count_distinct("source") if distinct_sources else F.count("*")
    counted = edges.groupBy(F.col("target").alias("node_id")).agg(n.alias("n"))
    return items.select("node_id").join(counted, "node_id", "left").groupBy(F.coalesce("n", F.lit(0)).cast("long").alias("parents")).agg(F.count("*").alias("items")).orderBy("parents")


def support_statistics(supports: DataFrame, component: str = "component", standard: str = "standard", standards: DataFrame | None = None) -> DataFrame:
    """One row: standards and components with support, components on several standards, confidences.

    A component's standards are numbered in their order, and only the numbers are summed up, so a task sorts its rows and
    holds no map of components. standards: a table that has the same standards, to count them without the view behind supports.
    """
    by = Window.partitionBy(component).orderBy(standard)  # null comes first, and is no standard
    line, unknown = F.row_number().over(by), F.first(standard).over(by.rowsBetween(Window.unboundedPreceding, 0)).isNull()
    span = F.dense_rank().over(by).cast("long") - unknown.cast("long")
    numbered = supports.select((line == 1).alias("first"), (line == F.rank().over(by)).alias("new"), span.alias("span"), "confidence")
    by_component = numbered.agg(F.count_if("first").alias("components"), F.count_if(F.col("new") & (F.col("span") == 2)).alias("bridges"), F.max("span").alias("largest_span"), F.min("confidence").alias("least_confidence"), F.max("confidence").alias("most_confidence"))
    counted = (supports if standards is None else standards).agg(F.count_distinct(standard).alias("standards"))
    return counted.join(by_component, F.lit(True))  # one row each


def node_facts(items: DataFrame, code: str, text: str) -> DataFrame:
    """items, coded, with_text and the code availability none, partial or complete, in one pass."""
    facts = items.agg(F.count("*").alias("items"), F.count(code).alias("coded"), F.count_if(F.trim(F.col(text)) != "").alias("with_text"))
    return facts.withColumn("availability", F.when(F.col("coded") == 0, "none").when(F.col("coded") == F.col("items"), "complete").otherwise("partial"))


def digest(rows: DataFrame, value: str) -> DataFrame:
    """(n, sha256) of a set of strings: the hash of the values, sorted, a line each.

    Hashing needs the values in one order, so they meet in one task; for sets of checksums of files or buckets. Large tables are
    digested by bucket first (`bucketed_digest`).
    """
    joined = F.array_join(F.sort_array(F.collect_list(value)), "\n")
    return rows.agg(F.count(value).alias("n"), F.sha2(F.concat(joined, F.lit("\n")), 256).alias("sha256"))


def shard_of(key: str, shards: int = 64):
    """The first byte of the key's SHA-256, modulo shards."""
    return (F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("long") % shards).alias("bucket")


def bucketed_digest(rows: DataFrame, key: str, value: str, shards: int = 64) -> DataFrame:
    """(bucket, n, sha256) for each shard of keys, in three levels: equal values are counted, those with the same first three
    hex digits of their hash are hashed together in order, each with its count, and a shard's at most 4,096 such hashes once
    more. So no task gathers a shard, and a value that very many rows have is one line."""
    marked = rows.select(shard_of(key, shards), F.sha2(F.col(value), 256).alias("h")).groupBy("bucket", "h").agg(F.count("*").alias("n"))
    line = lambda c: F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list(c)), "\n"), F.lit("\n")), 256)
    counted = F.concat_ws(" ", F.coalesce("h", F.lit("null")), F.col("n").cast("string"))
    parts = marked.groupBy("bucket", F.substring("h", 1, 3).alias("head")).agg(F.sum("n").alias("n"), line(counted).alias("part"))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), line(F.concat(F.coalesce("head", F.lit("null")), "part")).alias("sha256"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one multiset that the other lacks, with side; empty if they are equal."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def flattened(report: DataFrame, column: str) -> DataFrame:
    """(section, key, n) of a map of maps of counts."""
    sections = report.select(F.explode(column).alias("section", "counts"))
    return sections.select("section", F.explode("counts").alias("key", "n"))


def warning_totals(rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, total, affected): sums of warnings, and rows that have any."""
    return rows.groupBy(key).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total"), F.count_if(F.col(n) > 0).alias("affected"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """One row: a digest of whole rows, whatever their order: rows are digested in 64 buckets, and the buckets' digests once more."""
    parts = bucketed_digest(rows.select(F.col(key), F.to_json(F.struct("*")).alias("__json")), key, "__json")
    line = F.concat_ws(" ", F.lpad(F.col("bucket").cast("string"), 2, "0"), "sha256")
    return parts.agg(F.sum("n").cast("long").alias("entries"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))
