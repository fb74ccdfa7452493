"""Statistics of whole frameworks: every count from one pass over nodes and one over edges, for any number of packages.

A row of nodes or edges becomes its contributions to all counts, as (section, value) or as facts of a node (its parents,
components, standards). One aggregate adds up both, so partial sums leave the tasks that read; a second one counts
nodes by their facts. What is left has a row for each different value. Null is a value of its own, listed last.

nodes: package_id, node_id, kind (framework, standard, component), statement_type, normalized_statement_type, statement_code,
grade_level, tags, and the facets normalized_grades and resolved_local_grade_labels. edges: package_id, edge_id, label,
relationship_type, status, source, target, confidence.

Sections: nodes (by kind), statement_type, normalized_statement_type, node_grade_level, local_grade_label, normalized_grade
(items; none: null), code_presence, relationships (by label), canonical_label, relationship_type, resolution_status and
relationship_resolution (of the hierarchy), parent_count (items by incoming edges), multi_parent_targets, multi_parent_maximum,
supported_statement_type (items of types that have support; null as empty), components_per_standard (items of those types),
bridge_span, multi_standard_components, support_confidence (minimum, maximum, in amount), tag_vocabulary; and of one
framework also depth (nodes by smallest depth below the root) and unreachable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curriq.functions.text import facet_keys
from curriq.operators.traversal import reachable, traverse
from curriq.session import cut, loop_dir

HIERARCHY, SUPPORTS = "hasChild", "supports"
FACT = "#"
PART = "struct<section:string,value:string,key:string,item:int,type:string,parents:bigint,components:bigint,standards:bigint,amount:double>"
COUNT = "struct<section:string,value:string,type:string,n:bigint,most:bigint,amount:double>"


def _struct(kind: str, own: dict[str, Column | None]) -> Column:
    """A struct of this type; fields that own hasn't are null."""
    fields = [f.split(":") for f in kind[len("struct<") : -1].split(",")]
    return F.struct(*[(F.lit(None) if own.get(name) is None else own[name]).cast(t).alias(name) for name, t in fields])


def _part(section: str, value: Column | None = None, **more: Column) -> Column:
    """A contribution: one more row of (section, value), or facts of a node (key)."""
    return _struct(PART, {"section": F.lit(section), "value": value, **more})


def _count(section: str | Column, value: Column | None = None, **more: Column) -> Column:
    """A contribution to the second sums: n rows (one, unless told) of (section, value), or a number of which the most counts."""
    return _struct(COUNT, {"section": F.lit(section) if isinstance(section, str) else section, "value": value, "n": F.lit(1), **more})


def _each(section: str, values: Column | str) -> Column:
    """A contribution of each element; a null or empty array is one null."""
    column = F.col(values) if isinstance(values, str) else values
    filled = F.when(F.size(column) > 0, column).otherwise(F.array(F.lit(None).cast("string")))
    return F.transform(filled, lambda v: _part(section, v))


def _of_nodes(nodes: DataFrame) -> DataFrame:
    nothing = F.array().cast(f"array<{PART}>")
    coded = F.when(F.col("statement_code").isNotNull(), "coded").otherwise("uncoded")
    item = F.concat(
        F.array(_part("statement_type", F.col("statement_type")), _part("normalized_statement_type", F.col("normalized_statement_type")), _part("code_presence", coded)),
        _each("node_grade_level", "grade_level"), _each("local_grade_label", "resolved_local_grade_labels"), _each("normalized_grade", "normalized_grades"),
    )
    is_item, is_component = F.col("kind") == "standard", F.col("kind") == "component"
    tags = F.transform(F.filter(F.array_distinct(F.coalesce(facet_keys("tags"), F.array().cast("array<string>"))), lambda t: t != ""), lambda t: _part("tag", t))
    fact = F.array(_part("nodes", F.col("kind")), _part(FACT, key=F.col("node_id"), item=is_item.cast("int"), type=F.coalesce("statement_type", F.lit(""))))
    return nodes.select("package_id", F.explode(F.concat(fact, F.when(is_item, item).otherwise(nothing), F.when(is_component, tags).otherwise(nothing))).alias("p")).select("package_id", "p.*")


def _of_edges(edges: DataFrame) -> DataFrame:
    nothing = F.array().cast(f"array<{PART}>")
    one = F.lit(1)
    hierarchy = F.array(
        _part("canonical_label", F.col("label")), _part("relationship_type", F.col("relationship_type")), _part("resolution_status", F.col("status")),
        _part("relationship_resolution", F.when(F.col("status").isNull(), "resolved").otherwise("unresolved")), _part(FACT, key=F.col("target"), parents=one),
    )
    supports = F.array(_part(FACT, key=F.col("target"), components=one), _part(FACT, key=F.col("source"), standards=one))
    every = F.array(_part("relationships", F.col("label"), amount=F.when(F.col("label") == SUPPORTS, F.col("confidence"))))
    return edges.select("package_id", F.explode(F.concat(every, F.when(F.col("label") == HIERARCHY, hierarchy).otherwise(nothing), F.when(F.col("label") == SUPPORTS, supports).otherwise(nothing))).alias("p")).select("package_id", "p.*")


def flat_statistics(nodes: DataFrame, edges: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(package_id, section, value, n, amount) of all sections that need no walk; others: (package_id, label) of edges that are only counted."""
    text = lambda c: F.col(c).cast("string")
    first = _of_nodes(nodes).unionByName(_of_edges(edges)).groupBy("package_id", "section", "value", "key").agg(
        F.count("*").alias("n"), F.max("item").alias("item"), F.max("type").alias("type"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("parents", "components", "standards")], F.min("amount").alias("low"), F.max("amount").alias("high"),
    )
    row = _count
    nothing = F.array().cast(f"array<{COUNT}>")
    # a node's facts
    counted = F.when(F.col("item") == 1, F.concat(F.array(row("parent_count", text("parents")), row("multi_parent_maximum", most=F.col("parents")), row("components_per_standard", text("components"), type=F.col("type"))), F.when(F.col("parents") > 1, F.array(row("multi_parent_targets"))).otherwise(nothing))).otherwise(nothing)
    spans = F.when(F.col("standards") > 1, F.array(row("bridge_span", text("standards")), row("multi_standard_components"))).otherwise(nothing)
    plain = F.when(F.col("section") == "tag", F.array(row("tag_vocabulary"))).otherwise(F.array(row(F.col("section"), F.col("value"), n=F.col("n"))))
    bounds = F.when(F.col("low").isNotNull(), F.array(row("support_confidence", F.lit("minimum"), amount=F.col("low")), row("support_confidence", F.lit("maximum"), amount=F.col("high")))).otherwise(nothing)
    second = first.select("package_id", F.explode(F.when(F.col("section") == FACT, F.concat(counted, spans)).otherwise(F.concat(plain, bounds))).alias("r")).select("package_id", "r.*")
    if others is not None:
        second = second.unionByName(others.groupBy("package_id", "label").agg(F.count("*").alias("n")).select("package_id", row("relationships", F.col("label"), n=F.col("n")).alias("r")).select("package_id", "r.*"))
    second = second.groupBy("package_id", "section", "value", "type").agg(F.coalesce(F.max("most"), F.sum("n")).alias("n"), F.max("amount").alias("amount"))
    # a row for each statement type and number of components: types without any support are left out
    supported = F.max((F.col("section") == "components_per_standard") & (F.col("value") != "0")).over(Window.partitionBy("package_id", "section", "type"))
    kept = second.withColumn("supported", supported).where("section <> 'components_per_standard' OR supported")
    types = F.when(F.col("section") == "components_per_standard", F.array(F.struct("section", "value"), F.struct(F.lit("supported_statement_type").alias("section"), F.col("type").alias("value")))).otherwise(F.array(F.struct("section", "value")))
    last = kept.select("package_id", F.explode(types).alias("t"), "n", "amount")
    return last.groupBy("package_id", F.col("t.section").alias("section"), F.col("t.value").alias("value")).agg(F.sum("n").alias("n"), F.max("amount").alias("amount"))


def structure_statistics(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(section, value, n): depth of the hierarchy's nodes below root, and nodes that neither hierarchy nor supports join with it."""
    spark, folder = nodes.sparkSession, loop_dir(nodes.sparkSession)
    inner = cut(edges.where(F.col("label").isin(HIERARCHY, SUPPORTS)).select("label", "source", "target"), folder, "edges")
    depths = traverse(inner.where(F.col("label") == HIERARCHY), root, max_depth=1 << 30, ready=True)[0].groupBy(F.col("depth").cast("string").alias("value")).agg(F.count("*").alias("n"))
    joined = reachable(inner, spark.createDataFrame([(root,)], "node_id string"), symmetric=True)
    lost = nodes.select("node_id").distinct().join(joined, "node_id", "left_anti").agg(F.count("*").alias("n"))
    return depths.select(F.lit("depth").alias("section"), "value", "n").unionByName(lost.select(F.lit("unreachable").alias("section"), F.lit(None).cast("string").alias("value"), "n"))


def framework_statistics(nodes: DataFrame, edges: DataFrame, package_id: str, root: str, others: DataFrame | None = None) -> DataFrame:
    """(section, value, n, amount): all statistics of one package, in order of section and value, null last.

    others: edges of labels besides hasChild and supports (progressions), apart from edges. No walk takes them, so a view
    behind them is computed once, and only counted by label.
    """
    own = lambda rows: rows.where(F.col("package_id") == package_id)
    flat = flat_statistics(own(nodes), own(edges), None if others is None else own(others)).drop("package_id")
    both = flat.unionByName(structure_statistics(own(nodes), own(edges), root).withColumn("amount", F.lit(None).cast("double")))
    return both.orderBy("section", F.col("value").asc_nulls_last())
