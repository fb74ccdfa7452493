"""Delivery files: JSON lines of nodes and relationships, decoded into typed tables with findings for what is wrong.

A delivery file is read as one row (files are some tens of megabytes at most) and split into lines, so that the line
number, which orders everything later, is exact; a corpus of packages is read in parallel by files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the wire format.
KINDS = {"StandardsFramework": "framework", "StandardsFrameworkItem": "standard", "LearningComponent": "component"}
HIERARCHY, SUPPORTS, PROGRESSIONS = "hasChild", "supports", ("buildsTowards", "relatesTo")
NODE_PROPERTIES = ("academicSubject", "adoptionStatus", "attributionStatement", "author", "caseIdentifierURI", "caseIdentifierUUID", "description", "gradeLevel", "identifier", "identityKey", "inLanguage", "isCurrent", "jurisdiction", "license", "name", "normalizedStatementType", "provider", "statementCode", "statementType", "tags")
EDGE_PROPERTIES = ("attributionStatement", "author", "description", "identifier", "license", "provider", "relationshipType", "resolutionStatus", "sourceEntity", "sourceEntityKey", "sourceEntityValue", "supportConfidence", "targetEntity", "targetEntityKey", "targetEntityValue")


def _schema(properties: tuple[str, ...], outer: str) -> str:
    return f"{outer}, type string, properties struct<{', '.join(f'{p}: string' for p in properties)}>"


NODE_SCHEMA = _schema(NODE_PROPERTIES, "identifier string, labels array<string>")
EDGE_SCHEMA = _schema(EDGE_PROPERTIES, "identifier string, label string, source_identifier string, source_labels array<string>, target_identifier string, target_labels array<string>")


def strict_object(text: str) -> dict:
    """A JSON object without repeated keys, NaN, infinities or numbers that overflow."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key twice")
        return out

    def number(value):
        x = float(value)
        if x in (float("inf"), float("-inf")):
            raise ValueError("a number too large")
        return x

    def constant(value):
        raise ValueError(f"{value} is no JSON")

    found = json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


@F.pandas_udf(T.StringType())
def envelope_error(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Why a line is no strict envelope with string properties, or null."""

    def why(line: str) -> str | None:
        if line is None:
            return None
        try:
            row = strict_object(line)
        except (ValueError, RecursionError) as error:
            return str(error)[:200]
        bag = row.get("properties")
        if not isinstance(bag, dict) or not all(isinstance(v, str) for v in bag.values()):
            return "properties aren't an object of strings"
        lists = [row[k] for k in ("labels", "source_labels", "target_labels") if k in row]
        if not all(isinstance(x, list) and all(isinstance(v, str) for v in x) for x in lists):
            return "labels aren't lists of strings"
        return None

    for part in lines:
        yield part.map(why)


def located_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line (from 1), value of every line; one empty rest after the last line end isn't a line.

    Large files are read in splits. Rows of a split stand one after another in its task, so a line's number is that of the
    lines of all earlier splits of the file, which a first pass counts, and its place within its own.
    """
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    placed = splits.select("path", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    # a row for each split of a file, a millionth of the file at most
    return rows.join(F.broadcast(placed), ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def plain_envelope(line: Column) -> Column:
    """Is a line a strict envelope, as far as Spark's own reader can tell? Others are looked at once more (`envelope_error`).

    The variant reader takes no repeated keys, NaN or infinities; a number with a large exponent could overflow.
    """
    v = F.try_parse_json(line)
    strings = lambda values: F.forall(values, lambda x: F.schema_of_variant(x) == "STRING")
    bag = F.map_values(F.try_variant_get(v, "$.properties", "map<string,variant>"))
    lists = [F.coalesce(strings(F.try_variant_get(v, f"$.{k}", "array<variant>")), F.try_variant_get(v, f"$.{k}", "variant").isNull()) for k in ("labels", "source_labels", "target_labels")]
    test = v.isNotNull() & ~line.rlike(r"[0-9][eE][+-]?[0-9]{3}") & ~line.rlike(r"[0-9]{300}") & F.coalesce(strings(bag), F.lit(False))
    for own in lists:
        test = test & own
    return F.coalesce(test, F.lit(False))


def _flag(value: Column) -> Column:
    return F.when(value == "true", True).when(value == "false", False)


def _strings(value: Column) -> Column:
    """The list in a string; null if it is none or holds anything but strings."""
    parsed = F.from_json(value, "array<variant>")
    return F.when(F.forall(parsed, lambda v: F.schema_of_variant(v) == "STRING"), F.from_json(value, "array<string>"))


def _share(value: Column) -> Column:
    number = F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    return F.when((number >= 0) & (number <= 1), number)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    suspect = lines.withColumn("suspect", ~plain_envelope(F.col("value")))
    told = F.when(F.col("suspect"), envelope_error(F.when(F.col("suspect"), F.col("value"))))
    return suspect.withColumn("envelope", told).withColumn("r", F.from_json("value", schema)).drop("suspect")


def read_nodes(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, findings). Nodes: path, seo, node_id, kind, labels and the properties with their types."""
    rows = _parsed(located_lines(spark, paths), NODE_SCHEMA)
    p = lambda name: F.col(f"r.properties.{name}")
    kinds = [F.when(F.array_contains("r.labels", label), kind) for label, kind in KINDS.items()]
    kind = F.array_compact(F.array(*kinds))
    rows = rows.withColumn("kinds", kind).withColumn("grade_level", _strings(p("gradeLevel"))).withColumn("tags", _strings(p("tags"))).withColumn("is_current", _flag(p("isCurrent")))
    error = (
        F.when(F.col("envelope").isNotNull(), F.col("envelope")).when(F.coalesce(F.col("r.type") != "node", F.lit(True)), "type isn't node").when(F.col("r.identifier").isNull() | (F.col("r.identifier") == ""), "no identifier")
        .when(F.size("kinds") != 1, "labels name no single kind").when(p("isCurrent").isNotNull() & F.col("is_current").isNull(), "isCurrent is neither true nor false")
        .when(p("gradeLevel").isNotNull() & F.col("grade_level").isNull(), "gradeLevel is no list of strings").when(p("tags").isNotNull() & F.col("tags").isNull(), "tags is no list of strings")
        .when((F.get("kinds", 0) == "component") & p("description").isNull(), "a component needs a description")
    )
    rows = rows.withColumn("error", error)
    plain = {"academic_subject": "academicSubject", "adoption_status": "adoptionStatus", "attribution_statement": "attributionStatement", "author": "author", "case_identifier_uri": "caseIdentifierURI", "case_identifier_uuid": "caseIdentifierUUID", "description": "description", "property_identifier": "identifier", "identity_key": "identityKey", "in_language": "inLanguage", "jurisdiction": "jurisdiction", "license": "license", "name": "name", "normalized_statement_type": "normalizedStatementType", "provider": "provider", "statement_code": "statementCode", "statement_type": "statementType"}
    nodes = rows.where("error IS NULL").select("path", F.col("line").alias("seo"), F.col("r.identifier").alias("node_id"), F.get("kinds", 0).alias("kind"), F.col("r.labels").alias("labels"), "grade_level", "tags", "is_current", *[p(v).alias(k) for k, v in plain.items()])
    return nodes, _findings(rows)


def read_relationships(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, findings). Edges: path, seo, edge_id, label, source, target, status, confidence and the other properties."""
    rows = _parsed(located_lines(spark, paths), EDGE_SCHEMA)
    p = lambda name: F.col(f"r.properties.{name}")
    rows = rows.withColumn("confidence", _share(p("supportConfidence")))
    progression = F.col("r.label").isin(*PROGRESSIONS)
    ends = F.lit(True)
    for side in ("source", "target"):
        ends = ends & (F.col(f"r.{side}_labels") == F.array(F.lit("StandardsFrameworkItem"))) & (p(f"{side}Entity") == "StandardsFrameworkItem") & (p(f"{side}EntityKey") == "caseIdentifierUUID")
    error = (
        F.when(F.col("envelope").isNotNull(), F.col("envelope")).when(F.coalesce(F.col("r.type") != "relationship", F.lit(True)), "type isn't relationship").when(F.col("r.identifier").isNull() | (F.col("r.identifier") == ""), "no identifier")
        .when(F.col("r.source_identifier").isNull() | F.col("r.target_identifier").isNull(), "no endpoint").when(p("supportConfidence").isNotNull() & F.col("confidence").isNull(), "supportConfidence isn't between 0 and 1")
        .when(progression & ~F.coalesce(F.col("r.label") == p("relationshipType"), F.lit(False)), "label and relationshipType differ").when(progression & ~F.coalesce(F.col("r.identifier") == p("identifier"), F.lit(False)), "identifiers differ")
        .when(progression & ~F.coalesce(ends, F.lit(False)), "endpoints aren't standards by CASE identifier")
    )
    rows = rows.withColumn("error", error)
    plain = {"relationship_type": "relationshipType", "status": "resolutionStatus", "source_entity": "sourceEntity", "source_entity_key": "sourceEntityKey", "source_entity_value": "sourceEntityValue", "target_entity": "targetEntity", "target_entity_key": "targetEntityKey", "target_entity_value": "targetEntityValue", "attribution_statement": "attributionStatement", "author": "author", "description": "description", "license": "license", "provider": "provider"}
    edges = rows.where("error IS NULL").select("path", F.col("line").alias("seo"), F.col("r.identifier").alias("edge_id"), F.col("r.label").alias("label"), F.col("r.source_identifier").alias("source"), F.col("r.target_identifier").alias("target"), F.col("r.source_labels").alias("source_labels"), F.col("r.target_labels").alias("target_labels"), "confidence", *[p(v).alias(k) for k, v in plain.items()])
    return edges, _findings(rows)


def _findings(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select(F.lit("wire-record").alias("code"), F.concat_ws(":", "path", "line").alias("record_id"), F.col("line").cast("long").alias("seo"), F.lit("error").alias("severity"), F.col("error").alias("message"))


def split_delivery(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(root, items, components) of one package; an error unless it has one root."""
    root = nodes.where("kind = 'framework'")
    if root.limit(2).count() != 1:
        raise ValueError("a delivery has one framework root")
    return root, nodes.where("kind = 'standard'"), nodes.where("kind = 'component'")


def resolve_by_case(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Progression edges with source and target replaced by the ids of the standards whose CASE UUIDs they name; edges whose
    UUID no standard has are kept with a null end, for validation to find."""
    for side in ("source", "target"):
        known = nodes.where("kind = 'standard' AND case_identifier_uuid IS NOT NULL").select(F.col("case_identifier_uuid").alias(f"{side}_entity_value"), F.col("node_id").alias(f"{side}_node"))
        edges = edges.join(known, f"{side}_entity_value", "left").withColumn(side, F.col(f"{side}_node")).drop(f"{side}_node")
    return edges
