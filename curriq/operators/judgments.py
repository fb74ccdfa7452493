"""Judgments on progression edges: bounded excerpts of what was judged, met with their edges and the ends of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENT_CHARS, RATIONALE_CHARS, WARNING_CHARS, WARNINGS = 2048, 512, 512, 5


def projections(judgments: DataFrame) -> DataFrame:
    """edge_id, confidence, and of a judgment's texts (rationale, warnings) excerpts with flags that tell what they lack.

    Lengths are code points. A null rationale is empty, null warnings are none; a null warning in a list is an empty one.
    """
    rationale = F.coalesce("rationale", F.lit(""))
    warnings = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit("")))
    first = F.slice(warnings, 1, WARNINGS)
    return judgments.select(
        "edge_id", "confidence", F.substring(rationale, 1, RATIONALE_CHARS).alias("rationale_excerpt"), (F.length(rationale) > RATIONALE_CHARS).alias("rationale_excerpted"), F.size(warnings).cast("long").alias("warning_count"),
        F.transform(first, lambda w: F.substring(w, 1, WARNING_CHARS)).alias("warning_excerpts"), F.exists(first, lambda w: F.length(w) > WARNING_CHARS).alias("warnings_excerpted"), (F.size(warnings) > WARNINGS).alias("warnings_omitted"),
    )


def edge_evidence(edges: DataFrame, nodes: DataFrame, judgments: DataFrame) -> DataFrame:
    """edges with their ends' statements (excerpts, and whether they are shortened) and the projection of their judgment;
    `judged` is false where an edge has none. nodes: node_id, description. Several judgments of an edge are an error."""
    shown = projections(judgments)
    twice = judgments.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"edge {twice.first()['edge_id']} is judged twice")
    out = edges
    for end in ("source", "target"):
        own = nodes.select(F.col("node_id").alias(end), F.substring("description", 1, STATEMENT_CHARS).alias(f"{end}_statement"), (F.length("description") > STATEMENT_CHARS).alias(f"{end}_shortened"))
        out = out.join(own, end, "left")
    return out.join(shown, "edge_id", "left").withColumn("judged", F.col("warning_count").isNotNull())
