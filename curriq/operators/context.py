"""A standard's whole context in one answer: parents, children, ancestors, descendants, root paths and statuses.

The answer is a list of entries in order; nodes and edges that entries mention are listed once beside it. A byte budget
admits entries from the first on: an entry needs the bytes of its own record and of those nodes and edges that no earlier one
has mentioned. The first that doesn't fit, less the reserve for what closes the answer, ends it. Each entry takes LEAST_BYTES
at least, so of a longer section only the first entries that the budget could hold are placed, and the running sum over one
partition is bounded by the budget, whatever the length of the sections.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curriq.operators.traversal import induced_edges, neighbours, ranked_root_paths, traverse
from curriq.session import cut, loop_dir

SECTIONS = ("standard", "direct_parents", "direct_children", "ancestors", "ancestor_edges", "descendants", "descendant_edges", "root_paths", "statuses")
MAX_BYTES, RESERVE = 1 << 20, 4096
#: The shortest record, {"section":"statuses","place":1}, is longer.
LEAST_BYTES = 24


@dataclass
class Bounds:
    ancestor_depth: int = 64
    child_depth: int = 64
    max_nodes: int | None = 2000  # None: every node within the depth
    max_paths: int = 1000
    max_occurrences: int = 100_000
    max_bytes: int = MAX_BYTES
    reserve: int = RESERVE


@dataclass
class Context:
    """entries (ord, section, place, node_id, edge_id, depth, path, status, bytes, running), nodes, edges, and what ended each
    part: truncation by section, and `byte_limit` for the whole. told: the entries before the budget, of each
    section one more than the budget could hold."""

    told: DataFrame
    entries: DataFrame
    nodes: DataFrame
    edges: DataFrame
    truncation: dict[str, str] = field(default_factory=dict)


def _entries(rows: DataFrame, section: str, order: list, most: int, **columns) -> DataFrame:
    """A section's first entries, `most` of them, with their place in it."""
    rows = rows.orderBy(*order).limit(most)
    empty = {"node_id": "string", "edge_id": "string", "depth": "int", "path": "array<string>", "path_edges": "array<string>", "status": "string"}
    place = F.row_number().over(Window.orderBy(*order)).cast("long")  # a list that the byte budget bounds
    return rows.select(F.lit(SECTIONS.index(section)).alias("s"), F.lit(section).alias("section"), place.alias("place"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()])


def standard_context(edges: DataFrame, nodes: DataFrame, root: str, node_id: str, bounds: Bounds | None = None) -> Context:
    """The context of a node. edges: edge_id, source, target, seo, status; nodes: node_id and what its record shows.

    Statuses are those of all edges of the other sections, once each, that have one, in order of (seo, edge_id). Parents
    and children are in that order too, nodes of a walk by (depth, node_id), paths by their edges from the node up.
    """
    b = bounds or Bounds()
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    edges = cut(edges.select("edge_id", "source", "target", "seo", "status"), folder, "edges")
    own = nodes.where(F.col("node_id") == node_id)
    if own.isEmpty():
        raise LookupError(f"no standard {node_id}")
    seo = ["seo", "edge_id"]
    up, up_cut = traverse(edges, node_id, down=False, max_depth=b.ancestor_depth, max_nodes=b.max_nodes, ready=True)
    down, down_cut = traverse(edges, node_id, max_depth=b.child_depth, max_nodes=b.max_nodes, ready=True)
    paths, paths_cut = ranked_root_paths(edges, root, node_id, b.ancestor_depth, b.max_paths, b.max_occurrences)
    up, down = cut(up, folder, "up"), cut(down, folder, "down")
    near = {d: neighbours(edges, nodes.select("node_id"), node_id, d) for d in ("parents", "children")}
    inner = {s: cut(induced_edges(edges, walk), folder, s) for s, walk in (("ancestor_edges", up), ("descendant_edges", down))}
    most = max(0, b.max_bytes - b.reserve) // LEAST_BYTES + 1  # the last of so many is over the budget, and so is what follows
    parts = [_entries(own, "standard", ["node_id"], most, node_id=F.col("node_id"))]
    parts += [_entries(near[d], f"direct_{d}", seo, most, node_id=F.col("node_id"), edge_id=F.col("edge_id")) for d in ("parents", "children")]
    for section, walk, held in (("ancestors", up, "ancestor_edges"), ("descendants", down, "descendant_edges")):
        parts.append(_entries(walk, section, ["depth", "node_id"], most, node_id=F.col("node_id"), depth=F.col("depth")))
        parts.append(_entries(inner[held], held, seo, most, edge_id=F.col("edge_id")))
    parts.append(_entries(paths, "root_paths", ["rank"], most, path=F.col("nodes"), path_edges=F.col("edge_ids")))
    told = parts[0]
    for more in parts[1:]:
        told = told.unionByName(more)
    told = cut(told, folder, "told")
    mentioned = told.select(F.explode(F.concat(F.array("edge_id"), F.coalesce("path_edges", F.array().cast("array<string>")))).alias("edge_id")).where("edge_id IS NOT NULL").distinct()
    statuses = edges.join(mentioned, "edge_id", "left_semi").where("status IS NOT NULL")
    told = told.unionByName(_entries(statuses, "statuses", seo, most, edge_id=F.col("edge_id"), status=F.col("status")))
    return admitted(cut(told, folder, "entries"), nodes, edges, b, {s: r for s, r in (("ancestors", up_cut), ("descendants", down_cut), ("root_paths", paths_cut)) if r})


def admitted(told: DataFrame, nodes: DataFrame, edges: DataFrame, b: Bounds, truncation: dict[str, str]) -> Context:
    """Entries that the byte budget admits, and the nodes and edges that they mention."""
    folder = loop_dir(told.sparkSession)
    size = lambda rows, key: rows.select(key, F.octet_length(F.to_json(F.struct(*rows.columns))).cast("long").alias("bytes"))
    placed = told.withColumn("ord", F.row_number().over(Window.orderBy("s", "place")).cast("long"))
    placed = placed.withColumn("own", F.octet_length(F.to_json(F.struct("section", "place", "node_id", "edge_id", "depth", "path", "path_edges", "status"))).cast("long"))
    none = F.array().cast("array<string>")
    ids = lambda one, many: F.explode(F.array_distinct(F.array_compact(F.concat(F.array(one), F.coalesce(many, none)))))
    first_nodes = placed.select("ord", ids("node_id", "path").alias("node_id")).groupBy("node_id").agg(F.min("ord").alias("ord"))
    first_edges = placed.select("ord", ids("edge_id", "path_edges").alias("edge_id")).groupBy("edge_id").agg(F.min("ord").alias("ord"))
    new = first_nodes.join(size(nodes, "node_id"), "node_id").select("ord", "bytes").unionByName(first_edges.join(size(edges, "edge_id"), "edge_id").select("ord", "bytes")).groupBy("ord").agg(F.sum("bytes").alias("new"))
    summed = placed.join(new, "ord", "left").withColumn("bytes", F.col("own") + F.coalesce("new", F.lit(0)))
    summed = cut(summed.withColumn("running", F.sum("bytes").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))), folder, "summed")
    kept = summed.where(F.col("running") <= b.max_bytes - b.reserve)
    ended = {} if summed.where(F.col("running") > b.max_bytes - b.reserve).isEmpty() else {"byte_limit": "byte_limit"}
    within = lambda first, key: first.join(kept.select("ord"), "ord", "left_semi").select(key)
    shown = kept.select("ord", "section", "place", "node_id", "edge_id", "depth", "path", "status", "bytes", "running")
    return Context(told, shown, nodes.join(within(first_nodes, "node_id"), "node_id", "left_semi"), edges.join(within(first_edges, "edge_id"), "edge_id", "left_semi"), truncation | ended)
