"""Learning progressions: direct relations, discovery with endpoint scopes, bounded traversal, paths and reach.

Edges: edge_id, label (buildsTowards or relatesTo), source, target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curriq.session import cut, loop_dir

MAX_EXAMINED = 5000


def direct(edges: DataFrame, node_id: str) -> DataFrame:
    """The node's edges once each, with kind (incoming, outgoing, related), in order of (label, edge_id)."""
    own = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    kind = F.when(F.col("label") == "relatesTo", "related").when(F.col("source") == node_id, "outgoing").otherwise("incoming")
    return own.withColumn("kind", kind).dropDuplicates(["edge_id"]).orderBy("label", "edge_id")


def discover(edges: DataFrame, nodes: DataFrame, match: Column, scope: str = "either", position: int = 0, limit: int = 100, after: tuple[str, str] | None = None) -> DataFrame:
    """A page of edges whose endpoints match as scope says (either, both, source, target), from a position in the
    unfiltered order (label, edge_id) on; MAX_EXAMINED edges are looked at for one page.

    after: the (label, edge_id) of the edge at position - 1. Whoever has it from the page before saves the search for the
    position, which costs as many rows as it is deep.
    """
    if scope not in ("either", "both", "source", "target"):
        raise ValueError(f"unknown scope {scope}")
    order = ["label", "edge_id"]
    start = 0
    if after is not None:
        edges, start = edges.where(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)])), position
    first = edges.orderBy(*order).limit(position - start + MAX_EXAMINED)
    placed = first.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long")).where(F.col("position") >= position)
    flagged = nodes.select("node_id", match.alias("hit"))
    joined = placed.join(flagged.select(F.col("node_id").alias("source"), F.col("hit").alias("source_hit")), "source").join(flagged.select(F.col("node_id").alias("target"), F.col("hit").alias("target_hit")), "target")
    keep = {"either": F.col("source_hit") | F.col("target_hit"), "both": F.col("source_hit") & F.col("target_hit"), "source": F.col("source_hit"), "target": F.col("target_hit")}[scope]
    side = F.when(F.col("source_hit") & F.col("target_hit"), "both").when(F.col("source_hit"), "source").otherwise("target")
    return joined.where(keep).select("position", "label", "edge_id", "source", "target", side.alias("connection")).orderBy("position").limit(limit)


@dataclass
class Walk:
    """nodes (node_id, depth, arrival), edges (edge_id, source, target, depth), reasons that ended or cut the walk, edges
    looked at (all, and those at the depth bound), and limited (node_id, n): edges at the bound to nodes that it keeps out."""

    nodes: DataFrame
    edges: DataFrame
    reasons: list[str]
    examined: int
    examined_at_bound: int
    limited: DataFrame | None
    adjacency: DataFrame


def traverse(edges: DataFrame, start: str, max_depth: int, max_nodes: int = 250, max_edges: int = 100, down: bool = True) -> tuple[DataFrame, DataFrame, str | None]:
    """((node_id, depth), (edge_id, source, target, depth), reason) of `walk`; a bound that ended it goes before depth_limit."""
    found = walk(edges, start, max_depth, max_nodes, max_edges, down)
    return found.nodes.select("node_id", "depth"), found.edges, found.reasons[-1] if found.reasons else None


def walk(edges: DataFrame, start: str, max_depth: int, max_nodes: int = 250, max_edges: int = 100, down: bool = True, work: int | None = None) -> Walk:
    """A bounded breadth-first walk in order of arrival.

    A level's edges are looked at in order of (arrival of their node, edge_id). At the depth bound, edges to nodes already
    returned are kept, others counted as `depth_limit`. The edge that would break a bound ends the walk and isn't taken.
    A walk looks at `work` edges (MAX_EXAMINED, unless told) at most; where that ends it, the reason is `work_limit`.
    """
    near, far = ("source", "target") if down else ("target", "source")
    work = MAX_EXAMINED if work is None else work
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    edges = cut(edges.select("edge_id", "source", "target"), folder, "edges")
    seen = cut(spark.createDataFrame([(start, 0, 0)], "node_id string, depth int, arrival long"), folder, "nodes-0")
    taken, n_nodes, n_edges, depth, frontier, ended = None, 1, 0, 0, seen, None
    examined, at_bound, limited = 0, 0, None
    while ended is None and depth <= max_depth:
        step = frontier.select(F.col("node_id").alias(near), F.col("arrival").alias("from_arrival")).join(edges.select("edge_id", near, far), near)
        if taken is not None:
            step = step.join(taken.select("edge_id"), "edge_id", "left_anti")
        # one edge more than can be taken, or looked at, tells that a bound is broken
        room, last = work - examined, depth == max_depth
        step = cut(step.orderBy("from_arrival", "edge_id").limit(1 + (room if last else min(room, max_edges - n_edges))), folder, f"level-{depth}")
        known = seen.select(F.col("node_id").alias(far), F.lit(1).alias("known"))
        order = Window.orderBy("from_arrival", "edge_id")
        step = step.withColumn("place", F.row_number().over(order)).where(F.col("place") <= room).join(known, far, "left")
        first = F.row_number().over(Window.partitionBy(far).orderBy("place"))
        is_new = F.col("known").isNull() & (first == 1)
        # at the bound nodes are kept out, and edges to them aren't taken
        step = step.withColumn("taken", (F.col("known").isNotNull() if last else F.lit(True)).cast("int")).withColumn("is_new", (F.lit(False) if last else is_new).cast("int"))
        running = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        step = cut(step.withColumn("nodes", F.sum("is_new").over(running) + n_nodes).withColumn("edges", F.sum("taken").over(running) + n_edges), folder, f"edges-{depth}")
        spent = spark.read.parquet(f"{folder}/level-{depth}").count() > room
        over = step.where((F.col("taken") == 1) & ((F.col("nodes") > max_nodes) | (F.col("edges") > max_edges))).orderBy("place").limit(1).collect()
        if over:
            ended = "node_limit" if over[0]["nodes"] > max_nodes else "edge_limit"
            looked, step = over[0]["place"], step.where(F.col("place") < over[0]["place"])
        else:
            ended, looked = "work_limit" if spent else None, step.count()
        examined += looked
        if last:
            at_bound, limited = looked, step.where("taken = 0").groupBy(F.col(near).alias("node_id")).agg(F.count("*").alias("n"))
        rows = step.where("taken = 1").select("edge_id", "source", "target", F.lit(depth + 1).alias("depth"))
        taken = rows if taken is None else taken.unionByName(rows)
        frontier = cut(step.where("is_new = 1").select(F.col(far).alias("node_id"), F.lit(depth + 1).alias("depth"), F.col("nodes").cast("long").alias("arrival")), folder, f"nodes-{depth + 1}")
        seen, depth = seen.unionByName(frontier), depth + 1
        n_nodes, n_edges = seen.count(), taken.count()
        if frontier.isEmpty():
            break
    cut_off = limited is not None and not limited.isEmpty()
    return Walk(seen, taken, ["depth_limit"] * cut_off + [ended] * (ended is not None), examined, at_bound, limited, edges.select(F.col(near).alias("node_id")))


def walk_frontier(found: Walk) -> DataFrame:
    """node_id, depth, arrival, edges, pending, limited of every returned node: its edges in the walk's direction, those not looked
    at (with the one that ended the walk) and those to nodes beyond the depth bound. The frontier: pending or limited isn't 0."""
    degrees = found.adjacency.join(found.nodes.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("edges"))
    placed = found.nodes.join(degrees, "node_id", "left").fillna(0, ["edges"])
    # the walk looks at whole nodes in order of arrival; a window over the returned nodes, which max_nodes bounds
    before = F.coalesce(F.sum("edges").over(Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocked = bool(found.reasons) and found.reasons[-1] in ("node_limit", "edge_limit")
    done = F.least(F.col("edges"), F.greatest(F.lit(0), F.lit(found.examined - blocked) - F.col("before")))
    shown = placed.withColumn("before", before).withColumn("pending", F.col("edges") - done)
    if found.limited is None:
        return shown.select("node_id", "depth", "arrival", "edges", "pending", F.lit(0).cast("long").alias("limited"))
    return shown.join(found.limited, "node_id", "left").select("node_id", "depth", "arrival", "edges", "pending", F.coalesce("n", F.lit(0)).alias("limited"))


def walk_counters(found: Walk) -> DataFrame:
    """One row: examined, examined_at_bound, fully_examined (nodes), returned_nodes, returned_edges, exhausted, reasons."""
    nodes = walk_frontier(found).agg(F.count_if(F.col("pending") == 0).alias("fully_examined"), F.count("*").alias("returned_nodes"))
    shown = nodes.join(found.edges.agg(F.count("*").alias("returned_edges")), F.lit(True))  # one row each
    fixed = [F.lit(found.examined).cast("long").alias("examined"), F.lit(found.examined_at_bound).cast("long").alias("examined_at_bound")]
    return shown.select(*fixed, "fully_examined", "returned_nodes", "returned_edges", F.lit(not found.reasons).alias("exhausted"), F.lit(",".join(found.reasons)).alias("reasons"))


def paths(edges: DataFrame, source: str, target: str, max_depth: int = 16, max_paths: int = 20) -> DataFrame:
    """rank, hops, path, edge_ids: simple paths in order of (hops, edge ids), max_paths at most.

    Only edges from which the target can be reached in the hops that are left are followed.
    """
    if source == target:
        raise ValueError("source and target are the same")
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    edges = cut(edges.select("edge_id", "source", "target"), folder, "edges")
    reach = target_reach(edges, target, max_depth, ready=True)
    ends = reach.select(F.col("node_id").alias("target"), "shortest")
    useful = cut(edges.select("edge_id", "source", "target").join(ends, "target"), folder, "useful")
    grown = cut(spark.createDataFrame([(source, [source], [])], "at string, nodes array<string>, ids array<string>"), folder, "paths-0")
    done, hops = None, 0
    while hops < max_depth:
        step = grown.join(useful, grown["at"] == useful["source"]).where(~F.array_contains("nodes", F.col("target")) & (F.col("shortest") <= max_depth - hops - 1))
        grown = cut(step.select(F.col("target").alias("at"), F.concat("nodes", F.array("target")).alias("nodes"), F.concat("ids", F.array("edge_id")).alias("ids")), folder, f"paths-{hops + 1}")
        found = grown.where(F.col("at") == target)
        done = found if done is None else done.unionByName(found)
        grown, hops = grown.where(F.col("at") != target), hops + 1
        if done.count() >= max_paths or grown.isEmpty():  # later paths are longer
            break
    best = done.withColumn("hops", F.size("ids").cast("long")).orderBy("hops", "ids").limit(max_paths)
    return best.select(F.row_number().over(Window.orderBy("hops", "ids")).cast("long").alias("rank"), "hops", F.array_join("nodes", ">").alias("path"), F.array_join("ids", ",").alias("edge_ids"))


def path_search(edges: DataFrame, source: str, target: str, max_depth: int = 16, max_paths: int = 20) -> tuple[DataFrame, list[str]]:
    """(paths as `paths` gives them, reasons): `depth_limit` if a connection of more than max_depth hops exists,
    `path_limit` if there are more than max_paths within it. Without a reason the list of connections is whole."""
    folder = loop_dir(edges.sparkSession)
    edges = cut(edges.select("edge_id", "source", "target"), folder, "edges")
    found = cut(paths(edges, source, target, max_depth, max_paths + 1), folder, "found")  # one more tells
    reasons = ["depth_limit"] * reaches_beyond(edges, source, target, max_depth) + ["path_limit"] * (found.count() > max_paths)
    return found.where(F.col("rank") <= max_paths), reasons


def reaches_beyond(edges: DataFrame, source: str, target: str, hops: int) -> bool:
    """Whether some walk of more than `hops` edges leads from source to target; on acyclic edges every walk is a path.

    Nodes exactly hops + 1 edges away are found level by level, and followed until the target or nothing new is met.
    """
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    further = lambda nodes: nodes.withColumnRenamed("node_id", "source").join(edges, "source").select(F.col("target").alias("node_id")).distinct()
    frontier = spark.createDataFrame([(source,)], "node_id string")
    for n in range(hops + 1):
        frontier = cut(further(frontier), folder, f"away-{n}")
        if frontier.isEmpty():
            return False
    seen, step = frontier, 0
    while not frontier.isEmpty():
        if not frontier.where(F.col("node_id") == target).isEmpty():
            return True
        frontier = cut(further(frontier).join(seen, "node_id", "left_anti"), folder, f"new-{step}")
        seen, step = cut(seen.unionByName(frontier), folder, f"seen-{step}"), step + 1
    return False


def target_reach(edges: DataFrame, target: str, max_depth: int, ready: bool = False) -> DataFrame:
    """node_id, lengths (bit n: the target is n hops away on some walk), shortest, longest; lengths up to max_depth.

    One reverse step each round: a node's lengths are its successors' lengths moved up by one bit.
    """
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    edges = edges if ready else cut(edges.select("source", "target"), folder, "edges")
    state = level = cut(spark.createDataFrame([(target, 0)], "node_id string, hops int"), folder, "hops-0")
    for hops in range(1, max_depth + 1):
        level = cut(level.select(F.col("node_id").alias("target")).join(edges.select("source", "target"), "target").select(F.col("source").alias("node_id"), F.lit(hops).alias("hops")).distinct(), folder, f"hops-{hops}")
        if level.isEmpty():
            break
        state = state.unionByName(level)
    return state.groupBy("node_id").agg(F.bit_or(F.expr("shiftleft(1L, hops)")).alias("lengths"), F.min("hops").cast("long").alias("shortest"), F.max("hops").cast("long").alias("longest"))


def lift_constants(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row of shared values, rows with those columns nulled): a column is shared if it has one value and no null."""
    total = F.count(F.lit(1))
    shared = rows.agg(*[F.when((F.count(c) == total) & F.min(c).eqNullSafe(F.max(c)), F.min(c)).alias(c) for c in columns])
    joined = rows.join(shared.select(*[F.col(c).alias(f"shared_{c}") for c in columns]), F.lit(True))  # one row
    return shared, joined.select(*[F.when(F.col(f"shared_{c}").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def lower_constants(rows: DataFrame, shared: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of lift_constants."""
    joined = rows.join(shared.select(*[F.col(c).alias(f"shared_{c}") for c in columns]), F.lit(True))
    return joined.select(*[F.coalesce(F.col(c), F.col(f"shared_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def excerpt(rows: DataFrame, text: str, most: int) -> DataFrame:
    """rows with `excerpt`, the first characters of a text, and `cut_off`."""
    return rows.withColumn("excerpt", F.substring(F.col(text), 1, most)).withColumn("cut_off", F.length(text) > most)
