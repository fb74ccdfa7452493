"""Bounded hierarchy traversal, induced edges, root paths and reachability over tables of edges.

Edges have edge_id, source, target and seo (source export order); nodes are ids. Every loop takes one level at a time:
the frontier meets the edges by a join on its node ids, and each level is a table in the shared folder, so a lost executor
costs one level. Edges are written there once, whatever view they come from; what has been seen is a union of levels
that is written anew every FOLD levels, so that plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curriq.session import cut, loop_dir


FOLD = 8


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: str, direction: str) -> DataFrame:
    """Direct parents or children of a node in order of (seo, edge_id); an edge without its other node is an error."""
    near, far = ("target", "source") if direction == "parents" else ("source", "target")
    own = edges.where(F.col(near) == node_id)
    lost = own.join(nodes.select(F.col("node_id").alias(far)), far, "left_anti")
    if not lost.isEmpty():
        raise LookupError(f"an edge of {node_id} has no {far} node")
    return own.select("edge_id", "seo", F.col(far).alias("node_id")).join(nodes, "node_id").orderBy("seo", "edge_id")


def traverse(edges: DataFrame, start: str, down: bool = True, max_depth: int = 64, max_nodes: int | None = None, order: str = "node_id", ready: bool = False) -> tuple[DataFrame, str | None]:
    """((node_id, depth), truncation): nodes by smallest depth, the start with 0.

    A level that would exceed max_nodes keeps its first nodes in order of id and ends the traversal with `max_nodes`.
    ready: the edges are a written table already.
    """
    near, far = ("source", "target") if down else ("target", "source")
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    if not ready and max_depth > 1:
        edges = cut(edges.select(near, far), folder, "edges")
    seen = cut(spark.createDataFrame([(start, 0)], "node_id string, depth int"), folder, "level-0")
    frontier, count, depth = seen, 1, 0
    while depth < max_depth:
        step = frontier.select(F.col("node_id").alias(near)).join(edges.select(near, far), near).select(F.col(far).alias("node_id")).distinct()
        level = step.join(seen.select("node_id"), "node_id", "left_anti")
        room = None if max_nodes is None else max_nodes - count
        if room is not None:
            level = level.orderBy(order).limit(room + 1)  # one more tells whether the level overflows
        level = cut(level.select("node_id", F.lit(depth + 1).alias("depth")), folder, f"level-{depth + 1}")
        found = level.count()
        if not found:
            return seen, None
        if room is not None and found > room:
            return seen.unionByName(level.orderBy(order).limit(room)), "max_nodes"
        seen, frontier, count, depth = seen.unionByName(level), level, count + found, depth + 1
        if depth % FOLD == 0:
            seen = cut(seen, folder, f"seen-{depth}")
    return seen, None


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_id), in order of (seo, edge_id)."""
    ids = nodes.select("node_id").distinct()
    both = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return both.orderBy("seo", "edge_id")


def root_paths(edges: DataFrame, root: str, node_id: str, max_depth: int = 64, max_paths: int = 1000, max_occurrences: int = 100_000) -> tuple[DataFrame, str | None]:
    """((rank, path, nodes), truncation) of `ranked_root_paths`, with a path's nodes as text and their number."""
    found, reason = ranked_root_paths(edges, root, node_id, max_depth, max_paths, max_occurrences)
    return found.select("rank", F.array_join("nodes", ">").alias("path"), F.size("nodes").cast("long").alias("nodes")), reason


def ranked_root_paths(edges: DataFrame, root: str, node_id: str, max_depth: int = 64, max_paths: int = 1000, max_occurrences: int = 100_000) -> tuple[DataFrame, str | None]:
    """((rank, nodes, edge_ids), truncation): complete paths from root to node_id in order of their edges' keys from the node up.

    Only edges among the node's ancestors are followed. The list ends before the first path that breaks a bound; the
    number of paths is named before the number of nodes on them. A node twice on a path is an error.
    """
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    edges = cut(edges.select("edge_id", "source", "target", "seo"), folder, "all")
    above, _ = traverse(edges, node_id, down=False, max_depth=max_depth, ready=True)
    own = cut(edges.join(above.select(F.col("node_id").alias("source")), "source", "left_semi").join(above.select(F.col("node_id").alias("target")), "target", "left_semi"), folder, "edges")
    # a path is followed where the root is near enough, so each one becomes a complete path, and the first max_paths + 1
    # of each level, in order of keys, hold the first complete ones
    near_root = cut(traverse(own, root, max_depth=max_depth, ready=True)[0].select(F.col("node_id").alias("source"), F.col("depth").alias("to_root")), folder, "to-root")
    paths = cut(spark.createDataFrame([(node_id, [node_id], [])], "at string, nodes array<string>, keys array<struct<seo:bigint,edge_id:string>>"), folder, "paths-0")
    done, depth = paths.where(F.col("at") == root), 0
    while depth < max_depth:
        longer = paths.where(F.col("at") != root).join(own, F.col("at") == F.col("target")).join(near_root, "source").where(F.col("to_root") <= max_depth - depth - 1)
        grown = cut(longer.select(F.col("source").alias("at"), F.concat("nodes", F.array("source")).alias("nodes"), F.concat("keys", F.array(F.struct(F.col("seo").cast("long").alias("seo"), "edge_id"))).alias("keys")), folder, f"paths-{depth + 1}")
        if grown.isEmpty():
            break
        if not grown.where(F.size("nodes") != F.size(F.array_distinct("nodes"))).isEmpty():
            raise ValueError("the hierarchy has a cycle")
        paths = cut(grown.orderBy("keys").limit(max_paths + 1), folder, f"first-{depth + 1}")
        done, depth = done.unionByName(paths.where(F.col("at") == root)), depth + 1
    # what the bounds can let through is known to be short: one more path than may be returned
    first = done.withColumn("length", F.size("nodes").cast("long")).orderBy("keys").limit(max_paths + 1)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("keys")).cast("long")).withColumn("running", F.sum("length").over(Window.orderBy("keys").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = cut(ranked, folder, "ranked")
    fits = (F.col("rank") <= max_paths) & (F.col("running") <= max_occurrences)
    over = ranked.where(~fits).orderBy("rank").limit(1).collect()
    reason = None if not over else "max_paths" if over[0]["rank"] > max_paths else "max_path_node_occurrences"
    return ranked.where(fits).select("rank", F.reverse("nodes").alias("nodes"), F.reverse(F.transform("keys", lambda k: k["edge_id"])).alias("edge_ids")), reason


def reachable(edges: DataFrame, start: DataFrame, symmetric: bool = False) -> DataFrame:
    """Node ids that edges lead to from start (node_id), start included; symmetric: whatever their direction."""
    if symmetric:
        edges = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    folder, step = loop_dir(edges.sparkSession), 0
    edges = cut(edges.select("source", "target"), folder, "edges")
    seen = frontier = cut(start.select("node_id").distinct(), folder, "step-0")
    while True:
        new = frontier.withColumnRenamed("node_id", "source").join(edges.select("source", "target"), "source").select(F.col("target").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        frontier = cut(new, folder, f"step-{step + 1}")
        if frontier.isEmpty():
            return seen
        seen, step = seen.unionByName(frontier), step + 1
        if step % FOLD == 0:
            seen = cut(seen, folder, f"seen-{step}")


def peel(edges: DataFrame) -> DataFrame:
    """Edges (source, target) left after removing nodes without incoming edges again and again: empty without a cycle.

    Edges are written once. A round takes those of the nodes that the round before removed, and a node goes once all its
    incoming edges are taken, which a small table of open counts tells: each edge is taken once, however many rounds.
    """
    folder, step = loop_dir(edges.sparkSession), 0
    edges = cut(edges.select("source", "target"), folder, "edges")
    needs = cut(edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")), folder, "needs")
    gone = front = cut(edges.select(F.col("source").alias("node")).distinct().join(needs, "node", "left_anti").select("node"), folder, "gone-0")
    open_ = needs.withColumn("n", F.lit(0).cast("long")).limit(0)  # (node, n): incoming edges taken so far
    while not front.isEmpty():
        taken = edges.join(front.withColumnRenamed("node", "source"), "source", "left_semi").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
        counted = open_.unionByName(taken).groupBy("node").agg(F.sum("n").alias("n"))
        met = cut(counted.join(needs.withColumnRenamed("n", "all"), "node").select("node", "n", (F.col("n") == F.col("all")).alias("done")), folder, f"met-{step + 1}")
        front, open_ = met.where("done").select("node"), met.where("NOT done").select("node", "n")
        gone, step = gone.unionByName(front), step + 1
        if step % FOLD == 0:
            gone = cut(gone, folder, f"gone-{step}")
    return edges.join(gone.withColumnRenamed("node", "source"), "source", "left_anti")


def cycle_witness(edges: DataFrame) -> list[str]:
    """Edge ids of one cycle, or none.

    Every node that peeling leaves has an incoming edge, and one of them is its parent pointer. Pointers are doubled until
    they are longer than any chain, so what they then point to lies on a cycle; the cycle of the smallest such node
    is collected by doubling as well: a logarithmic number of joins, and only the cycle's own ids come to the driver.
    """
    folder = loop_dir(edges.sparkSession)
    left = cut(peel(edges).distinct(), folder, "left")
    nodes = left.count()
    if not nodes:
        return []
    own = cut(edges.join(left, ["source", "target"], "left_semi").groupBy("target").agg(F.min(F.struct("source", "edge_id")).alias("e")).select(F.col("target").alias("node"), F.col("e.source").alias("up"), F.col("e.edge_id").alias("edge_id")), folder, "parents")
    jump, steps = own.select("node", "up"), 0
    while 1 << steps <= nodes:
        jump = cut(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), folder, f"jump-{steps}")
        steps += 1
    start = jump.agg(F.min("up")).first()[0]
    # (node, end): from the start's parent upwards, the nodes met so far, and twice as many after each round
    met, hop, k = cut(own.where(F.col("node") == start).select("node"), folder, "met-0"), own.select("node", "up"), 0
    while True:
        more = met.join(hop, "node").select(F.col("up").alias("node")).unionByName(met).distinct()
        more = cut(more, folder, f"met-{k + 1}")
        if more.count() == met.count():
            break
        hop = cut(hop.join(hop.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), folder, f"hop-{k}")
        met, k = more, k + 1
    ring = {r["node"]: (r["up"], r["edge_id"]) for r in own.join(met, "node").collect()}  # one cycle
    ids, at = [], start
    while not ids or at != start:
        ids.append(ring[at][1])
        at = ring[at][0]
    return ids[::-1]


def root_paths_of(edges: DataFrame, origins: DataFrame, root: str, max_depth: int = 64) -> DataFrame:
    """(origin, path): every path from root to each of origins (node_id), all origins going up together."""
    folder = loop_dir(edges.sparkSession)
    edges = cut(edges.select("source", "target"), folder, "edges")
    paths = cut(origins.select(F.col("node_id").alias("origin"), F.col("node_id").alias("at"), F.array("node_id").alias("nodes")), folder, "paths-0")
    done, depth = paths.where(F.col("at") == root), 0
    while depth < max_depth:
        step = paths.where(F.col("at") != root).join(edges.select("source", "target"), F.col("at") == F.col("target"))
        paths = cut(step.select("origin", F.col("source").alias("at"), F.concat(F.array("source"), "nodes").alias("nodes")), folder, f"paths-{depth + 1}")
        if paths.isEmpty():
            break
        done, depth = done.unionByName(paths.where(F.col("at") == root)), depth + 1
    return done.select("origin", F.array_join("nodes", ">").alias("path"))
