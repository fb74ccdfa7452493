"""A context's parts, its once-listed tables, and the byte budget to the byte; pages of progressions continued by key."""

import json

import pytest
from pyspark.sql import functions as F

from curriq.operators import context, progressions

EDGES = [("e1", "root", "a", 1, None), ("e2", "root", "b", 2, "open"), ("e3", "a", "c", 3, "open"), ("e4", "b", "c", 4, None), ("e5", "c", "d", 6, None), ("e6", "c", "f", 5, "odd"), ("e7", "d", "g", 7, "deep")]


def tables(spark):
    edges = spark.createDataFrame(EDGES, "edge_id string, source string, target string, seo long, status string")
    names = sorted({n for e in EDGES for n in e[1:3]})
    return edges, spark.createDataFrame([(n, f"node {n}") for n in names], "node_id string, name string")


def listed(found, section):
    return [r for r in found.entries.orderBy("ord").collect() if r.section == section]


def test_all_parts(spark):
    found = context.standard_context(*tables(spark), "root", "c", context.Bounds(child_depth=1))
    assert [(r.node_id, r.edge_id) for r in listed(found, "direct_parents")] == [("a", "e3"), ("b", "e4")] and [r.node_id for r in listed(found, "direct_children")] == ["f", "d"]
    assert [(r.node_id, r.depth) for r in listed(found, "ancestors")] == [("c", 0), ("a", 1), ("b", 1), ("root", 2)] and [(r.node_id, r.depth) for r in listed(found, "descendants")] == [("c", 0), ("d", 1), ("f", 1)]
    assert [r.edge_id for r in listed(found, "ancestor_edges")] == ["e1", "e2", "e3", "e4"] and [r.edge_id for r in listed(found, "descendant_edges")] == ["e6", "e5"]
    assert [r.path for r in listed(found, "root_paths")] == [["root", "a", "c"], ["root", "b", "c"]]
    assert [(r.edge_id, r.status) for r in listed(found, "statuses")] == [("e2", "open"), ("e3", "open"), ("e6", "odd")]  # e7 is below
    assert sorted(r.node_id for r in found.nodes.collect()) == ["a", "b", "c", "d", "f", "root"] and sorted(r.edge_id for r in found.edges.collect()) == ["e1", "e2", "e3", "e4", "e5", "e6"]
    assert found.truncation == {}
    with pytest.raises(LookupError):
        context.standard_context(*tables(spark), "root", "nobody")


def test_the_budget_is_exact(spark):
    """An entry is in as long as its record and what it mentions first fit; one byte less and it isn't."""
    edges, nodes = tables(spark)
    whole = context.standard_context(edges, nodes, "root", "c", context.Bounds(reserve=0))
    rows = whole.entries.orderBy("ord").collect()
    plain = lambda x: len(json.dumps({k: v for k, v in x.items() if v is not None}, separators=(",", ":")).encode())
    first = rows[0]
    assert first.bytes == plain({"section": "standard", "place": 1, "node_id": "c"}) + plain({"node_id": "c", "name": "node c"}) and rows[-1].running == sum(r.bytes for r in rows)
    at = rows[7].running
    for budget, n in ((at, 8), (at - 1, 7)):
        cut = context.admitted(whole.told, nodes, edges, context.Bounds(max_bytes=budget + 100, reserve=100), {})
        assert cut.entries.count() == n and cut.truncation == {"byte_limit": "byte_limit"}


def test_bounds_of_the_parts(spark):
    found = context.standard_context(*tables(spark), "root", "d", context.Bounds(max_nodes=2, max_paths=1))
    assert found.truncation == {"ancestors": "max_nodes", "root_paths": "max_paths"}


def test_pages_of_progressions_by_key(spark):
    edges = spark.createDataFrame([(f"e{i:03d}", ("b", "r")[i % 2], f"n{i}", f"n{i + 1}") for i in range(60)], "edge_id string, label string, source string, target string")
    nodes = spark.createDataFrame([(f"n{i}", i % 3 != 0) for i in range(61)], "node_id string, hit boolean")
    whole = [tuple(r) for r in progressions.discover(edges, nodes, F.col("hit"), "both", limit=100).collect()]
    got, position, after = [], 0, None
    while True:
        page = [tuple(r) for r in progressions.discover(edges, nodes, F.col("hit"), "both", position=position, limit=7, after=after).collect()]
        assert position == 0 or page == [tuple(r) for r in progressions.discover(edges, nodes, F.col("hit"), "both", position=position, limit=7).collect()]
        if not page:
            break
        got += page
        position, after = page[-1][0] + 1, page[-1][1:3]
    assert got == whole and len(whole) > 14
