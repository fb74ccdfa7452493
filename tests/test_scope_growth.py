"""Scopes over large tables: edges of coded nodes are written once, whatever the levels and types."""

import random

from pyspark.sql import functions as F

from curriq.functions.text import CodeRules
from curriq.operators import scopes


def test_edges_are_written_once(spark, monkeypatch):
    """Leaves below many parents, three levels and two types: what is written is about one row an edge."""
    rows, write = [], scopes.cut

    def counted(df, folder, name):
        out = write(df, folder, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(scopes, "cut", counted)
    low = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 20).alias("source"), F.concat(F.lit("p"), (F.col("id") / 20).cast("int")).alias("target"))
    high = spark.createDataFrame([(f"n{i % 4}", f"s{i}") for i in range(20)] + [(f"r{i % 2}", f"n{i}") for i in range(4)], "source string, target string")
    edges = low.unionByName(high)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("statement_type", F.substring("node_id", 1, 1))
    coded = nodes.where("statement_type = 'p'")
    wanted = spark.createDataFrame([("n",), ("r",)], "scope_type string")
    found = scopes.nearest_scopes(edges, nodes, coded, wanted)
    assert found.count() == 200 * 4 + 200 * 2 and sum(rows) < 1.2 * 4024


def test_random_graphs_brute_force(spark):
    """Coded nodes above each other, edges to nodes that aren't there, repeated edges and cycles."""
    r = random.Random(5)
    for cyclic in (False, True):
        n = 24
        pairs = [tuple(sorted(r.sample(range(n), 2))) for _ in range(40)] + ([(9, 4), (4, 9)] if cyclic else [])
        pairs += pairs[:5] + [(99, 3)]
        kind = {i: r.choice(["a", "b", "c", None]) for i in range(n)} | ({4: "c", 9: "c"} if cyclic else {})
        asked = {i for i in range(n) if r.random() < 0.6} | {4}
        ups = {i: {s for s, t in pairs if t == i and s in kind} for i in kind}

        def scope(i, t, way):
            """Matches above i; None on or below a cycle."""
            if i in way:
                return None
            parts = [{u} if kind[u] == t else scope(u, t, way | {i}) for u in ups[i]]
            return None if None in parts else set().union(*parts)

        want = {(i, t): scope(i, t, frozenset()) for i in asked for t in "ab"}
        edges = spark.createDataFrame([(str(s), str(t)) for s, t in pairs], "source string, target string")
        nodes = spark.createDataFrame([(str(i), k) for i, k in kind.items()], "node_id string, statement_type string")
        coded, wanted = spark.createDataFrame([(str(i),) for i in asked], "node_id string"), spark.createDataFrame([("a",), ("b",)], "scope_type string")
        found, left = scopes.resolved_scopes(edges, nodes, coded, wanted)
        got = [(int(x.node_id), x.scope_type, x.scope_id) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, t, s) for (i, t), own in want.items() if own is not None for s in (map(str, own) if own else [None])}
        stuck = {(int(x.target), x.scope_type) for x in left.collect()}
        assert {(i, t) for i, t in stuck if i in asked} == {k for k, own in want.items() if own is None} and bool(stuck) == cyclic
        problems = {(x.problem, int(x.node_id), x.scope_type) for x in scopes.scope_problems(edges, nodes, coded, wanted).collect()}
        assert problems == {("scope-cycle" if own is None else "scope-missing", i, t) for (i, t), own in want.items() if not own}


def test_selectors_gather_what_is_asked_for(spark):
    """Nodes meet the request's keys where they are read; no shuffle or aggregate holds all of them."""
    nodes = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.concat(F.lit("u"), "id").alias("case_uuid"), F.lit("uri").alias("case_uri"), F.concat(F.lit("C."), F.col("id") % 7).alias("code"))
    asked = spark.createDataFrame([("node_id", "n7"), ("code", " c. 3"), ("case_uuid", "u1"), ("case_uuid", "none")], "kind string, value string")
    rows = scopes.resolve_selectors(asked, nodes, CodeRules())
    assert {(r.kind, r.value): (r.nodes, r.node_id, r.result) for r in rows.collect()} == {("node_id", "n7"): (1, "n7", "found"), ("code", " c. 3"): (714, None, "ambiguous"), ("case_uuid", "u1"): (1, "n1", "found"), ("case_uuid", "none"): (0, None, "not_found")}
    assert "BroadcastHashJoin [kind" in rows._jdf.queryExecution().sparkPlan().toString()
