"""What keeps queries of larger tables in bounds: views computed once, few reads of the tables, no Python where Spark can do it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from curriq.operators import lp_graph, validation
from curriq.plans import queries as plans
from curriq.plans import views as V
from curriq.sources import slim

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def counted(rows):
    """rows, and a counter of how often they are computed."""
    n = rows.sparkSession.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return rows.mapInArrow(note, rows.schema), n


@tables
def test_progressions_take_one_join(spark):
    assert plan(V.progressions(spark, SMALL)).count("Join") == 1 and plan(plans.QUERIES["lp_summary"](spark, SMALL)).count("Join") == 1


def test_rules_compute_the_edges_once(spark):
    edges = spark.createDataFrame([("p", f"e{i}", i, "buildsTowards", "buildsTowards", f"e{i}", f"n{i}", f"n{i + 1}", "u", "u") for i in range(20)], "package_id string, edge_id string, seo long, label string, relationship_type string, property_identifier string, source string, target string, source_entity_value string, target_entity_value string")
    item = F.array(F.lit("StandardsFrameworkItem"))
    edges = edges.withColumns({f"{s}_{c}": v for s in ("source", "target") for c, v in (("labels", item), ("entity", F.lit("StandardsFrameworkItem")), ("entity_key", F.lit("caseIdentifierUUID")))} | {"status": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    standards = spark.createDataFrame([("p", f"n{i}", "u") for i in range(21)], "package_id string, node_id string, case_identifier_uuid string")
    packages = spark.createDataFrame([("p", True, False, True, 20, 0)], "package_id string, declared boolean, has_artifacts boolean, evidence_valid boolean, builds_towards int, relates_to int")
    edges, n = counted(edges)
    told = [tuple(r) for r in lp_graph.graph_rules(edges, standards, packages).collect()]
    assert n.value == 20 and sorted(r[2] for r in told if r[1] == "lp_pair_conflict") == sorted(f"e{i}" for i in range(1, 20))
    plain, n = counted(edges.select("edge_id", "label", "source", "target"))
    assert validation.report(validation.progression_graph(plain, standards)).count() == 0 and n.value == 20


def test_wire_lines_are_canonical_without_python(spark):
    odd = ["".join(map(chr, range(0, 40))), 'a\\u000B "\x0b\\\x1f/\x7f é😀', "\x0b\x0b\\\\\x0e", "plain"]
    rows = spark.createDataFrame([(t, "relatesTo", t, "b", ["X"], ["Y", t], t, None) for t in odd], "edge_id string, label string, source string, target string, source_labels array<string>, target_labels array<string>, author string, license string")
    lines = slim.wire_lines(rows)
    assert "Python" not in plan(lines)
    for r in lines.collect():
        t = r.edge_id
        assert r.value == slim.canonical({"identifier": t, "label": "relatesTo", "properties": {"author": t, "identifier": t}, "source_identifier": t, "source_labels": ["X"], "target_identifier": "b", "target_labels": ["Y", t], "type": "relationship"})
        json.loads(r.value)


def test_python_gets_small_batches(spark):
    from curriq.operators import search

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.range(20).select(F.col("id"), F.lit("ﬁne ｔｅｘｔ").alias("text"))  # not plain: folded by Python
    assert search.token_search(docs, "text", "fine", keep=("id",)).count() == 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_others_are_computed_once_and_counted(spark):
    from curriq.operators import framework_statistics as stats
    from test_framework_statistics import tables as small

    nodes, edges = small(spark)
    walked = F.col("label").isin("hasChild", "supports")
    others, n = counted(edges.where(~walked).select("package_id", "label"))
    split = sorted(map(str, stats.framework_statistics(nodes, edges.where(walked), "p", "root", others).collect()))
    assert n.value == 1 and split == sorted(map(str, stats.framework_statistics(nodes, edges, "p", "root").collect()))


def test_only_repeated_keys_are_looked_at_whole(spark):
    rows = [(f"e{i}", f"k{i % 90 if i < 100 else i}", i % 3) for i in range(300)] + [("e7", "k7", 1), ("e7", "k7", 1), ("x", None, 0)]
    found = validation.duplicates(spark.createDataFrame(rows, "edge_id string, key string, seo long"), ["key"], "again", "edge_id")
    want = []
    for key in {r[1] for r in rows if r[1]}:
        want += [e for _, e in sorted((s, e) for e, k, s in rows if k == key)[1:]]
    assert sorted(r.record_id for r in found.collect()) == sorted(want) and "LeftSemi" in plan(found)
