"""Rules of progression edges on large tables: narrow tables and shuffles that go, and the same findings whatever the hashes."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curriq.operators import lp_graph
from curriq.plans import queries as plans

SMALL = "/root/testdata/sf0.001"
ITEM = ["StandardsFrameworkItem"]
SCHEMA = "package_id string, edge_id string, seo long, label string, relationship_type string, property_identifier string, source string, target string, source_labels array<string>, target_labels array<string>, source_entity string, target_entity string, source_entity_key string, target_entity_key string, source_entity_value string, target_entity_value string, status string, confidence double"


def edge(p, e, n, label, s, t, u=None, v=None):
    return (p, e, n, label, label, e, s, t, ITEM, ITEM, ITEM[0], ITEM[0], "caseIdentifierUUID", "caseIdentifierUUID", u or s, v or t, None, None)


def shuffles(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_little_stays_on_disk(spark):
    shared, held = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")), ("spark.sql.parquet.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    conf, there, before = [spark.conf.get(key) for key in held], set(shared.rglob("*.parquet")), shuffles(spark)
    found = plans.QUERIES["findings_lp_graph"](spark, SMALL)
    assert [spark.conf.get(key) for key in held] == conf
    for _ in range(20):  # they go in the background
        if shuffles(spark) <= before:
            break
        time.sleep(0.5)
    assert shuffles(spark) <= before
    tables = {}
    for f in set(shared.rglob("part-*.parquet")) - there:
        tables.setdefault(f.parent.name, []).append(f)
    assert "pairs" not in tables and "edges" not in {n for n, files in tables.items() if "edge_id" in spark.read.parquet(str(files[0])).columns}
    edges = spark.read.parquet(*map(str, tables["placed"]))
    assert {kind for c, kind in edges.dtypes if c != "package_id"} == {"bigint", "boolean"} and found.count() > edges.count() / 2


def test_conflicts_brute_force(spark, monkeypatch):
    """Pairs and ids that repeat among many, in many buckets of the sieve; then with so few hashes that all rows pass."""
    r = random.Random(4)
    rows = [edge(r.choice("pqr"), f"e{r.randrange(9000)}", i, r.choice(["buildsTowards", "relatesTo"]), f"n{r.randrange(70)}", f"m{r.randrange(70)}") for i in range(5000)]
    rows += [edge("p", None, 5000, "relatesTo", "n1", "lone"), edge("p", "last", 5001, "relatesTo", "lone", "n1"), edge(None, "e1", 5002, "relatesTo", "n1", "m1"), edge(None, "e1", 5003, "relatesTo", "n1", "m1")]
    seen, want = set(), []
    for x in rows:
        keys = {(x[0], x[1]), (x[0], *sorted(x[14:16]))} if x[1] else {(x[0], *sorted(x[14:16]))}
        if x[0] and x[1] and keys & seen:
            want.append((x[0], x[1]))
        seen |= keys
    edges = spark.createDataFrame(rows, SCHEMA)
    standards = edges.select("package_id", F.col("source").alias("node_id"), F.col("source").alias("case_identifier_uuid")).distinct()
    packages = spark.createDataFrame([("p", True, False, True, 0, 0)], "package_id string, declared boolean, has_artifacts boolean, evidence_valid boolean, builds_towards int, relates_to int")
    told = lambda: sorted((x.package_id, x.record_id) for x in lp_graph.graph_rules(edges, standards, packages).where("code = 'lp_pair_conflict'").collect())
    assert told() == sorted(want) and 1000 < len(want) < 4000
    monkeypatch.setattr(lp_graph, "_hash", lambda keys: F.expr(f"xxhash64({', '.join(keys)}) & 3"))
    assert told() == sorted(want)


def test_few_rows_pass_the_sieve(spark, tmp_path):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") % 1000 == 7, -1).otherwise(F.col("id")).alias("key"))
    passed = lp_graph._sifted(rows, {"key": (["key"], lp_graph._sieve(rows, ["key"], 20000, str(tmp_path), "sieve"))})
    got = {x.k for x in passed.collect()}
    assert passed.columns == ["k", "key"] and {x for x in range(20000) if x % 1000 == 7} <= got and len(got) < 40


def test_ends_that_are_known_before(spark):
    """Edges with what their ends are known by, computed of a written table, tell the same as edges and standards."""
    r = random.Random(5)
    rows = [edge(p, f"{p}{i}", i, r.choice(["buildsTowards", "relatesTo", "other"]), s := f"n{r.randrange(9)}", t := f"n{r.randrange(12)}", r.choice([s, s, s, "x"]), r.choice([t, t, t, "x"])) for p in "abcdefgh" for i in range(r.choice([3, 6, 12]))]
    rows += [edge("line", f"l{i}", i, "buildsTowards", f"n{i}", f"n{i + 1}") for i in range(9)] + [edge("ring", f"r{i}", i, "buildsTowards", f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    edges = spark.createDataFrame(rows, SCHEMA)
    names = sorted({x[0] for x in rows})
    standards = spark.createDataFrame([(p, f"n{i}", None if i == 3 else f"n{i}") for p in names for i in range(10)], "package_id string, node_id string, case_identifier_uuid string")
    packages = spark.createDataFrame([(p, True, False, True, 3, 3) for p in names], "package_id string, declared boolean, has_artifacts boolean, evidence_valid boolean, builds_towards int, relates_to int")
    known = lambda side: F.when(F.regexp_extract(side, "[0-9]+", 0).cast("int").between(0, 9) & (F.col(side) != "n3"), F.col(side)).alias(f"{side}_uuid")
    listed = lambda found: sorted(map(repr, found.collect()))
    want = listed(lp_graph.graph_rules(edges, standards, packages))
    assert listed(lp_graph.graph_rules(edges.select("*", known("source"), known("target")), None, packages, ready=True)) == want
    cyclic = {x for x in names if f"Row(package_id='{x}', code='lp_builds_towards_cycle', record_id=None)" in want}
    step = {p: {(x[6], x[7]) for x in rows if x[0] == p and x[3] == "buildsTowards"} for p in names}
    for p in names:
        reach = set(step[p])
        while more := {(a, d) for a, b in reach for c, d in step[p] if b == c} - reach:
            reach |= more
        assert any(a == b for a, b in reach) == (p in cyclic)
    assert "ring" in cyclic and "line" not in cyclic
