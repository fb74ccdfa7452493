"""Excerpts of judgments, and frameworks listed by one request."""

import pytest

from curriq.operators import catalog, judgments


def test_excerpts(spark):
    rows = [("a", 0.5, "é" * 513, ["w" * 513, "x", None, "y", "z", "w" * 600]), ("b", 1.0, "é" * 512, ["w" * 512]), ("c", None, None, None), ("d", 0.0, "", ["1", "2", "3", "4", "5"])]
    found = {r.edge_id: r for r in judgments.projections(spark.createDataFrame(rows, "edge_id string, confidence double, rationale string, warnings array<string>")).collect()}
    a = found["a"]
    assert a.rationale_excerpt == "é" * 512 and a.rationale_excerpted and a.warning_count == 6 and a.warning_excerpts == ["w" * 512, "x", "", "y", "z"] and a.warnings_excerpted and a.warnings_omitted
    assert not any((found["b"].rationale_excerpted, found["b"].warnings_excerpted, found["b"].warnings_omitted)) and found["c"].rationale_excerpt == "" and found["c"].warning_count == 0 and not found["d"].warnings_omitted


def test_evidence_of_edges(spark):
    edges = spark.createDataFrame([("e", "n", "m"), ("f", "m", "n")], "edge_id string, source string, target string")
    nodes = spark.createDataFrame([("n", "x" * 3000), ("m", None)], "node_id string, description string")
    said = spark.createDataFrame([("e", 0.5, "why", ["w"])], "edge_id string, confidence double, rationale string, warnings array<string>")
    found = {r.edge_id: r for r in judgments.edge_evidence(edges, nodes, said).collect()}
    assert found["e"].judged and len(found["e"].source_statement) == 2048 and found["e"].source_shortened and found["e"].target_statement is None and not found["f"].judged
    with pytest.raises(ValueError, match="twice"):
        judgments.edge_evidence(edges, nodes, said.unionByName(said))


def test_lists_of_frameworks(spark):
    rows = [("f", "s1", "p1", "t", True, "passed", "Maths F", ["Math"]), ("f", "s1", "p2", "u", True, "failed", "Maths F", ["STEM"]), ("f", "s2", "p3", "t", False, "passed", "Maths F", ["Math"]), ("g", "s3", "p4", "t", True, "failed", "Arts G", [])]
    packages = spark.createDataFrame(rows, "framework_id string, snapshot_id string, package_id string, graph_type string, is_current boolean, status string, name string, subjects array<string>")

    def listed(**kw):
        return [(r.snapshot_id, r.total) for r in catalog.list_frameworks(packages, catalog.ListRequest(**kw)).collect()]

    assert listed() == [("s1", 3), ("s2", 3), ("s3", 3)] and listed(limit=1) == [("s1", 3)] and listed(limit=1, after=("f", "s1")) == [("s2", 3)]
    assert listed(current=True) == [("s1", 2), ("s3", 2)] and listed(graph_types=("u",)) == [("s1", 1)] and listed(statuses=("failed",)) == [("s1", 2), ("s3", 2)] and listed(members=(("subjects", (" stem",)),)) == [("s1", 1)]
    assert listed(query="MATHS s2") == [("s2", 1)] and listed(query="th s") == [("s1", 2), ("s2", 2)] and listed(query="nobody") == []
    assert catalog.list_frameworks(packages, catalog.ListRequest(graph_types=("u",))).first().package_ids == ["p1", "p2"]
    with pytest.raises(LookupError):
        listed(after=("f", "s9"))
