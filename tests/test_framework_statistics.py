"""Statistics of a small framework, and that its counts need one scan of each table."""

from curriq.operators import framework_statistics as stats

NODE = "package_id string, node_id string, kind string, statement_type string, normalized_statement_type string, statement_code string, grade_level array<string>, tags array<string>, normalized_grades array<string>, resolved_local_grade_labels array<string>"
EDGE = "package_id string, edge_id string, label string, relationship_type string, status string, source string, target string, confidence double"


def tables(spark):
    item = lambda i, t, *g, code=None, p="p": (p, i, "standard", t, None, code, list(g) or None, None, list(g), [])
    part = lambda i, *tags: ("p", i, "component", None, None, None, None, list(tags), None, None)
    nodes = [("p", "root", "framework", None, None, None, None, None, None, None), item("a", "T", "1", "2", code="x"), item("b", "T", "1"), item("c", None), item("d", "U"), item("z", "U"), part("k", "Sum ", "sum", ""), part("m"), part("n"), item("q", "T", p="other")]
    edge = lambda i, label, s, t, status=None, c=None, p="p": (p, i, label, label, status, s, t, c)
    edges = [
        edge("1", "hasChild", "root", "a"), edge("2", "hasChild", "root", "b"), edge("3", "hasChild", "a", "c"), edge("4", "hasChild", "b", "c", "open"), edge("5", "hasChild", "c", "d"), edge("6", "supports", "k", "a", c=0.5), edge("7", "supports", "k", "c", c=0.25), edge("8", "supports", "m", "a"),
        edge("9", "buildsTowards", "a", "b"), edge("10", "hasChild", "q", "q", p="other"),
    ]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_all_sections_of_a_small_framework(spark):
    found = {}
    for r in stats.framework_statistics(*tables(spark), "p", "root").collect():
        found.setdefault(r.section, {})[r.value] = r.n if r.amount is None else r.amount
    assert found == {
        "nodes": {"framework": 1, "standard": 5, "component": 3}, "statement_type": {"T": 2, "U": 2, None: 1}, "normalized_statement_type": {None: 5}, "code_presence": {"coded": 1, "uncoded": 4}, "node_grade_level": {"1": 2, "2": 1, None: 3},
        "normalized_grade": {"1": 2, "2": 1, None: 3}, "local_grade_label": {None: 5}, "relationships": {"hasChild": 5, "supports": 3, "buildsTowards": 1}, "canonical_label": {"hasChild": 5}, "relationship_type": {"hasChild": 5}, "resolution_status": {"open": 1, None: 4},
        "relationship_resolution": {"resolved": 4, "unresolved": 1}, "parent_count": {"0": 1, "1": 3, "2": 1}, "multi_parent_maximum": {None: 2}, "multi_parent_targets": {None: 1}, "components_per_standard": {"0": 1, "1": 1, "2": 1}, "supported_statement_type": {"": 1, "T": 2},
        "bridge_span": {"2": 1}, "multi_standard_components": {None: 1}, "support_confidence": {"minimum": 0.25, "maximum": 0.5}, "tag_vocabulary": {None: 1}, "depth": {"0": 1, "1": 2, "2": 1, "3": 1}, "unreachable": {None: 2},
    }


def test_packages_stay_apart_in_one_pass(spark, tmp_path):
    nodes, edges = tables(spark)
    nodes.write.parquet(str(tmp_path / "nodes"))
    edges.write.parquet(str(tmp_path / "edges"))
    flat = stats.flat_statistics(*[spark.read.parquet(str(tmp_path / t)) for t in ("nodes", "edges")])
    assert {(r.section, r.value): r.n for r in flat.where("package_id = 'other' AND section IN ('nodes', 'parent_count', 'relationships')").collect()} == {("nodes", "standard"): 1, ("parent_count", "1"): 1, ("relationships", "hasChild"): 1}
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
