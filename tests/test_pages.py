"""Facet evidence, search pages and code scopes on small hand-made packages."""

import pytest
from pyspark.sql import functions as F

from curriq.operators import facets, pages, scopes

NODE = "package_id string, node_id string, seo long, text string, code string, grade_level array<string>, academic_subject string, statement_type string, normalized_statement_type string"
PACKAGE = "framework_id string, snapshot_id string, graph_type string, package_revision int, package_id string, text_search boolean, code_availability string, allow_prefix boolean, index_sha256 string"
POLICY = [facets.Profile("p1", [("Lower", ["L 1"], ["1", "2"]), ("Upper", [], ["2", "3"])], ["Maths", "Mathematics"], ["Math", "STEM"], {"Standard": ["Std"]}), facets.Profile("p2", [("Lower", [], ["9"])], ["Art"], ["Arts"], {"Goal": ["Standard"]})]


def rows(spark):
    nodes = [
        ("p1", "a", 1, "count the apples", "A.1", ["1"], " maths", "Std", "Standard"), ("p1", "b", 2, "count the pears", "A.1.1", None, "Music", "Standard", "Standard"), ("p1", "g", 3, "the count", "B", ["2"], "Maths", "Strand", "Standard Grouping"),
        ("p2", "a", 1, "the apples count", "A.1", ["9", "9"], "art", "standard", None), ("p2", "c", 2, None, None, [], None, None, None), ("p3", "x", 1, "count the plums", "A.1", ["1"], "Maths", "Std", "Standard"),
    ]
    found = [("f", "f@1", "t", 1, "p1", True, "complete", True, "s1"), ("f", "f@2", "t", 1, "p2", True, "partial", False, "s2"), ("g", "g@1", "t", 1, "p3", False, "none", False, "s3")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(found, PACKAGE), facets.profiles(spark, POLICY)


def test_evidence_hands_grades_down(spark):
    nodes, _, policies = rows(spark)
    above = spark.createDataFrame([("p1", "b", "g"), ("p1", "b", "a"), ("p1", "b", "a")], "package_id string, node_id string, scope_id string")
    found = {(r.package_id, r.node_id): r for r in facets.evidence(nodes, policies, above).collect()}
    b = found["p1", "b"]
    assert b.normalized_grades == ["1", "2"] and b.node_grade_levels == [] and b.resolved_local_grade_labels == ["Lower", "Upper"] and b.normalized_subjects == [] and b.local_subject == "Music"
    assert found["p1", "a"].normalized_subjects == ["Math", "STEM"] and found["p2", "a"].normalized_grades == ["9"] and found["p2", "a"].canonical_type == "Goal"
    assert found["p3", "x"].resolved_local_grade_labels == [] and found["p3", "x"].normalized_subjects == []  # no profile


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({}, ["p1a", "p1b", "p2a", "p2c", "p3x"]), ({"include_groupings": True}, ["p1a", "p1b", "p1g", "p2a", "p2c", "p3x"]), ({"local_grade_labels": ("l  1",)}, ["p1a"]), ({"local_grade_labels": ("lower",)}, ["p1a", "p2a"]), ({"local_grade_labels": ("nobody",)}, []),
        ({"local_grade_labels": ("nobody", "LOWER")}, ["p1a", "p2a"]), ({"normalized_grades": ("9", "7")}, ["p2a"]), ({"local_subjects": ("mathematics",)}, ["p1a"]), ({"local_subjects": ("music",)}, []), ({"normalized_subjects": ("stem",)}, ["p1a"]),
        ({"statement_types": ("standard",)}, ["p1a", "p1b", "p2a"]), ({"statement_types": ("strand",), "include_groupings": True}, []), ({"normalized_statement_types": ("Standard",)}, ["p1a", "p1b", "p3x"]), ({"normalized_grades": ("1",), "local_subjects": ("Art",)}, []),
    ],
)
def test_facet_filters(spark, filters, want):
    nodes, _, policies = rows(spark)
    assert sorted(r.package_id + r.node_id for r in facets.evidence(nodes, policies).where(facets.matches(facets.Filters(**filters))).collect()) == want


def test_profiles_that_contradict_themselves():
    with pytest.raises(ValueError):
        facets.Profile("p", statement_types={"A": ["x"], "B": [" X "]}).row()
    with pytest.raises(ValueError):
        facets.Profile("p", grades=[("A", ["x"], ["1"]), ("X", [], ["2"])]).row()


def ids(page):
    return [(r.package_id, r.node_id) for r in page.hits.orderBy("place").collect()]


def test_text_pages(spark):
    nodes, packages, policies = rows(spark)
    every = pages.Request("Count the", filters=facets.Filters(include_groupings=True), limit=2)
    first = pages.search_page(nodes, packages, policies, every)
    assert ids(first) == [("p1", "a"), ("p1", "b")] and first.has_more
    assert [tuple(r)[:2] for r in first.warnings.collect()] == [("p3", pages.TEXT_OFF)]
    second = pages.search_page(nodes, packages, policies, every, first.next_cursor)
    assert ids(second) == [("p1", "g"), ("p2", "a")] and not second.has_more and second.next_cursor is None
    phrase = pages.Request("count the", match="phrase", limit=1)
    assert ids(pages.search_page(nodes, packages, policies, phrase)) == [("p1", "a")]
    assert ids(pages.search_page(nodes, packages, policies, pages.Request("apples plums", match="all"))) == []
    with pytest.raises(pages.CapabilityError, match=pages.TEXT_OFF):
        pages.search_page(nodes, packages, policies, pages.Request("count", package_id="p3"))
    with pytest.raises(LookupError):
        pages.search_page(nodes, packages, policies, pages.Request("count", package_id="p9"))
    for changed in (pages.Request("Count the", limit=2), pages.Request("Count the", filters=every.filters, limit=3), pages.Request("count the", filters=every.filters, limit=2), pages.Request("Count the", filters=every.filters, frameworks=("f",), limit=2)):
        with pytest.raises(ValueError):
            pages.search_page(nodes, packages, policies, changed, first.next_cursor)
    with pytest.raises(ValueError):  # another index
        pages.search_page(nodes, packages.withColumn("index_sha256", F.lit("new")), policies, every, first.next_cursor)
    with pytest.raises(LookupError):  # the cursor's hit has gone
        pages.search_page(nodes.where("node_id <> 'b'"), packages, policies, every, first.next_cursor)


def test_code_pages(spark):
    nodes, packages, policies = rows(spark)
    exact = pages.search_page(nodes.unionByName(nodes.where("node_id = 'c'").withColumn("code", F.lit("a1")).withColumn("node_id", F.lit("d"))), packages, policies, pages.Request("a.1", mode="code_exact"))
    assert ids(exact) == [("p1", "a"), ("p2", "a")] and [tuple(r)[:3] for r in exact.warnings.collect()] == [("p2", pages.CODE_PARTIAL, None), ("p3", pages.CODE_OFF, None)]
    twice = pages.search_page(nodes.unionByName(nodes.where("node_id = 'b'").withColumn("code", F.lit("a.1 "))), packages, policies, pages.Request("A.1", mode="code_exact", package_id="p1"))
    assert ids(twice) == [("p1", "a"), ("p1", "b")] and [tuple(r)[:3] for r in twice.warnings.collect()] == [("p1", pages.SEVERAL, "a"), ("p1", pages.SEVERAL, "b")]
    prefix = pages.search_page(nodes, packages, policies, pages.Request("A.1", mode="code_prefix"))
    assert ids(prefix) == [("p1", "a"), ("p1", "b")] and {r.code for r in prefix.warnings.collect()} == {pages.PREFIX_OFF, pages.CODE_OFF}
    assert "text, code_exact" in prefix.warnings.where(F.col("code") == pages.PREFIX_OFF).first().message
    for package, mode in (("p2", "code_prefix"), ("p3", "code_exact")):
        with pytest.raises(pages.CapabilityError):
            pages.search_page(nodes, packages, policies, pages.Request("A.1", mode=mode, package_id=package))


def test_requests_that_are_none():
    for wrong in ({"query": "a", "mode": "tag"}, {"query": "a", "limit": 0}, {"query": "!"}, {"query": "a", "match": "some"}):
        with pytest.raises(ValueError):
            pages.Request(**wrong)


def scope_of(spark, edges, types, coded, **kw):
    up = spark.createDataFrame(edges, "source string, target string")
    nodes = spark.createDataFrame(list(types.items()), "node_id string, statement_type string")
    return up, nodes, spark.createDataFrame([(c,) for c in coded], "node_id string"), spark.createDataFrame([("T",), ("U",)], "scope_type string")


def test_scopes_end_at_their_first_match(spark):
    """Branches are followed on their own: one ends at t2 and doesn't see t1 above it, the other reaches t1."""
    types = {"t1": "T", "t2": "T", "u": "U", "a": "x", "b": "x", "c": "x", "d": None}
    edges = [("u", "t1"), ("t1", "t2"), ("t2", "a"), ("t1", "b"), ("a", "c"), ("b", "c"), ("c", "d")]
    found = scopes.nearest_scopes(*scope_of(spark, edges, types, ["c", "d", "t2"]))
    assert sorted(map(tuple, found.select("node_id", "scope_type", "scope_id").collect())) == [("c", "T", "t1"), ("c", "T", "t2"), ("c", "U", "u"), ("d", "T", "t1"), ("d", "T", "t2"), ("d", "U", "u"), ("t2", "T", "t1"), ("t2", "U", "u")]


def test_scopes_that_are_missing_or_cyclic(spark):
    types = {"t": "T", "u": "U", "a": "x", "b": "x", "c": "x"}
    with pytest.raises(scopes.ScopeError) as lost:
        scopes.nearest_scopes(*scope_of(spark, [("t", "a")], types, ["a", "b"]))
    assert lost.value.witness == ["a", "b"]
    loop = scope_of(spark, [("t", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("u", "a")], types, ["b"])
    with pytest.raises(scopes.ScopeError) as ring:
        scopes.nearest_scopes(*loop)
    assert sorted(ring.value.witness) == ["a>b", "b>c", "c>a"]
    assert {tuple(r) for r in scopes.scope_problems(*loop).collect()} == {("scope-cycle", "b", "T"), ("scope-cycle", "b", "U")}
    beyond = scope_of(spark, [("a", "t"), ("t", "a"), ("u", "t")], types, ["a"])  # a cycle behind a match of T is not met for T
    assert {tuple(r) for r in scopes.scope_problems(*beyond).collect()} == {("scope-cycle", "a", "U")}
