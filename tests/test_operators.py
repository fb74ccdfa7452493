"""Operators on small hand-made inputs, against plain enumeration where that is possible."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from curriq.functions import text as T
from curriq.operators import catalog, evidence, paging, progressions, search, statistics, traversal, validation

DIAMOND = [("root", "a"), ("root", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "d")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"e{i:02d}", s, t, i, "buildsTowards", None) for i, (s, t) in enumerate(pairs)], "edge_id string, source string, target string, seo long, label string, status string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_tokens_agree(spark):
    texts = ["Straße, GRÖSSE!", "a  b-c_d", "", None, "ﬁne ½", "日本 語x1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.lexical_tokens("t").alias("native"), T.exact_tokens("t").alias("exact")).orderBy("i").collect()
    assert rows[0].native == rows[0].exact == ["strasse", "grösse"]
    assert rows[1].native == rows[1].exact == ["a", "b", "c", "d"] and rows[2].exact == [] and rows[3].exact is None
    assert rows[4].native == rows[4].exact == ["fine", "1", "2"] and rows[5].native == rows[5].exact
    assert T.facet_text("  A  b\tC ") == "a b c"


def test_plain_characters():
    """Each of them, and any next to another, is folded by lower case and ss as by NFKC and case folding."""
    import re
    import unicodedata

    plain = [c for c in map(chr, range(0x10000)) if re.match(f"[{T.PLAIN}]", c)]
    assert len(plain) > 400 and all(T.fold(c) == c.lower().replace("ß", "ss") for c in plain)
    assert not any(unicodedata.combining(c) or unicodedata.normalize("NFKC", f"a{c}e") != f"a{c}e" for c in plain)


def test_search_folds_both_sides(spark):
    texts = ["cafe\u0301 noir", "\ufb01sh", "ΟΔΟΣ", "İzmir", "Ｆｕｌｌ width", "plain fish"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = lambda hits: sorted(r.id for r in hits.collect())
    for query, want in (("café", [0]), ("FISH", [1, 5]), ("οδος", [2]), ("ΟΔΟΣ", [2]), ("i\u0307zmir", [3]), ("full", [4])):
        assert found(search.token_search(docs, "t", query, keep=("id",))) == want, query
        assert found(search.phrase_search(docs, "t", query, keep=("id",))) == want, query
    assert found(search.phrase_search(docs, "t", "CAFÉ noir", keep=("id",))) == [0] and found(search.phrase_search(docs, "t", "full WIDTH", keep=("id",))) == [4]
    tags = docs.select("id", F.array("t").alias("tags"))
    assert [r.id for r in search.tag_search(tags, "id", "tags", " ﬁsh").collect()] == [1]
    assert [r.id for r in search.code_search(docs, "t", "FISH", T.CodeRules(), keep=("id",)).collect()] == [1]
    assert [r.id for r in tags.where(catalog.member_filter("tags", ["οδοσ"])).collect()] == [2]


def test_postings_are_read_by_token(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the w{i % 7} x{i}") for i in range(200)] + [(900, None)], "id long, t string")
    index = search.write_postings(docs, "id", "t", str(tmp_path / "postings"), buckets=8)
    hits = search.posting_search(index, "id", "w3 THE", every=True, buckets=8)
    assert sorted(r.id for r in hits.collect()) == list(range(3, 200, 7)) and {r.matched_terms for r in hits.collect()} == {"the,w3"}
    assert "PartitionFilters: [isnotnull(bucket" in hits._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in hits._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        search.posting_search(index, "id", "...", buckets=8)


def test_cycle_witness_of_a_long_cycle(spark):
    n = 40
    ring = [(f"e{i}", f"n{i:02d}", f"n{(i + 1) % n:02d}") for i in range(n)] + [("t1", "n05", "t"), ("t2", "t", "u"), ("s", "s", "n00")]
    ids = traversal.cycle_witness(spark.createDataFrame(ring, "edge_id string, source string, target string"))
    assert sorted(ids) == sorted(f"e{i}" for i in range(n))
    ends = {e: (a, b) for e, a, b in ring}
    assert all(ends[a][1] == ends[b][0] for a, b in zip(ids, ids[1:] + ids[:1]))
    assert traversal.cycle_witness(spark.createDataFrame(ring[: n - 1], "edge_id string, source string, target string")) == []


def test_work_limit(spark, monkeypatch):
    monkeypatch.setattr(progressions, "MAX_EXAMINED", 10)
    rows = [("a", "s", "x")] + [(f"b{i:02d}", "x", f"y{i}") for i in range(30)] + [("c", "x", "s")]
    edges = spark.createDataFrame(rows, "edge_id string, source string, target string").withColumn("label", F.lit("buildsTowards"))
    _, taken, reason = progressions.traverse(edges, "s", max_depth=1)
    assert reason == "work_limit" and [r.edge_id for r in taken.collect()] == ["a"]
    monkeypatch.setattr(progressions, "MAX_EXAMINED", 100)
    _, taken, reason = progressions.traverse(edges, "s", max_depth=1)
    assert reason == "depth_limit" and sorted(r.edge_id for r in taken.collect()) == ["a", "c"]


def test_walk_tells_its_frontier(spark, monkeypatch):
    """root > a, b; a > c; b > c, d; c > d, in order of edge ids."""
    edges = edges_of(spark, DIAMOND)
    of = lambda found: {r.node_id: (r.depth, r.edges, r.pending, r.limited) for r in progressions.walk_frontier(found).collect()}
    counters = lambda found: tuple(progressions.walk_counters(found).first())
    whole = progressions.walk(edges, "root", max_depth=5)
    assert counters(whole) == (6, 0, 5, 5, 6, True, "") and all(v[2:] == (0, 0) for v in of(whole).values())
    bound = progressions.walk(edges, "root", max_depth=1)
    assert bound.reasons == ["depth_limit"] and of(bound) == {"root": (0, 2, 0, 0), "a": (1, 1, 0, 1), "b": (1, 2, 0, 2)}
    assert counters(bound) == (5, 3, 3, 3, 2, False, "depth_limit")
    ended = progressions.walk(edges, "root", max_depth=5, max_edges=3)
    assert ended.reasons == ["edge_limit"] and of(ended) == {"root": (0, 2, 0, 0), "a": (1, 1, 0, 0), "b": (1, 2, 2, 0), "c": (2, 1, 1, 0)}
    assert counters(ended) == (4, 0, 2, 4, 3, False, "edge_limit")
    monkeypatch.setattr(progressions, "MAX_EXAMINED", 4)
    spent = progressions.walk(edges, "root", max_depth=1)
    assert spent.reasons == ["depth_limit", "work_limit"] and of(spent)["b"] == (1, 2, 1, 1)
    assert of(progressions.walk(edges, "nowhere", max_depth=2)) == {"nowhere": (0, 0, 0, 0)}


def test_delivery_lines(spark):
    from curriq.operators import evidence, validation

    lines = lambda rows: spark.createDataFrame(rows, "line long, label string, edge_id string, value string")
    prefix = lines([(0, "hasChild", None, "p0"), (1, "supports", None, "p1")])
    tail = [("buildsTowards", "a", "va"), ("relatesTo", "b", "vb")]
    suffix = spark.createDataFrame(tail, "label string, edge_id string, value string")
    check = lambda d, p=prefix: sorted(r.code for r in validation.report(evidence.normalized_delivery(d, p, suffix)).collect())
    head = [(0, "hasChild", None, "p0"), (1, "supports", None, "p1")]
    assert check(lines(head + [(2, *tail[0]), (3, *tail[1])])) == []
    assert check(lines(head + [(2, *tail[1]), (3, *tail[0])])) == ["delivery-order"]
    assert check(lines(head + [(2, *tail[0]), (3, *tail[1]), (4, *tail[1])])) == ["delivery-surplus"]
    assert check(lines([(0, "hasChild", None, "x"), head[1], (2, *tail[0])])) == ["delivery-missing", "delivery-prefix"]
    assert check(lines([(0, *tail[0]), (1, *tail[1])]), prefix.where("false")) == []


def test_filters_are_checked():
    from curriq.operators import scopes

    known = {"grade": ["G1", "G2"]}
    assert scopes.normalized_filters({"grade": [" g2", "G1"]}, known) == {"grade": ["g1", "g2"]}
    for bad in ({"colour": ["x"]}, {"grade": ["g1", "G1 "]}, {"grade": [" "]}, {"grade": ["g9"]}):
        with pytest.raises(ValueError):
            scopes.normalized_filters(bad, known)


def test_codes(spark):
    rules = T.CodeRules((".", "-"))
    assert rules.normalize(" B4 .1,a ") == "b4.1a" and rules.normalize_prefix("B4.1.-") == "b4.1"
    codes = spark.createDataFrame([(c,) for c in ["B4.1", "b4.1.2", "B4.10", "B4.1-x", None]], "code string")
    hits = search.code_search(codes, "code", "b4.1", rules, keep=("code",)).collect()
    assert {r.code: r.score for r in hits} == {"B4.1": 1_000_000, "b4.1.2": 500_000, "B4.1-x": 500_000}
    assert [r.n for r in codes.select(rules.udf()("code").alias("n")).collect()] == ["b4.1", "b4.1.2", "b4.10", "b4.1-x", None]


def test_search(spark):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "quick the"), (3, None), (4, "")], "id int, t string")
    hits = search.token_search(docs, "t", "quick The cow", keep=("id",)).collect()
    assert {(r.id, r.score, r.matched_terms) for r in hits} == {(1, 666_666, "quick,the"), (2, 666_666, "quick,the")}
    assert [r.id for r in search.token_search(docs, "t", "fox quick", every=True, keep=("id",)).collect()] == [1]
    assert [r.id for r in search.phrase_search(docs, "t", "The quick", keep=("id",)).collect()] == [1]
    for bad in ("", "!!", "a\x01", "x" * 600, " ".join(f"w{i}" for i in range(40))):
        with pytest.raises(ValueError):
            search.query_terms(bad)
    assert tuple(search.index_statistics(docs, "id", "t").first()) == (3, 5, 3)
    tags = spark.createDataFrame([(1, ["Ring", "ring", "Ring"]), (2, None)], "id int, tags array<string>")
    assert sorted(r.tag for r in search.tag_search(tags, "id", "tags", "RING").collect()) == ["Ring", "ring"]


def test_facets(spark):
    rows = spark.createDataFrame([(1, " Basic  1 "), (2, "x"), (3, None)], "id int, g string")
    assert {r.id: r.normalized for r in search.facet_rows(rows, "g", {"basic 1": "1"}).collect()} == {1: "1", 2: None, 3: None}


def test_paging(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(10)], "a int, b int")
    seen, last = [], None
    while True:
        page = [tuple(r) for r in paging.keyset_page(rows, ["a", "b"], last, 4).collect()]
        if not page:
            break
        seen, last = seen + page, list(page[-1])
    assert seen == sorted((i % 3, i) for i in range(10))
    with pytest.raises(LookupError):
        paging.keyset_page(rows, ["a", "b"], [9, 9], 4)
    cursor = paging.encode_cursor("q", "i", ["é", 1])
    assert "=" not in cursor and paging.decode_cursor(cursor, "q", "i") == ["é", 1]
    for args in ((cursor, "x", "i"), (cursor[:-3], "q", "i"), ("!", "q", "i"), (cursor + "!!", "q", "i"), (cursor + "\n", "q", "i"), (" " + cursor, "q", "i"), (cursor + "==", "q", "i")):
        with pytest.raises(ValueError):
            paging.decode_cursor(*args)
    text, at, parts = "aé日😀" * 5, 0, []
    while at < len(text.encode()):
        part, at = paging.byte_window(text, at, 5)
        parts.append(part)
    assert "".join(parts) == text
    assert paging.within_budget(rows, [F.col("b")], F.col("b"), 10).count() == 5


def test_traverse_diamond(spark):
    edges = edges_of(spark, DIAMOND)
    found, reason = traversal.traverse(edges, "root")
    assert {r.node_id: r.depth for r in found.collect()} == {"root": 0, "a": 1, "b": 1, "c": 2, "d": 2} and reason is None
    found, reason = traversal.traverse(edges, "d", down=False, max_nodes=2)
    assert {r.node_id for r in found.collect()} == {"d", "b"} and reason == "max_nodes"
    paths, reason = traversal.root_paths(edges, "root", "d")
    assert [r.path for r in paths.orderBy("rank").collect()] == ["root>a>c>d", "root>b>c>d", "root>b>d"] and reason is None
    paths, reason = traversal.root_paths(edges, "root", "d", max_paths=2)
    assert paths.count() == 2 and reason == "max_paths"
    paths, reason = traversal.root_paths(edges, "root", "d", max_occurrences=9)
    assert paths.count() == 2 and reason == "max_path_node_occurrences"
    assert {(r.origin, r.path) for r in traversal.root_paths_of(edges, nodes_of(spark, ["c", "a"]), "root").collect()} == {("a", "root>a"), ("c", "root>a>c"), ("c", "root>b>c")}
    assert [r.edge_id for r in traversal.induced_edges(edges, nodes_of(spark, ["a", "c", "d"])).collect()] == ["e02", "e04"]


def test_neighbours(spark):
    edges, nodes = edges_of(spark, DIAMOND), nodes_of(spark, ["root", "a", "b", "c", "d"])
    assert [r.node_id for r in traversal.neighbours(edges, nodes, "d", "parents").collect()] == ["c", "b"]
    with pytest.raises(LookupError):
        traversal.neighbours(edges, nodes_of(spark, ["a"]), "root", "children")


def test_cycles(spark):
    edges = edges_of(spark, DIAMOND + [("d", "b"), ("d", "e")])
    assert {(r.source, r.target) for r in traversal.peel(edges).collect()} == {("b", "c"), ("b", "d"), ("c", "d"), ("d", "b"), ("d", "e")}
    witness = traversal.cycle_witness(edges)
    ends = {r.edge_id: (r.source, r.target) for r in edges.collect()}
    assert all(ends[a][1] == ends[b][0] for a, b in zip(witness, witness[1:] + witness[:1]))
    assert traversal.peel(edges_of(spark, DIAMOND)).count() == 0 and traversal.cycle_witness(edges_of(spark, DIAMOND)) == []
    with pytest.raises(ValueError):
        traversal.root_paths(edges, "root", "d")
    assert {r.node_id for r in traversal.reachable(edges_of(spark, [("a", "b"), ("c", "b")]), nodes_of(spark, ["a"]), symmetric=True).collect()} == {"a", "b", "c"}


def all_paths(pairs, s, t, most):
    out, stack = [], [(s, [s], [])]
    while stack:
        at, seen, ids = stack.pop()
        if at == t:
            out.append((len(ids), ids, ">".join(seen)))
            continue
        if len(ids) < most:
            stack += [(b, [*seen, b], [*ids, f"e{i:02d}"]) for i, (a, b) in enumerate(pairs) if a == at and b not in seen]
    return [p for *_, p in sorted(out)]


def test_progression_paths_against_enumeration(spark):
    r = random.Random(4)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(9), 2) if r.random() < 0.45})
    edges = edges_of(spark, pairs)
    got = [x.path for x in progressions.paths(edges, "n0", "n8", max_depth=5, max_paths=6).orderBy("rank").collect()]
    assert got == all_paths(pairs, "n0", "n8", 5)[:6]
    reach = {x.node_id: (x.lengths, x.shortest, x.longest) for x in progressions.target_reach(edges, "n8", 5).collect()}
    lengths = {p.count(">") for p in all_paths(pairs, "n0", "n8", 5)}
    assert reach["n0"] == (sum(1 << n for n in lengths), min(lengths), max(lengths))
    with pytest.raises(ValueError):
        progressions.paths(edges, "n0", "n0")


def test_path_search_reasons(spark):
    r = random.Random(5)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(7), 2) if r.random() < 0.6} | {("n0", "n1"), ("n0", "n2"), ("n1", "n2"), ("n2", "n6"), ("n6", "z")})
    edges = edges_of(spark, pairs)
    every = all_paths(pairs, "n0", "n6", 9)
    longest = max(p.count(">") for p in every)
    for depth, most in [(longest, len(every)), (longest, 1), (longest - 1, len(every)), (2, 1)]:
        within = [p for p in every if p.count(">") <= depth]
        found, reasons = progressions.path_search(edges, "n0", "n6", depth, most)
        assert [x.path for x in found.orderBy("rank").collect()] == within[:most]
        assert reasons == ["depth_limit"] * (longest > depth) + ["path_limit"] * (len(within) > most)
    assert progressions.path_search(edges, "z", "n0", 3)[1] == []


def test_progression_traversal_bounds(spark):
    edges = edges_of(spark, DIAMOND)
    nodes, taken, reason = progressions.traverse(edges, "root", max_depth=1)
    assert {r.node_id for r in nodes.collect()} == {"root", "a", "b"} and reason == "depth_limit"
    nodes, taken, reason = progressions.traverse(edges, "root", max_depth=5, max_edges=3)
    assert [r.edge_id for r in taken.orderBy("edge_id").collect()] == ["e00", "e01", "e02"] and reason == "edge_limit"
    nodes, taken, reason = progressions.traverse(edges, "root", max_depth=5, max_nodes=3)
    assert nodes.count() == 3 and reason == "node_limit"
    nodes, taken, reason = progressions.traverse(edges, "d", max_depth=5, down=False)
    assert taken.count() == 6 and reason is None


def test_discovery_and_direct(spark):
    edges = edges_of(spark, DIAMOND)
    nodes = nodes_of(spark, ["root", "a", "b", "c", "d"])
    hit = F.col("node_id").isin("c", "d")
    assert [r.edge_id for r in progressions.discover(edges, nodes, hit, "both").collect()] == ["e04"]
    assert [r.position for r in progressions.discover(edges, nodes, hit, "target", position=3, limit=2).collect()] == [3, 4]
    assert {r.connection for r in progressions.discover(edges, nodes, hit).collect()} == {"both", "target"}
    assert [r.kind for r in progressions.direct(edges, "c").collect()] == ["incoming", "incoming", "outgoing"]


def test_lift_and_lower(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x")], "id int, p string, q string")
    shared, lifted = progressions.lift_constants(rows, ["p", "q"])
    assert tuple(shared.first()) == ("a", None) and {r.p for r in lifted.collect()} == {None}
    assert statistics.set_difference(progressions.lower_constants(lifted, shared, ["p", "q"]), rows).count() == 0
    assert progressions.lift_constants(rows.limit(0), ["p"])[1].count() == 0


def test_statistics(spark):
    rows = spark.createDataFrame([("b", ["x", "y"]), (None, []), ("a", None)], "v string, g array<string>")
    assert [tuple(r) for r in statistics.value_counts(rows, "v").collect()] == [("a", 1), ("b", 1), (None, 1)]
    assert [tuple(r) for r in statistics.element_counts(rows, "g").collect()] == [("x", 1), ("y", 1), (None, 2)]
    edges = edges_of(spark, DIAMOND + [("c", "d")])
    dist = lambda d: [tuple(r) for r in statistics.parent_distribution(edges, nodes_of(spark, ["root", "c", "d"]), d).collect()]
    assert dist(False) == [(0, 1), (2, 1), (3, 1)] and dist(True) == [(0, 1), (2, 2)]
    import hashlib

    d = statistics.digest(spark.createDataFrame([("b",), ("a",)], "v string"), "v").first()
    assert d.sha256 == hashlib.sha256(b"a\nb\n").hexdigest()


def test_validation(spark):
    nodes = spark.createDataFrame([("r", "framework", 1), ("a", "standard", 2), ("a", "standard", 3), ("x", None, 4), ("k", "component", 5)], "node_id string, kind string, seo int")
    edges = spark.createDataFrame([("e1", "hasChild", "r", "a", 1, None), ("e2", "hasChild", "r", "a", 2, "odd"), ("e2", "other", "a", "a", 3, None), ("e3", "hasChild", "r", "gone", 4, None)], "edge_id string, label string, source string, target string, seo int, status string")
    found = validation.report([*validation.node_identity(nodes), *validation.edge_identity(edges, nodes), validation.edge_status(edges), validation.orphan_components(nodes, edges)])
    codes = sorted(r.code for r in found.collect())
    assert codes == ["component-orphan", "edge-duplicate", "edge-id-duplicate", "edge-label", "edge-self-loop", "edge-status", "node-duplicate", "node-label", "target-unresolved"]
    assert tuple(validation.status(found).first()) == ("failed", 9) and validation.status(found.limit(0)).first().status == "passed"
    assert sorted(r.code for r in validation.report(validation.hierarchy(edges_of(spark, DIAMOND + [("d", "b")]), nodes_of(spark, ["root", "d", "z"]), "root")).collect()).count("hierarchy-unreachable") == 1
    items = spark.createDataFrame([("a", "T", "A.1", ["1"], 1), ("b", "T", "bad", ["1", "1"], 2), ("c", None, None, [], 3), ("d", "U", "A.1", ["9"], 4)], "node_id string, statement_type string, statement_code string, grade_level array<string>, seo int")
    assert sorted(r.code for r in validation.report(validation.statement_codes(items, r"[A-Z]\.\d", F.col("statement_type") == "T")).collect()) == ["code-duplicate", "code-not-permitted", "code-pattern"]
    assert sorted(r.code for r in validation.report(validation.grade_levels(items, ["1"])).collect()) == ["grades-empty", "grades-repeated", "grades-unknown"]


def test_parents(spark):
    items = spark.createDataFrame([("r", "root"), ("g", "group"), ("h", "group"), ("s", "item"), ("t", "item")], "node_id string, statement_type string")
    edges = spark.createDataFrame([("e1", "g", "s", None), ("e2", "h", "s", None), ("e3", "r", "g", None), ("e4", "g", "t", "unresolvedRootFallback")], "edge_id string, source string, target string, status string")
    policies = spark.createDataFrame([("item", "group", 1, 1), ("group", "root", 1, 1)], "statement_type string, parent_type string, least int, most int")
    found = {(r.code, r.record_id) for r in validation.report(validation.parent_policy(edges, items, policies, most=1, root="r")).collect()}
    assert found == {("parent-too-many", "s"), ("parent-multiple", "s"), ("parent-too-few", "h"), ("parent-fallback", "e4")}


CLAIM = "pair_id string, first_id string, second_id string, decision string, direction string, source string, target string, candidate struct<pair_id:string,first_id:string,second_id:string,admissible:array<struct<decision:string,direction:string>>>, producer struct<pair_id:string,first_id:string,second_id:string>, content string"


def claim(pair_id, first, second, decision, direction=None, source=None, target=None, **other):
    admissible = [("buildsTowards", "first_to_second"), ("buildsTowards", "second_to_first"), ("relatesTo", None), ("no_relation", None), ("needs_review", None)]
    candidate, producer = other.get("candidate", (pair_id, first, second, admissible)), other.get("producer", (pair_id, first, second))
    return (pair_id, first, second, decision, direction, source, target, candidate, producer, other.get("content", pair_id))


def test_claims_that_are_in_order(spark):
    """Every kind of claim that may stand, ends in any order of ids."""
    claims = spark.createDataFrame([claim("1", "b", "a", "buildsTowards", "first_to_second", "b", "a"), claim("2", "c", "a", "buildsTowards", "second_to_first", "a", "c"), claim("3", "c", "b", "relatesTo", None, "b", "c"), claim("4", "d", "a", "no_relation"), claim("5", "d", "b", "needs_review")], CLAIM)
    assert validation.report(evidence.claim_rules(claims)).collect() == []
    assert [(r.source, r.target) for r in validation.claim_endpoints(claims).orderBy("pair_id").collect()] == [("b", "a"), ("a", "c"), ("b", "c"), (None, None), (None, None)]
    assert {r.decision: r.n for r in validation.decision_counts(claims).collect()} == {"buildsTowards": 2, "relatesTo": 1, "no_relation": 1, "needs_review": 1}
    declared = spark.createDataFrame([("buildsTowards", 2), ("relatesTo", 1), ("no_relation", 1), ("needs_review", 1), ("total_claims", 5), ("total_needs_review", 1)], "name string, n long")
    assert validation.report(evidence.review_rules(claims, claims.where("pair_id = '5'"), declared)).collect() == []
    wrong = evidence.review_rules(claims, claims.where("pair_id = '4'"), declared.where("name <> 'relatesTo'"))
    assert sorted((r.code, r.record_id) for r in validation.report(wrong).collect()) == [("lp_final_counts_mismatch", "relatesTo"), ("lp_unresolved_mismatch", "4"), ("lp_unresolved_mismatch", "5")]


def test_claims_that_are_not(spark):
    rows = [
        claim("direction", "a", "b", "relatesTo", "first_to_second", "a", "b"), claim("none", "a", "c", "buildsTowards", None, "a", "c"), claim("self", "d", "d", "no_relation"), claim("admitted", "a", "e", "needs_review", candidate=("admitted", "a", "e", [("relatesTo", None)])),
        claim("turned", "b", "a", "buildsTowards", "second_to_first", "b", "a"), claim("ends", "b", "c", "no_relation", None, "b", "c"), claim("trace", "b", "d", "no_relation", producer=("trace", "d", "b")), claim("old", "b", "e", "noRelationship"), claim("old", "c", "e", "no_relation"),
    ]
    found = sorted((r.code, r.record_id) for r in validation.report(evidence.claim_rules(spark.createDataFrame(rows, CLAIM))).collect())
    assert found == [
        ("claim-decision", "old"), ("lp_claim_endpoint_mismatch", "ends"), ("lp_claim_endpoint_mismatch", "turned"), ("lp_claim_identity_mismatch", "admitted"), ("lp_claim_identity_mismatch", "direction"), ("lp_claim_identity_mismatch", "none"), ("lp_claim_identity_mismatch", "old"), ("lp_claim_identity_mismatch", "self"),
        ("lp_final_pair_conflict", "direction"), ("lp_final_pair_conflict", "old"), ("lp_judgment_direction", "direction"), ("lp_judgment_direction", "none"), ("lp_trace_identity_mismatch", "trace"),
    ]


def test_repeated_keys(spark):
    """Every row but the first of its key, wholly equal rows too; a key of nulls isn't one."""
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "p"), (None, 2, "q")], "k string, seo long, id string")
    assert sorted((r.record_id, r.seo) for r in validation.duplicates(rows, ["k"], "twice", "id").collect()) == [("x", 3), ("y", 1)]
    assert sorted(r.record_id for r in validation.duplicates(rows, ["id"], "twice", "id").collect()) == ["y"]


def test_credit_of_generated_edges(spark):
    template = "Made here. Source: {source_attribution_statement}. Not endorsed."
    roots = spark.createDataFrame([("p", "Root", "board", "ministry", "open", "by the board", "u1")], "package_id string, name string, author string, provider string, license string, attribution_statement string, case_identifier_uuid string")
    edge = ("e", "p", "relatesTo", "s1", "t1", "model", "maker", "open", "Made here. Source: by the board. Not endorsed.")
    source = ("by the board", "board", "u1", "open", "ministry", "Root")
    record = ("e", "K", "lc:curriculum:K:relationship:relatesTo:s1:t1", "maker", template, source)

    def told(edge=edge, record=record):
        edges = spark.createDataFrame([edge], "edge_id string, package_id string, label string, source string, target string, author string, provider string, license string, attribution_statement string")
        records = spark.createDataFrame([record], "edge_id string, doc_key string, identity_key string, approved_by string, template string, source struct<attribution_statement:string,author:string,case_identifier_uuid:string,license:string,provider:string,title:string>")
        return [r.message for r in evidence.credit(edges, roots, records, "model", "maker", template).collect()]

    assert told() == []
    assert told(edge=(*edge[:5], "board", *edge[6:])) == ["author"] and told(edge=(*edge[:6], "x", *edge[7:])) == ["provider"] and told(edge=(*edge[:8], "by the board")) == ["statement"]
    assert told(record=(*record[:2], "other", *record[3:])) == ["identity key"] and told(record=(*record[:5], (*source[:5], "Rot"))) == ["source title"] and told(record=(*record[:3], "x", "y", source)) == ["approval, template"]
    assert told(record=("other", *record[1:])) != []


def test_catalog(spark):
    rows = spark.createDataFrame([("f", "s1", "p1", "t", True, "passed"), ("f", "s2", "p2", "t", False, "passed"), ("g", "s3", "p3", "t", True, "failed"), ("g", "s3", "p3", "t", True, "failed")], "framework_id string, snapshot_id string, package_id string, graph_type string, is_current boolean, status string")
    assert catalog.select_snapshot(rows, "f") == "s1" and catalog.select_snapshot(rows, "f", "s2") == "s2"
    with pytest.raises(LookupError):
        catalog.select_snapshot(rows, "nobody")
    built = catalog.build_catalog(rows).collect()
    assert [(r.framework_id, [s.snapshot_id for s in r.snapshots]) for r in built] == [("f", ["s1", "s2"])]
    assert {tuple(r) for r in catalog.catalog_conflicts(rows).collect()} == {("package-twice", "p3"), ("route-twice", "s3")}
    assert [r.snapshot_id for r in catalog.text_filter(rows, ["framework_id", "snapshot_id"], " F  s2").collect()] == ["s2"]
