"""Rules in order, canonical JSON and slim records against Python's writer, and the delivery file."""

import hashlib
import json
import random

import pytest

from curriq.operators import lp_graph, package_rules, validation
from curriq.sources import slim, wire


def test_eighteen_pairs():
    assert len(package_rules.PAIRS) == 18 == len({p[0] for p in package_rules.PAIRS})


def test_a_failed_gate_hides_what_rests_on_it(spark):
    packages = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "package_id string")
    rows = [("p", "late", "1"), ("p", "mid-b", "2"), ("p", "mid-a", "9"), ("p", "mid-a", "3"), ("q", "late", "4"), ("q", "odd", "5"), ("r", "odd", "6")]
    findings = spark.createDataFrame(rows, "package_id string, code string, record_id string")
    verdict, standing = package_rules.settled_rules(packages, findings, [["first"], ["mid-a", "mid-b"], ["late"]])
    assert {r.package_id: (r.gate, r.code, r.record_id) for r in verdict.collect()} == {"p": (1, "mid-a", "3"), "q": (2, "late", "4"), "r": (3, "odd", "6"), "s": (None, None, None)}
    assert sorted(map(tuple, standing.collect())) == sorted([rows[1], rows[2], rows[3], rows[4], rows[6]])


def odd_values(rng, depth=3):
    kind = rng.randrange(8 if depth else 6)
    if kind == 0:
        return rng.choice([0, -1, 10**30, 2**63, 12])
    if kind == 1:
        return rng.choice([0.1, 1.0, -0.0, 1e22, 1.5e-7, 123456789.125])
    if kind in (2, 3):
        return rng.choice(["", "é", "\u2028", '"\\/', "\x00\x1f\x7f", "日本", "😀", "a\nb\t", "ß\u0301"])
    if kind < 6:
        return rng.choice([True, False, None])
    if kind == 6:
        return [odd_values(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["b", "a", "é", "", "z", "A", "\uffff", "😀"]): odd_values(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_slim_records_hash_what_python_writes(spark):
    rng = random.Random(0)
    records = [{"candidate_source_refs": odd_values(rng), "id": i, "v": odd_values(rng), "é": odd_values(rng)} for i in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(r, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, r in enumerate(records)], "i int, t string")
    got = {r.i: r.slim for r in slim.slim_records(rows, "i", "t", slim.ENTITY_REMOVED, slim.ENTITY_HASH).collect()}
    plain = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    for i, r in enumerate(records):
        digest = hashlib.sha256(plain(r).encode()).hexdigest()
        assert got[i] == plain({k: v for k, v in r.items() if k != "candidate_source_refs"} | {"original_item_sha256": f"sha256:{digest}"})


def test_nested_fields_go():
    record = {"claim": {"candidate": {"admissible_decisions": [1], "evidence": {}, "pair_id": "p"}, "provenance": {"producer_judgment": {}, "x": 1}}, "k": 2}
    out = json.loads(slim.slim_record(json.dumps(record), slim.LP_REMOVED, slim.LP_HASH))
    assert out["claim"] == {"candidate": {"pair_id": "p"}, "provenance": {"x": 1}} and out["original_entry_sha256"].startswith("sha256:")
    for wrong in ('{"claim": 1}', "{}", '{"a": 1, "a": 2}', "[]"):
        with pytest.raises(ValueError):
            slim.slim_record(wrong, slim.LP_REMOVED, slim.LP_HASH)


def test_provenance_documents(spark, tmp_path):
    document = {"framework": {"x": 1}, "items": {f"u{i}": {"candidate_source_refs": [i], "n": i} for i in range(2500)}}
    (tmp_path / "as.json").write_text(json.dumps(document))
    rows = slim.slim_entities(spark, str(tmp_path / "as.json")).collect()
    assert len(rows) == 2500 and json.loads(next(r.slim for r in rows if r.key == "u7"))["n"] == 7
    (tmp_path / "lc.json").write_text(json.dumps({"doc_key": "K", "pdf_name": "f", "learning_components": {"n1": {"b": 1, "a": 2}}}))
    (row,) = slim.slim_components(spark, str(tmp_path / "lc.json")).collect()
    assert row.slim == '{"a":2,"b":1,"original_component_sha256":"sha256:' + hashlib.sha256(b'{"a":2,"b":1}').hexdigest() + '"}'
    (tmp_path / "bad.json").write_text(json.dumps({"doc_key": "K", "learning_components": {"n1": {}}}))
    with pytest.raises(Exception, match="pdf_name"):
        slim.slim_components(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("end", ["", "\n"])
def test_the_delivery_file(spark, tmp_path, end):
    item = ["StandardsFrameworkItem"]
    fields = {"relationship_type": None, "source_entity": item[0], "source_entity_key": "caseIdentifierUUID", "source_entity_value": "u1", "target_entity": item[0], "target_entity_key": "caseIdentifierUUID", "target_entity_value": "u2"}
    rows = [(f"e{i:03d}", label, f"s{i}", f"t{i}", item, item, *(label if c == "relationship_type" else v for c, v in fields.items()), 'by "é"\x1f/' if i % 2 else None) for i, label in enumerate(["relatesTo", "buildsTowards"] * 40)]
    edges = spark.createDataFrame(rows, "edge_id string, label string, source string, target string, source_labels array<string>, target_labels array<string>, " + ", ".join(f"{c} string" for c in fields) + ", author string").repartition(7)
    prefix = '{"identifier": "h1", "label": "hasChild", "properties": {}, "source_identifier": "a", "source_labels": [], "target_identifier": "b", "target_labels": [], "type": "relationship"}' + end
    (tmp_path / "prefix.jsonl").write_text(prefix)
    start = slim.write_delivery_file(str(tmp_path / "prefix.jsonl"), edges, str(tmp_path / "whole.jsonl"))
    data = (tmp_path / "whole.jsonl").read_bytes()
    assert data[: len(prefix)] == prefix.encode() and start == len(prefix) + (not end)
    lines = data[start:].decode().splitlines()
    assert len(lines) == 80 and data.endswith(b"\n")
    parsed = [json.loads(x) for x in lines]
    assert [(p["label"], p["identifier"]) for p in parsed] == sorted((r[1], r[0]) for r in rows)
    assert all(x == json.dumps(p, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x, p in zip(lines, parsed, strict=True))
    back, findings = wire.read_relationships(spark, [str(tmp_path / "whole.jsonl")])
    assert findings.count() == 0 and back.count() == 81
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["prefix.jsonl", "whole.jsonl"]
    with pytest.raises(FileExistsError):
        slim.write_delivery_file(str(tmp_path / "prefix.jsonl"), edges, str(tmp_path / "whole.jsonl"))


def test_statement_types(spark):
    items = spark.createDataFrame([("a", None, None, 1), ("b", " T", "N", 2), ("c", "X", None, 3), ("d", "G", None, 4), ("e", "T", "other", 5), ("f", "T", "N", 6), ("g", "U", None, 7)], "node_id string, statement_type string, normalized_type string, seo int")
    policies = spark.createDataFrame([("T", "N", True), ("G", None, False), ("U", None, True), (" T", "N", True)], "statement_type string, normalized_type string, is_graph_node boolean")
    found = sorted((r.code, r.record_id) for r in validation.report(validation.statement_types(items, policies)).collect())
    assert found == [("statement-type-missing", "a"), ("statement-type-no-node", "d"), ("statement-type-normalized", "e"), ("statement-type-space", "b"), ("statement-type-unknown", "c")]


def test_parents_by_the_rule_that_holds(spark):
    items = spark.createDataFrame([("top", "ROOT"), ("two", "ROOT"), ("lost", "ROOT"), ("low", "LOW"), ("odd", "LOW"), ("back", "LOW"), ("both", "LOW"), ("free", None)], "node_id string, statement_type string")
    rows = [("1", "root", "top", None), ("2", "root", "two", None), ("3", "top", "two", None), ("4", "top", "low", None), ("5", "low", "odd", None), ("6", "root", "back", "unresolvedRootFallback"), ("7", "root", "both", "unresolvedRootFallback"), ("8", "top", "both", None), ("9", "low", "free", None), ("10", "top", "low", "strange")]
    edges = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "edge_id string, source string, target string, status string, seo int")
    policies = spark.createDataFrame([("LOW", "ROOT", 1, 1)], "statement_type string, parent_type string, least int, most int")
    found = sorted((r.code, r.record_id) for r in validation.report(validation.parent_dispatch(edges, items, policies, ["ROOT"], "root")).collect())
    assert found == [("parent-fallback", "7"), ("parent-too-few", "odd"), ("parent-type", "odd"), ("relationship_status_not_applicable", "10"), ("root-type-parent", "lost"), ("root-type-parent", "two")]


def test_cycles_of_packages_stay_apart(spark):
    item = ["StandardsFrameworkItem"]
    row = lambda p, e, n, label, s, t, **kw: (p, e, n, label, kw.get("kind", label), kw.get("own", e), s, t, item, item, item[0], item[0], "caseIdentifierUUID", "caseIdentifierUUID", f"u{s}", f"u{t}", None, None)
    edges = spark.createDataFrame(
        [row("p", "1", 1, "buildsTowards", "a", "b"), row("p", "2", 2, "buildsTowards", "b", "a"), row("q", "3", 1, "buildsTowards", "a", "b"), row("q", "4", 2, "relatesTo", "b", "c"), row("q", "5", 3, "relatesTo", "c", "c"), row("q", "5", 4, "relatesTo", "a", "c"), row("q", "6", 5, "relatesTo", "a", "nobody", own="7")],
        "package_id string, edge_id string, seo long, label string, relationship_type string, property_identifier string, source string, target string, source_labels array<string>, target_labels array<string>, source_entity string, target_entity string, source_entity_key string, target_entity_key string, source_entity_value string, target_entity_value string, status string, confidence double",
    )
    standards = spark.createDataFrame([(p, n, f"u{n}") for p in "pq" for n in "abc"], "package_id string, node_id string, case_identifier_uuid string")
    packages = spark.createDataFrame([("p", True, False, True, 2, 0), ("q", True, False, True, 1, 4), ("r", False, True, False, 0, 0)], "package_id string, declared boolean, has_artifacts boolean, evidence_valid boolean, builds_towards int, relates_to int")
    found = sorted(map(tuple, lp_graph.graph_rules(edges, standards, packages).collect()), key=repr)
    assert found == sorted([("p", "lp_builds_towards_cycle", None), ("p", "lp_pair_conflict", "2"), ("q", "lp_endpoint_mismatch", "6"), ("q", "lp_identity_mismatch", "6"), ("q", "lp_pair_conflict", "5"), ("q", "lp_relates_to_order", "5"), ("q", "lp_self_edge", "5"), ("r", "lp_undeclared", None)], key=repr)


def test_timestamps_with_and_without_an_offset(spark):
    texts = {"a": "2024-02-29T12:00:00Z", "b": "2024-02-29 12:00+02:00", "c": "2024-02-29T12:00:00.123-0530", "d": None, "e": "2024-02-29T12:00:00", "f": "2024-02-29 12:00", "g": "2023-02-29T12:00:00Z", "h": "2024-02-29", "i": "noon", "j": "2024-02-29T25:00:00Z", "k": "2024-02-29T12:00:00Zx"}
    rows = spark.createDataFrame(list(texts.items()), "id string, at string")
    found = sorted((r.record_id, r.code) for r in validation.report(validation.aware_timestamps(rows, "id", "at")).collect())
    assert found == [("e", "timestamp-naive"), ("f", "timestamp-naive"), ("g", "timestamp-invalid"), ("h", "timestamp-invalid"), ("i", "timestamp-invalid"), ("j", "timestamp-invalid"), ("k", "timestamp-invalid")]
