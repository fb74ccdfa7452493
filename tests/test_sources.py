import hashlib
import json

import pytest

from curriq.sources import packages, wire
from curriq.streaming.intake import take_batch, watch_nodes


def node(i, label="StandardsFrameworkItem", **p):
    return json.dumps({"identifier": f"n{i}", "labels": [label], "type": "node", "properties": p})


def edge(i, label, s, t, **p):
    return json.dumps({"identifier": f"e{i}", "label": label, "source_identifier": s, "source_labels": ["StandardsFrameworkItem"], "target_identifier": t, "target_labels": ["StandardsFrameworkItem"], "type": "relationship", "properties": p})


NODES = [
    node(0, "StandardsFramework", name="F", isCurrent="true"), node(1, gradeLevel='["1","2"]', statementCode="A.1", caseIdentifierUUID="u1"), node(2, "LearningComponent", description="d", tags='["x"]'),
    node(3, gradeLevel="[1]"), node(4, isCurrent="yes"), '{"identifier": "a", "identifier": "b"}', node(5, "Other"), "not json", node(6, "LearningComponent"), node(7, caseIdentifierUUID="u7"),
]


def test_nodes(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text("\n".join(NODES) + "\n")
    nodes, findings = wire.read_nodes(spark, [str(tmp_path / "n.jsonl")])
    got = {r.node_id: r for r in nodes.collect()}
    assert {k: (v.seo, v.kind) for k, v in got.items()} == {"n0": (1, "framework"), "n1": (2, "standard"), "n2": (3, "component"), "n7": (10, "standard")}
    assert got["n0"].is_current is True and got["n1"].grade_level == ["1", "2"] and got["n2"].tags == ["x"]
    assert sorted(r.seo for r in findings.collect()) == [4, 5, 6, 7, 8, 9]
    root, items, components = wire.split_delivery(nodes)
    assert (root.count(), items.count(), components.count()) == (1, 2, 1)


def test_relationships(spark, tmp_path):
    ends = {"sourceEntity": "StandardsFrameworkItem", "targetEntity": "StandardsFrameworkItem", "sourceEntityKey": "caseIdentifierUUID", "targetEntityKey": "caseIdentifierUUID", "sourceEntityValue": "u1", "targetEntityValue": "u7"}
    lines = [
        edge(0, "supports", "a", "b", supportConfidence="0.5"), edge(1, "supports", "a", "b", supportConfidence="1.5"), edge(2, "supports", "a", "b", supportConfidence="nan"),
        edge(3, "buildsTowards", "a", "b", relationshipType="buildsTowards", identifier="e3", **ends), edge(4, "buildsTowards", "a", "b", relationshipType="relatesTo", identifier="e4", **ends), edge(5, "relatesTo", "a", "b", relationshipType="relatesTo", identifier="e5"),
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    (tmp_path / "n.jsonl").write_text("\n".join(NODES))
    edges, findings = wire.read_relationships(spark, [str(tmp_path / "e.jsonl")])
    assert {r.edge_id: r.confidence for r in edges.collect()} == {"e0": 0.5, "e3": None}
    assert sorted(r.seo for r in findings.collect()) == [2, 3, 5, 6]
    nodes, _ = wire.read_nodes(spark, [str(tmp_path / "n.jsonl")])
    resolved = wire.resolve_by_case(edges.where("label = 'buildsTowards'"), nodes).collect()
    assert [(r.source, r.target) for r in resolved] == [("n1", "n7")]


def test_strict_json():
    assert wire.strict_object('{"a": 1.5}') == {"a": 1.5}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', "[1]", "{"):
        with pytest.raises(ValueError):
            wire.strict_object(bad)


def test_packages(spark, tmp_path):
    from curriq.operators import validation

    nodes = spark.createDataFrame([("a", 1)], "node_id string, seo int")
    edges = spark.createDataFrame([("e", "hasChild", "a", "b")], "edge_id string, label string, source string, target string")
    sid = packages.snapshot_id("fw", "2019", "sha256:" + "ab" * 32)
    assert sid == "fw@2019+abababababab" and packages.package_id(sid, "t", 2) == f"{sid}--t--p2"
    folder = tmp_path / "root" / "fw" / sid
    manifest = packages.build_package(nodes, edges, str(folder), {"frameworkId": "fw", "graphPackageId": "p", "graphType": "t", "packageRevision": 1, "framework": {"isCurrent": True, "languages": ["en"]}})
    with pytest.raises(FileExistsError):
        packages.publish(spark, str(tmp_path), str(folder))
    found = packages.discover(tmp_path / "root")
    table = packages.manifest_table(spark, found)
    assert table.first().status == "pending"
    declared = packages.declared_files(table)
    assert packages.artifact_set_digest(declared.withColumnRenamed("sha256", "checksum")).first().artifact_set == manifest["artifactSetSha256"]
    observed = packages.observed_files(spark, str(folder))
    sized = declared.join(observed.select("path", "size"), "path", "left")
    assert validation.declared_against_observed(sized, observed).count() == 0
    _, nodes_back, edges_back, findings = packages.load_package(spark, str(folder))
    assert nodes_back.count() == edges_back.count() == 1 and [r.code for r in findings.collect()] == ["target-unresolved"]
    part = next(k for k in manifest["checksums"] if k.startswith("nodes/"))
    assert packages.read_artifact(spark, str(folder), manifest | {"artifacts": {"nodes": part}}, "nodes")[:4] == b"PAR1"
    with pytest.raises(LookupError):
        packages.read_artifact(spark, str(folder), manifest, "nothing")
    with pytest.raises(ValueError):
        packages.read_artifact(spark, str(folder), manifest | {"checksums": {part: "sha256:0"}}, part)
    with pytest.raises(ValueError):
        packages.read_artifact(spark, str(folder), manifest, part, most=4)
    extra = folder / "extra.bin"
    extra.write_bytes(b"x")
    assert [r.code for r in validation.declared_against_observed(sized, packages.observed_files(spark, str(folder))).collect()] == ["file-undeclared"]
    _, before = packages.read_manifest(str(folder))
    assert packages.change_status(str(folder), before, "passed")["validation"]["status"] == "passed"
    with pytest.raises(RuntimeError):
        packages.change_status(str(folder), before, "failed")


def test_profile(tmp_path):
    at = tmp_path / "some-profile" / "2.0"
    at.mkdir(parents=True)
    (at / "profile.json").write_text('{"profileId": "some-profile", "profileVersion": "2.0", "x": 1}')
    assert packages.load_profile(tmp_path, "some-profile", "2.0")["x"] == 1
    for name, version in (("../some-profile", "2.0"), ("some-profile", "latest")):
        with pytest.raises(ValueError):
            packages.load_profile(tmp_path, name, version)
    (at / "profile.json").write_text('{"profileId": "other", "profileVersion": "2.0"}')
    with pytest.raises(ValueError):
        packages.load_profile(tmp_path, "some-profile", "2.0")


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", i) for i in range(200)], "id string, v int")
    packages.write_shards(rows, "id", str(tmp_path / "s"))
    assert packages.read_shard(spark, str(tmp_path / "s"), "id", "r17").first().v == 17
    back = spark.read.parquet(str(tmp_path / "s"))
    assert all(hashlib.sha256(r.id.encode()).digest()[0] % 64 == r.bucket for r in back.collect())
    assert packages.slim(rows, ["v"]).columns == ["id", "original_sha256"]


def test_delivery(spark, tmp_path):
    prefix = spark.createDataFrame([(2, "second"), (1, "first")], "line int, value string")
    lp = spark.createDataFrame([("relatesTo", "b"), ("buildsTowards", "z"), ("buildsTowards", "a")], "label string, edge_id string")
    packages.write_delivery(prefix, lp, str(tmp_path / "d"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*"))).splitlines()
    assert text[:2] == ["first", "second"] and [json.loads(x)["edge_id"] for x in text[2:]] == ["a", "z", "b"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"n{k}.jsonl").write_text("\n".join(NODES))
        watch_nodes(spark, str(tmp_path / "in"), str(tmp_path / "nodes"), str(tmp_path / "findings"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 8 and spark.read.parquet(str(tmp_path / "findings")).count() == 12


def test_a_replayed_batch_counts_once(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text("\n".join(NODES))
    batch = spark.createDataFrame([(str(tmp_path / "n.jsonl"),)], "path string")
    for number in (0, 0, 1):
        take_batch(batch, number, str(tmp_path / "nodes"), str(tmp_path / "findings"))
    assert spark.read.parquet(str(tmp_path / "nodes")).groupBy("batch").count().orderBy("batch").collect() == [(0, 4), (1, 4)]
