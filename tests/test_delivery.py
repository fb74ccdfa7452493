"""Deliveries from end to end: splits and line numbers, integrity, decoding, status."""

import hashlib
import json
import os
import random

import pytest

from curriq.sources import delivery, packages, wire
from test_sources import edge, node

ENDS = {"sourceEntity": "StandardsFrameworkItem", "targetEntity": "StandardsFrameworkItem", "sourceEntityKey": "caseIdentifierUUID", "targetEntityKey": "caseIdentifierUUID", "sourceEntityValue": "u1", "targetEntityValue": "u2"}
NODES = [node(0, "StandardsFramework", name="F", caseIdentifierUUID="u0", caseIdentifierURI="c:0"), node(1, caseIdentifierUUID="u1", caseIdentifierURI="c:1"), node(2, caseIdentifierUUID="u2", caseIdentifierURI="c:2")]
EDGES = [edge(0, "hasChild", "n0", "n1"), edge(1, "hasChild", "n0", "n2"), edge(2, "buildsTowards", "u1", "u2", relationshipType="buildsTowards", identifier="e2", **ENDS)]


def sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def written(root, nodes=NODES, edges=EDGES, **changes):
    """A package folder as its manifest says; changes replace fields of the manifest."""
    files = {"data/nodes.jsonl": "\n".join(nodes).encode() + b"\n", "data/relationships.jsonl": "\n".join(edges).encode() + b"\n"}
    profile = json.dumps({"profileId": "prof", "profileVersion": "1.0"}).encode()
    at = root / "profiles/prof/1.0"
    at.mkdir(parents=True, exist_ok=True)
    (at / "profile.json").write_bytes(profile)
    sums = {p: sha(d) for p, d in files.items()}
    whole = packages.artifact_set_sha256(list(sums.values()))
    snapshot = packages.snapshot_id("fw", "2024", whole)
    manifest = {
        "frameworkId": "fw", "frameworkVersion": "2024", "snapshotId": snapshot, "graphType": "t", "packageRevision": 1, "graphPackageId": packages.package_id(snapshot, "t", 1), "artifacts": {"nodes": "data/nodes.jsonl", "relationships": "data/relationships.jsonl"},
        "checksums": sums, "sizes": {p: len(d) for p, d in files.items()}, "artifactSetSha256": whole, "profile": {"id": "prof", "version": "1.0", "sha256": sha(profile)}, "validation": {"status": "pending"},
    } | changes
    folder = root / "packages/fw" / snapshot
    (folder / "data").mkdir(parents=True)
    for p, d in files.items():
        (folder / p).write_bytes(d)
    (folder / packages.MANIFEST).write_text(json.dumps(manifest))
    return folder


def load(spark, root, folder):
    return delivery.load_delivery(spark, str(folder), str(root / "profiles"))


def codes(loaded):
    return sorted((r.code, r.record_id) for r in loaded.findings.collect())


def test_a_delivery_passes(spark, tmp_path):
    folder = written(tmp_path)
    loaded = load(spark, tmp_path, folder)
    assert not loaded.blocked and codes(loaded) == [] and loaded.profile["profileId"] == "prof"
    assert loaded.nodes.count() == 3 and {(r.source, r.target) for r in loaded.edges.collect()} == {("n0", "n1"), ("n0", "n2"), ("n1", "n2")}
    row = delivery.settle_status(spark, loaded).first()
    assert (row.status, row.errors, row.written) == ("passed", 0, True) and packages.read_manifest(str(folder))[0]["validation"]["status"] == "passed"
    assert not os.path.exists(f"{folder}.status")


def test_findings_fail_or_quarantine(spark, tmp_path):
    folder = written(tmp_path, edges=[*EDGES, edge(3, "hasChild", "n0", "n9")])
    loaded = load(spark, tmp_path, folder)
    assert codes(loaded) == [("target-unresolved", "e3")]
    assert delivery.settle_status(spark, loaded, quarantine=True).first().status == "quarantined"


def test_the_first_bad_line_is_named(spark, tmp_path):
    loaded = load(spark, tmp_path, written(tmp_path, nodes=[*NODES, "no json", node(1, gradeLevel="[1]")]))
    assert loaded.blocked and [(r.code, r.seo) for r in loaded.findings.collect()] == [("wire-record", 4)]


def test_a_delivery_has_one_root(spark, tmp_path):
    loaded = load(spark, tmp_path, written(tmp_path, nodes=NODES[1:]))
    assert loaded.blocked and codes(loaded) == [("framework_root_count_invalid", "data/nodes.jsonl")]


def test_a_tree_that_is_not_as_declared(spark, tmp_path):
    folder = written(tmp_path)
    (folder / "extra").mkdir()
    (folder / "extra/file").write_text("x")
    (folder / "DATA").mkdir()
    (folder / "link").symlink_to(folder / "data")
    (folder / "data/nodes.jsonl").write_bytes((folder / "data/nodes.jsonl").read_bytes()[:-1] + b" ")
    (folder / "data/relationships.jsonl").unlink()
    loaded = load(spark, tmp_path, folder)
    assert loaded.blocked and codes(loaded) == [
        ("artifact_checksum_mismatch", "data/nodes.jsonl"), ("package_declared_file_missing", "data/relationships.jsonl"), ("package_link", "link"), ("package_path_case", "data"), ("package_undeclared_directory", "DATA"), ("package_undeclared_directory", "extra"), ("package_undeclared_file", "extra/file"),
    ]
    assert delivery.settle_status(spark, loaded).first().status == "failed"


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({"artifactSetSha256": "sha256:0"}, ("package_identity_mismatch", "artifactSetSha256")), ({"graphPackageId": "other"}, ("package_identity_mismatch", "graphPackageId")), ({"profile": {"id": "prof", "version": "1.0", "sha256": "sha256:0"}}, ("profile_hash_mismatch", "prof")),
        ({"profile": {"id": "prof", "version": "2.0"}}, ("profile_unavailable", "prof")), ({"artifacts": {"nodes": "../nodes.jsonl", "relationships": "data/relationships.jsonl"}}, ("package_artifact_path", "../nodes.jsonl")), ({"artifacts": {"nodes": "data/nodes.jsonl"}}, ("package_artifact_missing", "relationships")),
        ({"sizes": {"data/nodes.jsonl": 1}}, ("artifact_size_mismatch", "data/nodes.jsonl")), ({"frameworkId": "gw"}, ("package_identity_mismatch", "directory")),
    ],
)
def test_manifests_that_are_wrong(spark, tmp_path, changes, want):
    loaded = load(spark, tmp_path, written(tmp_path, **changes))
    assert loaded.blocked and want in codes(loaded)


def test_a_package_that_changed_stays_pending(spark, tmp_path):
    folder = written(tmp_path)
    loaded = load(spark, tmp_path, folder)
    (folder / "data/nodes.jsonl").write_text("\n".join(NODES[:2]))
    row = delivery.settle_status(spark, loaded).first()
    assert (row.status, row.written) == ("pending", False) and packages.read_manifest(str(folder))[0]["validation"]["status"] == "pending"


def test_long_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    folder = written(tmp_path)
    monkeypatch.setattr(delivery, "WHOLE_BYTES", 10)
    assert codes(load(spark, tmp_path, folder)) == []


def test_a_claim_of_a_dead_publisher(spark, tmp_path):
    (tmp_path / "staged").mkdir()
    (tmp_path / "target.claim").write_text("")
    with pytest.raises(FileExistsError):
        packages.publish(spark, str(tmp_path / "staged"), str(tmp_path / "target"))
    os.utime(tmp_path / "target.claim", (1, 1))
    packages.publish(spark, str(tmp_path / "staged"), str(tmp_path / "target"))
    assert (tmp_path / "target").is_dir() and not (tmp_path / "target.claim").exists()


def test_line_numbers_over_splits(spark, tmp_path):
    """Files of many splits, lines longer than a split, empty lines, other line ends."""
    rng = random.Random(0)
    files = {f"f{k}": "\n".join(rng.choice(["", "x" * rng.randrange(400), "é\r", "a b"]) for _ in range(rng.randrange(1, 300))) + rng.choice(["", "\n"]) for k in range(4)} | {"empty": "", "one": "\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        lines = wire.located_lines(spark, [str(tmp_path / f) for f in files])
        assert lines.rdd.getNumPartitions() > 20
        got = {}
        for r in lines.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.line] = r.value
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in files.items():
        body = text.removesuffix("\n")
        want = [x.removesuffix("\r") for x in body.split("\n")] if text else []
        assert got.get(name, {}) == dict(enumerate(want, 1)), name


def test_suspects_alone_meet_the_strict_reader(spark):
    lines = ['{"properties": {"a": "b"}, "labels": ["x"]}', '{"properties": {"a": 1}}', '{"properties": {"a": "b", "a": "c"}}', '{"properties": {}, "n": 1e999}', '{"properties": {}, "n": NaN}', '{"properties": {}, "labels": [1]}', '{"properties": {}, "n": 1e5}', "x", '{"properties": []}', '{"labels": []}', '{"properties": {"a": null}}', "[]"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = {r.i: (r.plain, r.error) for r in rows.select("i", wire.plain_envelope(rows.value).alias("plain"), wire.envelope_error("value").alias("error")).collect()}
    assert [i for i, (plain, _) in got.items() if plain] == [0, 6]
    assert [i for i, (_, error) in got.items() if error is None] == [0, 6]
