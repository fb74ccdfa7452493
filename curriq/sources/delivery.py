"""A delivery loaded from end to end: manifest, package tree, profile, checksums, snapshot identity, decoding, status.

Each step rests on those before it. What breaks integrity blocks decoding, so a blocked package has findings and no tables.
Files are listed and hashed through Hadoop's file system; node and relationship lines are decoded by Spark in splits. The
snapshot of what was read is compared once more before the status is written: a package that changed meanwhile stays pending.

Manifest: frameworkId, frameworkVersion, snapshotId, graphPackageId, graphType, packageRevision, artifacts (logical name: path,
`nodes` and `relationships` among them), checksums (path: sha256), sizes (path: bytes), artifactSetSha256, profile (id,
version, sha256).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.operators import validation
from curriq.sources.packages import MANIFEST, _store, artifact_set_sha256, change_status, load_profile, package_id, read_manifest, snapshot_id
from curriq.sources.wire import read_nodes, read_relationships, resolve_by_case

FINDING = "code string, record_id string, seo long, severity string, message string"
#: Longer files are hashed as one stream, shorter ones by Spark where they are read.
WHOLE_BYTES = 256 << 20


@dataclass
class Loaded:
    """manifest and its bytes, profile, tables (None if blocked), findings, and the signature of what was read."""

    folder: str
    manifest: dict
    manifest_bytes: bytes
    profile: dict | None
    nodes: DataFrame | None
    edges: DataFrame | None
    findings: DataFrame
    signature: str

    @property
    def blocked(self) -> bool:
        return self.nodes is None


def package_tree(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(path, kind, bytes) of all that lies in a package folder, kind: file, directory or link; links aren't followed."""
    store, root = _store(spark, folder)
    base = store.makeQualified(root).toUri().getPath().rstrip("/")
    out, open_ = [], [root]
    while open_:
        for status in store.listStatus(open_.pop()):
            at = status.getPath().toUri().getPath()[len(base) + 1 :]
            # a local store follows links where it lists
            link = status.isSymlink() or (store.getScheme() == "file" and Path(f"{base}/{at}").is_symlink())
            kind = "link" if link else "directory" if status.isDirectory() else "file"
            out.append((at, kind, int(status.getLen()) if kind == "file" else 0))
            if kind == "directory":
                open_.append(status.getPath())
    return sorted(out)


def tree_findings(tree: list[tuple[str, str, int]], declared: list[str]) -> list[tuple]:
    """A package holds its manifest, the declared files and the folders that these need; no links, no two names alike."""
    wanted = {MANIFEST, *declared}
    folders = {str(p) for path in wanted for p in PurePosixPath(path).parents if str(p) != "."}
    files, there = {p for p, k, _ in tree if k == "file"}, {p for p, k, _ in tree if k == "directory"}
    told = [("package_link", p, "a link in a package") for p, k, _ in tree if k == "link"]
    told += [("package_declared_file_missing", p, "declared and not there") for p in sorted(wanted - files)]
    told += [("package_undeclared_file", p, "there and not declared") for p in sorted(files - wanted)]
    told += [("package_undeclared_directory", p, "no declared file needs it") for p in sorted(there - folders)]
    seen: dict[str, str] = {}
    for p in sorted(files | there | set(declared)):
        if (first := seen.setdefault(p.casefold(), p)) != p:
            told.append(("package_path_case", p, f"differs from {first} in case only"))
    return told


def declaration_findings(manifest: dict) -> list[tuple]:
    """Names and paths that are declared: known logical names, relative paths inside the package, each once whatever its case."""
    artifacts, told = manifest.get("artifacts") or {}, []
    for name in ("nodes", "relationships"):
        if name not in artifacts:
            told.append(("package_artifact_missing", name, "the manifest names no such artifact"))
    for kind, values in (("package_artifact_name_case", list(artifacts)), ("package_artifact_path_case", list(artifacts.values()))):
        seen: dict[str, str] = {}
        for v in values:
            if v.casefold() in seen:
                told.append((kind, v, f"declared beside {seen[v.casefold()]}"))
            seen.setdefault(v.casefold(), v)
    for path in artifacts.values():
        if path.startswith("/") or ".." in PurePosixPath(path).parts or path == MANIFEST or "\\" in path:
            told.append(("package_artifact_path", path, "no path inside the package"))
        if path not in (manifest.get("checksums") or {}):
            told.append(("package_checksum_undeclared", path, "the manifest has no checksum of it"))
    return told


def file_hashes(spark: SparkSession, folder: str, tree: list[tuple[str, str, int]], paths: list[str]) -> dict[str, str]:
    """sha256 of files of a package: those of up to WHOLE_BYTES together by Spark, longer ones as streams."""
    sizes = {p: n for p, k, n in tree if k == "file"}
    short = [p for p in paths if p in sizes and sizes[p] <= WHOLE_BYTES]
    out = {}
    if short:
        store, root = _store(spark, folder)
        base = store.makeQualified(root).toUri().getPath().rstrip("/")
        rows = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{p}" for p in short]).select("path", F.sha2("content", 256).alias("sha")).collect()
        strip = lambda uri: spark._jvm.org.apache.hadoop.fs.Path(uri).toUri().getPath()[len(base) + 1 :]
        out = {strip(r["path"]): "sha256:" + r["sha"] for r in rows}  # a package's files
    for p in set(paths) & set(sizes) - set(short):
        store, at = _store(spark, f"{folder}/{p}")
        stream = store.open(at)
        try:
            out[p] = "sha256:" + spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
    return out


def checksum_findings(manifest: dict, tree: list[tuple[str, str, int]], hashes: dict[str, str]) -> list[tuple]:
    """Sizes and checksums of declared files that are there; a wrong size is told alone."""
    sizes, told = {p: n for p, k, n in tree if k == "file"}, []
    for path, declared in sorted((manifest.get("checksums") or {}).items()):
        size = (manifest.get("sizes") or {}).get(path)
        if path in sizes and size is not None and size != sizes[path]:
            told.append(("artifact_size_mismatch", path, f"declared {size}, observed {sizes[path]}"))
        elif path in hashes and hashes[path] != declared:
            told.append(("artifact_checksum_mismatch", path, "another checksum"))
    return told


def identity_findings(folder: str, manifest: dict, hashes: dict[str, str]) -> list[tuple]:
    """Ids that the files and the folder give: the artifact set, the snapshot and package ids made of it, and the folder's names."""
    own = artifact_set_sha256(list(hashes.values())) if hashes else ""
    snapshot = snapshot_id(str(manifest.get("frameworkId")), str(manifest.get("frameworkVersion")), own)
    parts = PurePosixPath(folder).parts
    pairs = {
        "artifactSetSha256": (manifest.get("artifactSetSha256"), own), "snapshotId": (manifest.get("snapshotId"), snapshot), "graphPackageId": (manifest.get("graphPackageId"), package_id(snapshot, str(manifest.get("graphType")), manifest.get("packageRevision", 0))),
        "directory": ("/".join(parts[-2:]), f"{manifest.get('frameworkId')}/{manifest.get('snapshotId')}"),
    }
    return [("package_identity_mismatch", name, f"{a} and {b}") for name, (a, b) in pairs.items() if a != b]


def profile_of(manifest: dict, profiles: str) -> tuple[dict | None, list[tuple]]:
    """The profile that the manifest names by id, version and hash of its bytes."""
    wanted = manifest.get("profile") or {}
    try:
        profile = load_profile(profiles, str(wanted.get("id")), str(wanted.get("version")))
        data = (Path(profiles) / wanted["id"] / wanted["version"] / "profile.json").read_bytes()
    except (OSError, ValueError) as error:
        return None, [("profile_unavailable", str(wanted.get("id")), str(error)[:200])]
    sha = "sha256:" + hashlib.sha256(data).hexdigest()
    if sha != wanted.get("sha256"):
        return None, [("profile_hash_mismatch", wanted["id"], f"declared {wanted.get('sha256')}, observed {sha}")]
    return profile, []


def signature(manifest_bytes: bytes, tree: list[tuple[str, str, int]], hashes: dict[str, str]) -> str:
    """A digest of a package as it was read: manifest, tree and contents."""
    lines = [hashlib.sha256(manifest_bytes).hexdigest(), *(f"{k} {n} {p}" for p, k, n in tree if p != MANIFEST), *(f"{h} {p}" for p, h in sorted(hashes.items()))]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _table(spark: SparkSession, told: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(code, record, None, "error", message) for code, record, message in told], FINDING)


def load_delivery(spark: SparkSession, folder: str, profiles: str) -> Loaded:
    """A delivery with its findings; decoded unless its integrity or its profile fails.

    Nodes and edges are decoded as in `wire`: a first bad line of each file is named by its number, and a file with one gives
    no table. Progression edges get the ids of the standards whose CASE identifiers they name.
    """
    manifest, data = read_manifest(folder)
    declared = sorted((manifest.get("checksums") or {}))
    tree = package_tree(spark, folder)
    told = declaration_findings(manifest) + tree_findings(tree, declared)
    profile, missing = profile_of(manifest, profiles)
    hashes = file_hashes(spark, folder, tree, declared)
    told += missing + checksum_findings(manifest, tree, hashes)
    if len(hashes) == len(declared):
        told += identity_findings(folder, manifest, hashes)
    seen = signature(data, tree, hashes)
    if told:
        return Loaded(folder, manifest, data, profile, None, None, _table(spark, told), seen)
    artifacts = manifest["artifacts"]
    nodes, bad_nodes = read_nodes(spark, [f"{folder}/{artifacts['nodes']}"])
    edges, bad_edges = read_relationships(spark, [f"{folder}/{artifacts['relationships']}"])
    bad = bad_nodes.unionByName(bad_edges).withColumn("path", F.regexp_extract("record_id", r"^(.*):\d+$", 1))
    first = bad.groupBy("path").agg(F.min_by(F.struct("code", "record_id", "seo", "severity", "message"), "seo").alias("f")).select("f.*").collect()  # one a file
    roots = nodes.where("kind = 'framework'").limit(2).count()
    if first or roots != 1:
        wrong = [] if roots == 1 or first else [("framework_root_count_invalid", artifacts["nodes"], f"{roots} framework roots")]
        return Loaded(folder, manifest, data, profile, None, None, spark.createDataFrame([tuple(r) for r in first], FINDING).unionByName(_table(spark, wrong)), seen)
    progressions = F.col("label").isin("buildsTowards", "relatesTo")
    joined = resolve_by_case(edges.where(progressions), nodes).unionByName(edges.where(~progressions))
    found = [*validation.node_identity(nodes), *validation.edge_identity(joined, nodes), validation.edge_status(joined)]
    return Loaded(folder, manifest, data, profile, nodes, joined, validation.report(found), seen)


def unchanged(spark: SparkSession, loaded: Loaded) -> bool:
    """Is the package still what was read?"""
    _, data = read_manifest(loaded.folder)
    tree = package_tree(spark, loaded.folder)
    return signature(data, tree, file_hashes(spark, loaded.folder, tree, sorted(loaded.manifest.get("checksums") or {}))) == loaded.signature


def settle_status(spark: SparkSession, loaded: Loaded, quarantine: bool = False) -> DataFrame:
    """One row: package_id, status, errors, written. The status is written into the manifest, if the package is unchanged."""
    row = validation.status(loaded.findings, quarantine).first()
    written = unchanged(spark, loaded)
    if written:
        change_status(loaded.folder, loaded.manifest_bytes, row["status"])
    return spark.createDataFrame([(loaded.manifest.get("graphPackageId"), row["status"] if written else "pending", row["errors"], written)], "package_id string, status string, errors long, written boolean")
