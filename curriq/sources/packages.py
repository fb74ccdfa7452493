"""Package folders: discovery, manifests, checksums, publishing, status changes and provenance shards.

Folders and manifests are few and small and are handled on the driver; file contents are hashed by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.operators.statistics import shard_of
from curriq.sources.wire import strict_object

MANIFEST = "package_manifest.json"
STATUSES = ("pending", "passed", "failed", "quarantined")
SHARDS = 64


def discover(root: str | Path) -> list[dict]:
    """<root>/<framework>/<snapshot> folders with a manifest, sorted; links and names that differ in case only are errors."""
    found, seen = [], {}
    for framework in sorted(Path(root).iterdir()):
        if framework.name.startswith(".") or not framework.is_dir():
            continue
        for folder in sorted([framework, *framework.iterdir()]):
            if folder.is_symlink():
                raise ValueError(f"{folder} is a link")
            if folder == framework or not folder.is_dir() or not (folder / MANIFEST).is_file():
                continue
            if (key := str(folder.relative_to(root)).casefold()) in seen:
                raise ValueError(f"{folder} and {seen[key]} differ in case only")
            seen[key] = folder
            found.append({"framework_id": framework.name, "snapshot_id": folder.name, "path": str(folder)})
    return found


def snapshot_id(framework_id: str, version: str, artifact_set_sha256: str) -> str:
    return f"{framework_id}@{version}+{artifact_set_sha256.removeprefix('sha256:')[:12]}"


def package_id(snapshot: str, graph_type: str, revision: int) -> str:
    return f"{snapshot}--{graph_type}--p{revision}"


def artifact_set_sha256(checksums: list[str]) -> str:
    """Fingerprint of a set of qualified checksums: sorted, a line each."""
    if not checksums:
        raise ValueError("no checksum")
    return "sha256:" + hashlib.sha256("".join(f"{c}\n" for c in sorted(checksums)).encode()).hexdigest()


def artifact_set_digest(checksums: DataFrame, column: str = "checksum") -> DataFrame:
    """artifact_set_sha256 as a query (package_id, checksum) -> (package_id, artifact_set): a package has some dozen files."""
    lines = F.concat(F.array_join(F.sort_array(F.collect_list(column)), "\n"), F.lit("\n"))
    return checksums.groupBy("package_id").agg(F.concat(F.lit("sha256:"), F.sha2(lines, 256)).alias("artifact_set"))


def read_manifest(folder: str) -> tuple[dict, bytes]:
    data = (Path(folder) / MANIFEST).read_bytes()
    return strict_object(data.decode("utf-8")), data


def manifest_table(spark: SparkSession, folders: list[dict]) -> DataFrame:
    """The package dimension: a row for each manifest."""
    rows = []
    for f in folders:
        m, _ = read_manifest(f["path"])
        fw = m.get("framework", {})
        rows.append((m["frameworkId"], f["snapshot_id"], m["graphPackageId"], m["graphType"], int(m["packageRevision"]), bool(fw.get("isCurrent")), (m.get("validation") or {}).get("status", "pending"), fw.get("jurisdiction"), fw.get("name"), list(fw.get("languages") or []), list(fw.get("normalizedGrades") or []), list(fw.get("normalizedSubjects") or []), dict(m.get("checksums") or {}), f["path"]))
    return spark.createDataFrame(rows, "framework_id string, snapshot_id string, package_id string, graph_type string, revision int, is_current boolean, status string, jurisdiction string, name string, languages array<string>, grades array<string>, subjects array<string>, checksums map<string,string>, path string")


def declared_files(manifests: DataFrame) -> DataFrame:
    """package_id, path (within the package), sha256 that manifests declare."""
    return manifests.select("package_id", F.explode("checksums").alias("path", "sha256"))


def observed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the folder), sha256, size of the files that are there, without the manifest; hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(str(Path(folder).resolve())) + "/", "")
    return files.select(inner.alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.col("length").alias("size")).where(F.col("path") != MANIFEST)


def change_status(folder: str, before: bytes, status: str) -> dict:
    """Write a pending manifest's final status, in one step, if its bytes are still what was validated."""
    if status not in STATUSES[1:]:
        raise ValueError(f"{status} is no final status")
    path, claim = Path(folder) / MANIFEST, f"{folder}.status"
    try:  # one writer at a time compares and replaces
        os.close(os.open(claim, os.O_CREAT | os.O_EXCL))
    except FileExistsError as error:
        raise RuntimeError("another writer changes the status") from error
    try:
        return _replace_status(path, before, status)
    finally:
        os.unlink(claim)


def _replace_status(path: Path, before: bytes, status: str) -> dict:
    if path.read_bytes() != before:
        raise RuntimeError("the manifest has changed since it was read")
    manifest = strict_object(before.decode("utf-8"))
    validation = manifest.setdefault("validation", {})
    if validation.get("status", "pending") != "pending":
        raise RuntimeError("the manifest isn't pending")
    validation["status"] = status
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=".manifest-")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(name, path)
    return manifest


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: the same store that Spark's readers and writers use."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_file(spark: SparkSession, path: str, text: str) -> None:
    store, at = _store(spark, path)
    out = store.create(at, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def publish(spark: SparkSession, staged: str, target: str, stale_seconds: int = 3600) -> None:
    """Move a complete package to its place; an error if there is one already.

    The place is claimed by a marker that only one writer can create, so two publishers can't both pass. A claim older than
    stale_seconds was left by a publisher that died: moving a folder takes no such time.
    """
    store, to = _store(spark, target)
    store.mkdirs(to.getParent())
    claim = _store(spark, f"{target}.claim")[1]
    if store.exists(claim) and time.time() - store.getFileStatus(claim).getModificationTime() / 1000 > stale_seconds:
        store.delete(claim, False)
    try:
        store.create(claim, False).close()
    except Exception as error:
        raise FileExistsError(f"{target} is being published") from error
    try:
        if store.exists(to) or not store.rename(_store(spark, staged)[1], to):
            raise FileExistsError(target)
    finally:
        store.delete(claim, False)


def build_package(nodes: DataFrame, edges: DataFrame, folder: str, manifest: dict) -> dict:
    """Write node and edge tables with a manifest into a new package folder: staged beside it, checked and then moved."""
    spark, staged = nodes.sparkSession, f"{folder}.staged-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{staged}/nodes")
    edges.write.partitionBy("label").parquet(f"{staged}/relationships")
    files = {r["path"]: r["sha256"] for r in observed_files(spark, staged).collect()}  # a package's files
    done = manifest | {"checksums": files, "artifactSetSha256": artifact_set_sha256(list(files.values())), "validation": {"status": "pending"}}
    write_file(spark, f"{staged}/{MANIFEST}", json.dumps(done, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    publish(spark, staged, folder)
    return done


def read_artifact(spark: SparkSession, folder: str, manifest: dict, name: str, most: int = 32 << 20) -> bytes:
    """A declared file of a package by its logical name (in `artifacts`) or path; its checksum has to be the declared one."""
    path = (manifest.get("artifacts") or {}).get(name, name)
    declared = (manifest.get("checksums") or {}).get(path)
    if declared is None:
        raise LookupError(f"the manifest doesn't declare {name}")
    row = spark.read.format("binaryFile").load(f"{folder}/{path}").where(F.col("length") <= most).select("content").first()
    if row is None:
        raise ValueError(f"{name} is longer than {most} bytes")
    if "sha256:" + hashlib.sha256(row[0]).hexdigest() != declared:
        raise ValueError(f"{name} isn't what the manifest declares")
    return bytes(row[0])


def load_profile(root: str | Path, profile_id: str, version: str) -> dict:
    """<root>/<id>/<version>/profile.json, which has to name exactly this id and version."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", profile_id) or not re.fullmatch(r"[0-9]+(\.[0-9]+)*", version):
        raise ValueError(f"no profile is named {profile_id} {version}")
    profile = strict_object((Path(root) / profile_id / version / "profile.json").read_text("utf-8"))
    if (profile.get("profileId"), profile.get("profileVersion")) != (profile_id, version):
        raise ValueError(f"the profile at {profile_id}/{version} names another")
    return profile


def load_package(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """(manifest, nodes, edges, findings) of a package as built: files against the manifest, then ids, endpoints and loops."""
    from curriq.operators import validation

    manifest, _ = read_manifest(folder)
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/relationships")
    declared = spark.createDataFrame(list((manifest.get("checksums") or {}).items()), "path string, sha256 string")
    observed = observed_files(spark, folder)
    sized = declared.join(observed.select("path", "size"), "path", "left").withColumn("size", F.coalesce("size", F.lit(-1)))
    ids = validation.duplicates(nodes, ["node_id"], "node-duplicate", "node_id", order="node_id")
    findings = validation.report([validation.declared_against_observed(sized, observed), ids, *validation.edge_identity(edges.withColumn("seo", F.coalesce(F.col("seo"), F.lit(0))) if "seo" in edges.columns else edges.withColumn("seo", F.lit(0)), nodes)])
    return manifest, nodes, edges, findings


def write_delivery(prefix: DataFrame, progressions: DataFrame, path: str) -> None:
    """Lines of the standards part in their order (line, value), then canonical progression lines by (label, edge_id)."""
    first = prefix.select(F.lit(0).alias("part"), F.col("line").cast("long").alias("n"), F.lit("").alias("label"), F.lit("").alias("id"), "value")
    columns = sorted(c for c in progressions.columns)
    tail = progressions.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), "label", F.col("edge_id").alias("id"), F.to_json(F.struct(*columns)).alias("value"))
    # files are dealt by range, so they concatenate to the delivery in order of name
    first.unionByName(tail).repartitionByRange("part", "n", "label", "id").sortWithinPartitions("part", "n", "label", "id").select("value").write.text(path)


def write_shards(records: DataFrame, key: str, path: str) -> None:
    """Provenance records in 64 folders by the first byte of the key's SHA-256."""
    records.withColumn("bucket", shard_of(key, SHARDS)).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("bucket").parquet(path)


def read_shard(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """The record of one key: one folder is read."""
    bucket = hashlib.sha256(value.encode()).digest()[0] % SHARDS
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value))


def slim(records: DataFrame, heavy: list[str]) -> DataFrame:
    """Records without their heavy columns, with the hash of the whole record's canonical JSON."""
    whole = F.to_json(F.struct(*sorted(records.columns)))
    return records.withColumn("original_sha256", F.sha2(whole, 256)).drop(*heavy)
