"""The contract of stored progression edges, for many packages at once.

edges: package_id, edge_id, seo, label, relationship_type, property_identifier, source and target with their _labels, _entity,
_entity_key and _entity_value, status, confidence. standards: package_id, node_id, case_identifier_uuid. packages: package_id,
declared (progressions are among the included graph types), has_artifacts, evidence_valid, builds_towards, relates_to (counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curriq.operators.traversal import peel
from curriq.session import cut, dealt, loop_dir, sparing

LABELS = ("buildsTowards", "relatesTo")
SIEVE = 1 << 27  # bits: 16 MB, broadcast
ITEM, KEY = "StandardsFrameworkItem", "caseIdentifierUUID"


def _told(rows: DataFrame, record: str | None, checks: dict) -> DataFrame:
    told = F.array_compact(F.array(*[F.when(~F.coalesce(passed, F.lit(False)), F.lit(code)) for code, passed in checks.items()]))
    return rows.select("package_id", F.explode(told).alias("code"), (F.col(record) if record else F.lit(None)).cast("string").alias("record_id"))


def _sieve(rows: DataFrame, keys: list[str], count: int, folder: str, name: str) -> DataFrame:
    """bucket, bits: the hashes that two or more rows have, as a bitmap of SIEVE bits however many they are.

    A row moves as 40 bits of its hash, and groups of rows are told apart later: the sieve lets through all rows of a
    repeated key, and some others.
    """
    again = dealt(rows.select(_hash(keys).alias("hash")), "hash", count=count).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    bits = again.select(F.expr(f"hash & {SIEVE - 1}").alias("at")).groupBy(F.expr("at >> 15").alias("bucket"))
    return cut(bits.agg(F.bitmap_construct_agg(F.expr("at & 32767")).alias("bits")), folder, name)


def _hash(keys: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 24)


def _sifted(rows: DataFrame, keyed: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """The rows that one of the sieves lets through: keyed has each by a name, with its keys."""
    columns, held = rows.columns, F.lit(False)
    for name, (keys, sieve) in keyed.items():
        at = f"({name}_hash & {SIEVE - 1})"
        own = F.broadcast(sieve.select(F.col("bucket").alias(f"{name}_bucket"), F.col("bits").alias(f"{name}_bits")))
        rows = rows.withColumn(f"{name}_hash", _hash(keys)).join(own, F.expr(f"{at} >> 15 = {name}_bucket"), "left")
        byte = f"CAST(conv(hex(substring({name}_bits, CAST({at} % 32768 div 8 AS int) + 1, 1)), 16, 10) AS int)"
        held = held | F.coalesce(F.expr(f"getbit({byte}, CAST({at} % 8 AS int)) = 1"), F.lit(False))
    return rows.where(held).select(*columns)


def graph_rules(edges: DataFrame, standards: DataFrame | None, packages: DataFrame, ready: bool = False) -> DataFrame:
    """(package_id, code, record_id); record_id is an edge's, or null where a finding is about the package.

    Without standards, edges have source_uuid and target_uuid: what their package's standards at the ends are known by, or null.
    ready: the edges are a written table already, or what is computed of its rows.
    """
    with sparing(edges.sparkSession):
        return _graph_rules(edges, standards, packages, ready)


def _graph_rules(edges: DataFrame, standards: DataFrame | None, packages: DataFrame, ready: bool) -> DataFrame:
    folder, sides = loop_dir(edges.sparkSession), ("source", "target")
    value = lambda side: F.coalesce(F.col(f"{side}_entity_value"), F.lit(""))
    identity = (F.col("property_identifier") == F.col("edge_id")) & (F.col("relationship_type") == F.col("label"))
    for side in sides:
        identity = identity & (F.col(f"{side}_labels") == F.array(F.lit(ITEM))) & (F.col(f"{side}_entity") == ITEM) & (F.col(f"{side}_entity_key") == KEY)
    alone = {
        "lp_identity_mismatch": identity, "lp_self_edge": F.col("source") != F.col("target"), "lp_foreign_resolution_metadata": F.col("status").isNull() & F.col("confidence").isNull(),
        "lp_relates_to_order": (F.col("label") != "relatesTo") | (value("source") < value("target")),
    }
    builds = F.col("label") == "buildsTowards"
    if standards is None:
        alone = {"lp_endpoint_mismatch": (F.col("source_uuid") == F.col("source_entity_value")) & (F.col("target_uuid") == F.col("target_entity_value"))} | alone
    # the rules meet the edges many times: what they need is written once, whatever view the edges come from
    values = [f"{side}_entity_value" for side in sides]
    edges = edges.where(F.col("label").isin(*LABELS)).select("package_id", "edge_id", "seo", "label", *sides, *values, *[passed.alias(code) for code, passed in alone.items()])
    if not ready:
        edges = cut(edges, folder, "edges")
    count = edges.count()
    counts = edges.groupBy("package_id").agg(F.count_if(builds).alias("b"), F.count_if(F.col("label") == "relatesTo").alias("r"))
    met = packages.join(counts, "package_id", "left").fillna(0, ["b", "r"])
    whole = _told(met, None, {
        "lp_undeclared": F.col("declared") | ~((F.col("b") + F.col("r") > 0) | F.col("has_artifacts")), "lp_evidence_not_validated": ~F.col("declared") | F.col("evidence_valid"),
        "lp_manifest_count_mismatch": (F.col("b") == F.col("builds_towards")) & (F.col("r") == F.col("relates_to")),
    })
    placed, checks = edges, {code: F.col(code) for code in alone}
    if standards is not None:
        standards = cut(standards.select("package_id", "node_id", "case_identifier_uuid"), folder, "standards")
        placed, ends = edges.select("package_id", "edge_id", *sides, *values, *alone), F.lit(True)
        for side in sides:
            own = standards.select("package_id", F.col("node_id").alias(side), F.lit(True).alias(f"{side}_there"), F.col("case_identifier_uuid").alias(f"{side}_uuid"))
            placed = placed.join(own, ["package_id", side], "left")
            ends = ends & F.col(f"{side}_there") & (F.col(f"{side}_uuid") == F.col(f"{side}_entity_value"))
        checks = {"lp_endpoint_mismatch": ends} | checks
    own = _told(placed, "edge_id", checks)
    # all but the first edge of an unordered pair, or of an id, in the order of the file: only edges whose pair or id may
    # repeat are met again
    paired = edges.select("package_id", "edge_id", "seo", F.least(value("source"), value("target")).alias("low"), F.greatest(value("source"), value("target")).alias("high"))
    pair, name = ["package_id", "low", "high"], ["package_id", "edge_id"]
    paired = cut(_sifted(paired, {"pair": (pair, _sieve(paired, pair, count, folder, "pair_sieve")), "id": (name, _sieve(paired, name, count, folder, "id_sieve"))}), folder, "paired")
    first = lambda keys, at: cut(paired.groupBy(*keys).agg(F.min("seo").alias(at), F.max("seo").alias("last")).where(F.col(at) < F.col("last")).drop("last"), folder, at)
    named = paired.where("package_id IS NOT NULL AND edge_id IS NOT NULL")
    later = named.join(first(pair, "pair_first"), pair, "left").join(first(name, "id_first"), name, "left").where("seo > pair_first OR seo > id_first")
    conflicts = later.select("package_id", F.lit("lp_pair_conflict").alias("code"), F.col("edge_id").alias("record_id"))
    # no node without outgoing edges is on a cycle, so the edges to such nodes go first
    at = lambda side: F.struct("package_id", F.col(side).alias("n")).alias(side)
    steps = edges.where(builds).select(at("source"), at("target"))
    inner = dealt(steps, "target").join(steps.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    left = peel(inner.select("source", "target"))
    cyclic = left.select(F.col("source.package_id").alias("package_id")).distinct().select("package_id", F.lit("lp_builds_towards_cycle").alias("code"), F.lit(None).cast("string").alias("record_id"))
    return whole.unionByName(own).unionByName(conflicts).unionByName(cyclic)
