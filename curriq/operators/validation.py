"""Validation rules as queries: each gives rows of findings (code, record_id, seo, severity, message); `report` joins them.

Nodes: node_id, kind (framework, standard, component), seo, statement_type, statement_code, case_identifier_uuid ...
Edges: edge_id, label, relationship_type, source, target, seo, status, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curriq.operators.traversal import peel, reachable
from curriq.session import cut, loop_dir

LABELS = ("hasChild", "supports", "buildsTowards", "relatesTo")
#: What a claim on two standards can decide; the first two are published as edges.
DECISIONS = ("buildsTowards", "relatesTo", "no_relation", "needs_review")


def finding(rows: DataFrame, code: str, record: str, message: Column | str, severity: str = "error") -> DataFrame:
    seo = F.col("seo").cast("long") if "seo" in rows.columns else F.lit(None).cast("long")
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(code).alias("code"), F.col(record).cast("string").alias("record_id"), seo.alias("seo"), F.lit(severity).alias("severity"), text.alias("message"))


def report(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def status(findings: DataFrame, quarantine: bool = False) -> DataFrame:
    """One row: passed without errors, else failed or quarantined."""
    bad = F.coalesce(F.max((F.col("severity") == "error").cast("int")), F.lit(0)) == 1
    return findings.agg(F.when(bad, "quarantined" if quarantine else "failed").otherwise("passed").alias("status"), F.count_if(F.col("severity") == "error").alias("errors"))


def duplicates(rows: DataFrame, keys: list[str], code: str, record: str, order: str = "seo") -> DataFrame:
    """Every row but the first of its key, by (order, record); of rows that are equal in both, one is the first.

    Keys are first counted by their hashes, and only rows whose hash occurs again are looked at whole (different keys of
    one hash are told apart then). These are counted by (key, order, record) and each key's least comes from partial
    aggregates, so a frequent key isn't gathered in one task.
    """
    place = [order] if record == order else [order, record]
    own = [k for k in keys if k not in place]
    hashed = rows.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys))).withColumn("__hash", F.xxhash64(*keys))
    again = hashed.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select("__hash")
    known = hashed.join(again, "__hash", "left_semi").groupBy(*own, *place).agg(F.count("*").alias("times"))
    first = known.groupBy(*keys).agg(F.min(F.struct(*place)).alias("__first"), F.sum("times").alias("__all")).where("__all > 1")
    later = known.join(first, keys).withColumn("times", F.col("times") - (F.struct(*place) == F.col("__first")).cast("long")).where("times > 0")
    later = later.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return finding(later, code, record, F.concat_ws(" ", F.lit("repeats"), *[F.col(k).cast("string") for k in keys]))


def node_identity(nodes: DataFrame) -> list[DataFrame]:
    """Missing or repeated ids and CASE identifiers; labels that name no kind."""
    out = [finding(nodes.where("kind IS NULL"), "node-label", "node_id", "not exactly one known label"), duplicates(nodes, ["node_id"], "node-duplicate", "node_id")]
    for column in ("case_identifier_uuid", "case_identifier_uri"):
        if column in nodes.columns:
            items = nodes.where("kind = 'standard'")
            out += [finding(items.where(F.col(column).isNull() | (F.trim(column) == "")), f"{column}-missing", "node_id", f"{column} is missing"), duplicates(items.where(F.col(column).isNotNull()), [column], f"{column}-duplicate", "node_id")]
    return out


def edge_identity(edges: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """Unknown labels, repeated ids and (label, source, target), self loops and endpoints that are no nodes."""
    ids = nodes.select("node_id").distinct()
    lost = [finding(edges.join(ids.withColumnRenamed("node_id", end), end, "left_anti"), f"{end}-unresolved", "edge_id", F.concat(F.lit(f"no {end} "), F.col(end))) for end in ("source", "target")]
    return [
        finding(edges.where(~F.col("label").isin(*LABELS)), "edge-label", "edge_id", "unsupported label"), duplicates(edges, ["edge_id"], "edge-id-duplicate", "edge_id"),
        duplicates(edges, ["label", "source", "target"], "edge-duplicate", "edge_id"), finding(edges.where("source = target"), "edge-self-loop", "edge_id", "source and target are the same"), *lost,
    ]


def edge_status(edges: DataFrame, known: tuple[str, ...] = ("unresolvedRootFallback",)) -> DataFrame:
    return finding(edges.where(F.col("status").isNotNull() & ~F.col("status").isin(*known)), "edge-status", "edge_id", "unknown resolution status")


def statement_types(items: DataFrame, policies: DataFrame) -> list[DataFrame]:
    """items against policies (statement_type, normalized_type, is_graph_node, code_type): missing, spaced, unknown or
    disallowed types, and normalized types that differ from the policy's."""
    known = items.join(policies.withColumnRenamed("normalized_type", "policy_type"), "statement_type", "left")
    return [
        finding(items.where("statement_type IS NULL"), "statement-type-missing", "node_id", "no statement type"),
        finding(items.where(F.trim("statement_type") != F.col("statement_type")), "statement-type-space", "node_id", "space around the statement type"),
        finding(known.where("statement_type IS NOT NULL AND is_graph_node IS NULL"), "statement-type-unknown", "node_id", "not in the profile"),
        finding(known.where("is_graph_node = false"), "statement-type-no-node", "node_id", "this type is no graph node"),
        finding(known.where("is_graph_node AND NOT (normalized_type <=> policy_type)"), "statement-type-normalized", "node_id", "differs from the profile's normalized type"),
    ]


def statement_codes(items: DataFrame, pattern: str, permitted: Column) -> list[DataFrame]:
    """Blank, spaced, disallowed, malformed or repeated raw codes (of the whole package, whatever their scope)."""
    coded = items.where("statement_code IS NOT NULL")
    return [
        finding(coded.where(F.trim("statement_code") == ""), "code-blank", "node_id", "blank code"), finding(coded.where(F.trim("statement_code") != F.col("statement_code")), "code-space", "node_id", "space around the code"),
        finding(coded.where(~permitted), "code-not-permitted", "node_id", "this type has no codes"), finding(coded.where(permitted & ~F.col("statement_code").rlike(f"^(?:{pattern})$")), "code-pattern", "node_id", "not of the profile's form"),
        duplicates(coded, ["statement_code"], "code-duplicate", "node_id"),
    ]


def aware_timestamps(rows: DataFrame, record: str, column: str) -> list[DataFrame]:
    """Timestamps as text: those that are none, and those without an offset from UTC."""
    text = F.col(column)
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
    offset = text.rlike(form + r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    # Spark's reader wants seconds
    whole = F.regexp_replace(text, r"^(.{10}[T ][0-9]{2}:[0-9]{2})(?=$|Z|[+-])", "$1:00")
    is_one = text.rlike(form + r"(Z|[+-][0-9]{2}:?[0-9]{2})?$") & F.try_to_timestamp(whole).isNotNull()
    return [finding(rows.where(text.isNotNull() & ~is_one), "timestamp-invalid", record, f"{column} is no timestamp"), finding(rows.where(is_one & ~offset), "timestamp-naive", record, f"{column} has no offset")]


def grade_levels(items: DataFrame, known: list[str]) -> list[DataFrame]:
    levels = F.col("grade_level")
    return [
        finding(items.where(levels.isNull() | (F.size(levels) == 0)), "grades-empty", "node_id", "no grade"), finding(items.where(F.size(F.array_distinct(levels)) < F.size(levels)), "grades-repeated", "node_id", "a grade twice"),
        finding(items.where(F.size(F.array_except(levels, F.array(*map(F.lit, known)))) > 0), "grades-unknown", "node_id", "a grade that the profile doesn't know"),
    ]


def parent_policy(edges: DataFrame, items: DataFrame, policies: DataFrame, most: int | None = None, root: str | None = None) -> list[DataFrame]:
    """Ordinary parents against policies (statement_type, parent_type, least, most): counts by parent type within bounds,
    parents of a type that isn't listed, and items with more parents than `most` (None: any number).

    An edge with the fallback status must come from the root and be its target's only one; it isn't counted otherwise.
    """
    types = items.select(F.col("node_id"), "statement_type")
    fallback = edges.where("status = 'unresolvedRootFallback'")
    all_in = edges.groupBy(F.col("target").alias("t")).agg(F.count("*").alias("n"))
    out = [finding(fallback.join(all_in, fallback["target"] == all_in["t"]).where((F.col("n") > 1) | (F.lit(root).isNotNull() & (F.col("source") != F.lit(root)))), "parent-fallback", "edge_id", "a fallback parent is the root and the only parent")]
    ordinary = edges.where("status IS NULL").join(types.select(F.col("node_id").alias("source"), F.col("statement_type").alias("parent_type")), "source")
    counts = ordinary.groupBy(F.col("target").alias("node_id"), "parent_type").agg(F.count("*").alias("n"))
    allowed = types.join(policies, "statement_type").join(fallback.select(F.col("target").alias("node_id")), "node_id", "left_anti")
    met = allowed.join(counts, ["node_id", "parent_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out += [finding(met.where("n < least"), "parent-too-few", "node_id", F.concat(F.lit("parents of type "), F.col("parent_type"))), finding(met.where("n > most"), "parent-too-many", "node_id", F.concat(F.lit("parents of type "), F.col("parent_type")))]
    strange = counts.join(types, "node_id").join(policies, ["statement_type", "parent_type"], "left_anti")
    out.append(finding(strange, "parent-type", "node_id", F.concat(F.lit("parent of type "), F.col("parent_type"))))
    if most is not None:
        out.append(finding(ordinary.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("n")).where(F.col("n") > most), "parent-multiple", "node_id", "several parents"))
    return out


def parent_dispatch(edges: DataFrame, items: DataFrame, policies: DataFrame, root_types: list[str], root: str, most: int | None = None) -> list[DataFrame]:
    """Each item's parents by the one rule that holds for it: an item with a fallback edge by that of fallbacks, one of a root
    type has the root once among its ordinary parents and no other, the others by their policies. Items without a type, or of
    one without a policy, have none; a status other than the fallback's is an error on an ordinary edge.
    """
    known = items.join(policies.select("statement_type").distinct().unionByName(edges.sparkSession.createDataFrame([(t,) for t in root_types], "statement_type string")).distinct(), "statement_type", "left_semi")
    fallback = edges.where("status = 'unresolvedRootFallback'").select(F.col("target").alias("node_id")).distinct()
    plain = known.join(fallback, "node_id", "left_anti")
    is_root = F.col("statement_type").isin(*root_types) if root_types else F.lit(False)
    into = edges.join(plain.select(F.col("node_id").alias("target"), is_root.alias("__root")), "target")
    strange = finding(into.where("status IS NOT NULL"), "relationship_status_not_applicable", "edge_id", "no status of an ordinary parent")
    ordinary = into.where("status IS NULL")
    tops = ordinary.where("__root").groupBy(F.col("target").alias("node_id")).agg(F.count_if(F.col("source") == root).alias("roots"), F.count("*").alias("parents"))
    met = plain.where(is_root).join(tops, "node_id", "left").fillna(0, ["roots", "parents"])
    of_roots = finding(met.where("roots <> 1 OR parents <> 1"), "root-type-parent", "node_id", "a root type has the framework as its only parent")
    # fallback edges go along for their own rule, and for the items that it takes out
    rest = ordinary.where("NOT __root").drop("__root").unionByName(edges.join(fallback.withColumnRenamed("node_id", "target"), "target", "left_semi").select(*[c for c in ordinary.columns if c != "__root"]))
    others = parent_policy(rest, items, policies.where(~F.col("statement_type").isin(*root_types)) if root_types else policies, most, root)
    return [strange, of_roots, *others]


def hierarchy(edges: DataFrame, nodes: DataFrame, root: str) -> list[DataFrame]:
    """Cycles (nodes that peeling leaves) and nodes that the root doesn't reach."""
    start = edges.sparkSession.createDataFrame([(root,)], "node_id string")
    cycle = peel(edges).select(F.col("target").alias("node_id")).distinct()
    lost = nodes.select("node_id").join(reachable(edges, start), "node_id", "left_anti")
    return [finding(cycle, "hierarchy-cycle", "node_id", "on a cycle or below one"), finding(lost, "hierarchy-unreachable", "node_id", "not below the root")]


def orphan_components(nodes: DataFrame, supports: DataFrame) -> DataFrame:
    lost = nodes.where("kind = 'component'").join(supports.select(F.col("source").alias("node_id")), "node_id", "left_anti")
    return finding(lost, "component-orphan", "node_id", "supports no standard")


def progression_graph(edges: DataFrame, standards: DataFrame) -> list[DataFrame]:
    """Endpoints that are no standards, self loops, relatesTo not in canonical order, and pairs that two edges join."""
    # the rules meet the edges many times: they are written once, whatever view they come from
    folder = loop_dir(edges.sparkSession)
    edges, ids = cut(edges, folder, "edges"), cut(standards.select("node_id"), folder, "standards")
    pair = {"low": F.least("source", "target"), "high": F.greatest("source", "target")}
    several = cut(edges.withColumns(pair).groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1"), folder, "several")
    twice = edges.withColumns(pair).join(several, ["low", "high"])
    return [
        *[finding(edges.join(ids.withColumnRenamed("node_id", end), end, "left_anti"), f"lp-{end}", "edge_id", f"the {end} is no standard") for end in ("source", "target")],
        finding(edges.where("source = target"), "lp-self-loop", "edge_id", "source and target are the same"), finding(edges.where("label = 'relatesTo' AND source > target"), "lp-order", "edge_id", "relatesTo isn't in order of ids"), finding(twice, "lp-pair", "edge_id", "another edge joins the pair"),
    ]


def decision_counts(claims: DataFrame, decision: str = "decision") -> DataFrame:
    """(decision, n) of all four decisions, those without claims too."""
    all_four = claims.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    return all_four.join(claims.groupBy(F.col(decision).alias("decision")).agg(F.count("*").alias("n")), "decision", "left").select("decision", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def claim_endpoints(claims: DataFrame) -> DataFrame:
    """claims (first_id, second_id, decision, direction) with the source and target that they publish: in the direction's
    order for buildsTowards, in order of ids for relatesTo, none for other decisions."""
    ends = F.array("first_id", "second_id")
    pair = F.when(F.col("decision") == "buildsTowards", F.when(F.col("direction") == "second_to_first", F.reverse(ends)).otherwise(ends)).when(F.col("decision") == "relatesTo", F.sort_array(ends))
    return claims.withColumns({"source": pair[0], "target": pair[1]})


def declared_against_observed(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Files (path, sha256, size) that are missing, undeclared or different; two paths that differ in case only."""
    both = declared.select("path", F.col("sha256").alias("d_sha"), F.col("size").alias("d_size")).join(observed.select("path", F.col("sha256").alias("o_sha"), F.col("size").alias("o_size")), "path", "full_outer")
    parts = [
        finding(both.where("o_sha IS NULL"), "file-missing", "path", "declared and not there"), finding(both.where("d_sha IS NULL"), "file-undeclared", "path", "there and not declared"),
        finding(both.where("d_sha IS NOT NULL AND o_sha IS NOT NULL AND d_size <> o_size"), "file-size", "path", "another size"), finding(both.where("d_sha IS NOT NULL AND o_sha IS NOT NULL AND d_size = o_size AND d_sha <> o_sha"), "file-checksum", "path", "another checksum"),
    ]
    folded = declared.groupBy(F.lower("path").alias("path")).agg(F.count("*").alias("n")).where("n > 1")
    return report([*parts, finding(folded, "file-case", "path", "two declared paths differ in case only")])
