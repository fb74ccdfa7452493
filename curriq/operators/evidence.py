"""Rules on manifests, profiles, items, components and learning-progression evidence, each as rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curriq.operators.traversal import peel
from curriq.operators.validation import DECISIONS, claim_endpoints, decision_counts, declared_against_observed, finding


def field_equality(rows: DataFrame, record: str, pairs: dict[str, tuple[str, str]], code: str) -> DataFrame:
    """Pairs of columns (field: left, right) that have to agree, nulls with nulls: manifest, profile and root of a package."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    told = F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.concat(F.lit(f"{field}: "), text(a), F.lit(" and "), text(b))) for field, (a, b) in pairs.items()])
    return finding(rows.withColumn("__told", F.explode(F.array_compact(told))), code, record, F.col("__told"))


def item_semantics(items: DataFrame, root: DataFrame, columns: list[str], languages: list[str]) -> list[DataFrame]:
    """Items whose metadata differ from the root's one row, and languages that the profile doesn't have."""
    # one row, whatever the items
    joined = items.join(F.broadcast(root.select(*[F.col(c).alias(f"root_{c}") for c in columns]).limit(1)), F.lit(True))
    return [field_equality(joined, "node_id", {c: (c, f"root_{c}") for c in columns}, "item-metadata"), finding(items.where(~F.col("language").isin(*languages) | F.col("language").isNull()), "item-language", "node_id", "a language that the profile doesn't have")]


def root_types(edges: DataFrame, items: DataFrame, root: str) -> DataFrame:
    """Items of root types (node_id) have the framework as their parent once, and no other parent."""
    counts = edges.groupBy(F.col("target").alias("node_id")).agg(F.count_if(F.col("source") == root).alias("roots"), F.count("*").alias("parents"))
    met = items.select("node_id").join(counts, "node_id", "left").fillna(0, ["roots", "parents"])
    return finding(met.where("roots <> 1 OR parents <> 1"), "root-type-parent", "node_id", "a root type has the framework as its only parent")


def support_topology(supports: DataFrame, nodes: DataFrame, hierarchy: DataFrame) -> list[DataFrame]:
    """supports (edge_id, source, target, confidence) go from components to standards with a confidence of 0 to 1;
    components are no part of the hierarchy (source, target)."""
    kinds = lambda end: nodes.select(F.col("node_id").alias(end), F.col("kind").alias(f"{end}_kind"))
    met = supports.join(kinds("source"), "source", "left").join(kinds("target"), "target", "left")
    inside = hierarchy.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().join(nodes.where("kind = 'component'").select("node_id"), "node_id", "left_semi")
    return [
        finding(met.where("NOT (source_kind <=> 'component')"), "supports-source", "edge_id", "the source is no component"), finding(met.where("NOT (target_kind <=> 'standard')"), "supports-target", "edge_id", "the target is no standard"),
        finding(supports.where("confidence IS NULL OR NOT confidence BETWEEN 0 AND 1"), "supports-confidence", "edge_id", "no confidence from 0 to 1"), finding(inside, "component-in-hierarchy", "node_id", "a component in the hierarchy"),
    ]


def declared_counts(declared: DataFrame, observed: DataFrame, code: str = "count") -> DataFrame:
    """Counts (name, n) of a manifest or report that differ from what is there; a name on one side only counts as 0."""
    both = declared.select("name", F.col("n").alias("d")).join(observed.select("name", F.col("n").alias("o")), "name", "full_outer").fillna(0, ["d", "o"])
    return finding(both.where("d <> o"), code, "name", F.concat(F.lit("declared "), F.col("d").cast("string"), F.lit(", observed "), F.col("o").cast("string")))


def code_availability(items: DataFrame, code: str, declared: str, record: str) -> DataFrame:
    """A finding if the profile's code availability (none, partial, complete) isn't what the items show."""
    facts = items.agg(F.count("*").alias("n"), F.count(code).alias("coded")).withColumn("shown", F.when(F.col("coded") == 0, "none").when(F.col("coded") == F.col("n"), "complete").otherwise("partial"))
    return finding(facts.where(F.col("shown") != declared).withColumn("__id", F.lit(record)), "code-availability", "__id", F.concat(F.lit(f"declared {declared}, shown "), F.col("shown")))


def properties(items: DataFrame, record: str, required: list[str], forbidden: list[str]) -> list[DataFrame]:
    """Required columns that are null or blank, forbidden ones that aren't null."""
    absent = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    told = lambda names, test: F.explode(F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in names])))
    return [
        *([finding(items.withColumn("__told", told(required, absent)), "property-missing", record, F.col("__told"))] if required else []),
        *([finding(items.withColumn("__told", told(forbidden, lambda c: F.col(c).isNotNull())), "property-forbidden", record, F.col("__told"))] if forbidden else []),
    ]


def exact_cover(records: DataFrame, wanted: DataFrame, key: str, code: str) -> list[DataFrame]:
    """Provenance records cover exactly the wanted keys: those that lack one, and those that name none of them."""
    return [finding(wanted.select(key).distinct().join(records, key, "left_anti"), f"{code}-missing", key, "no record"), finding(records.select(key).distinct().join(wanted, key, "left_anti"), f"{code}-surplus", key, "a record of nothing")]


def disjoint_ids(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids of new files that are there already."""
    return finding(new.select(key).intersect(existing.select(key)), "id-taken", key, "the id is in use")


def claim_rules(claims: DataFrame) -> list[DataFrame]:
    """Final claims, published or not, each against its candidate and its trace.

    claims: pair_id, first_id, second_id, decision, direction, source, target; candidate (pair_id, first_id, second_id,
    admissible: decisions with directions) and producer (pair_id, first_id, second_id) as structs. A claim decides on its
    candidate's pair, whose ends differ, in one of the ways that the candidate admits; its ends may be in any order. Only
    buildsTowards has a direction, the published ends follow from both, and a pair, in whatever order, is decided once.
    """
    same = lambda other: F.struct("pair_id", "first_id", "second_id").eqNullSafe(F.struct(*[F.col(f"{other}.{c}") for c in ("pair_id", "first_id", "second_id")]))
    admitted = F.exists("candidate.admissible", lambda a: a["decision"].eqNullSafe(F.col("decision")) & a["direction"].eqNullSafe(F.col("direction")))
    ends = F.struct("source", "target")
    derived = claim_endpoints(claims.withColumn("own", ends))
    low, high = F.least("first_id", "second_id"), F.greatest("first_id", "second_id")
    pairs = claims.groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"), F.min("pair_id").alias("pair_id")).where("n > 1")
    ids = claims.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1")
    directed = F.col("decision") == "buildsTowards"
    return [
        finding(claims.where(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))), "claim-decision", "pair_id", "unknown decision"),
        finding(claims.where(directed != F.col("direction").isNotNull()), "lp_judgment_direction", "pair_id", "only buildsTowards has a direction"),
        finding(claims.where(~(same("candidate") & (F.col("first_id") != F.col("second_id")) & admitted)), "lp_claim_identity_mismatch", "pair_id", "not a decision that the candidate pair admits"),
        finding(derived.where(~F.col("own").eqNullSafe(ends)), "lp_claim_endpoint_mismatch", "pair_id", "ends don't follow from decision and direction"),
        finding(claims.where(~same("producer")), "lp_trace_identity_mismatch", "pair_id", "the producer judged another pair"),
        finding(pairs, "lp_final_pair_conflict", "pair_id", "several claims of a pair"), finding(ids, "lp_final_pair_conflict", "pair_id", "several claims of a pair id"),
    ]


def review_rules(claims: DataFrame, unresolved: DataFrame, declared: DataFrame, content: str = "content") -> list[DataFrame]:
    """The excluded claims (unresolved: pair_id, content) are those that need review, value for value and as often; and
    declared counts (name: total_needs_review, total_claims and the four decisions; n) are the claims'."""
    times = lambda rows, n: rows.groupBy("pair_id", F.sha2(F.col(content).cast("binary"), 256).alias("hash")).agg(F.count("*").alias(n))
    review = claims.where("decision = 'needs_review'")
    met = times(review, "n").join(times(unresolved, "m"), ["pair_id", "hash"], "full_outer").where("NOT (n <=> m)").select("pair_id").distinct()
    totals = claims.agg(F.count("*").alias("c"), F.count_if(F.col("decision") == "needs_review").alias("r")).select(F.expr("stack(2, 'total_claims', c, 'total_needs_review', r) AS (name, n)"))
    observed = decision_counts(claims).withColumnRenamed("decision", "name").unionByName(totals)
    return [finding(met, "lp_unresolved_mismatch", "pair_id", "not in review and excluded alike"), declared_counts(declared, observed, "lp_final_counts_mismatch")]


def credit(edges: DataFrame, roots: DataFrame, provenance: DataFrame, generator: str, approver: str, template: str) -> DataFrame:
    """Edges whose credit isn't that of their generator and of their framework's root.

    edges: edge_id, package_id, label, source, target, author, provider, license, attribution_statement. roots, a row a
    package: package_id, and name, author, provider, license, attribution_statement, case_identifier_uuid. provenance:
    edge_id, doc_key, identity_key, approved_by, template and source, a struct of the root's fields (its name as title).
    The template's {source_attribution_statement} stands for the root's statement.
    """
    if template.count("{source_attribution_statement}") != 1:
        raise ValueError("the template names the source's statement once")
    fields = ("attribution_statement", "author", "case_identifier_uuid", "license", "provider", "title")
    root = roots.select("package_id", F.struct(*[F.col("name" if f == "title" else f).alias(f) for f in fields]).alias("root"))
    before, after = template.split("{source_attribution_statement}")
    own = edges.join(root, "package_id", "left").join(provenance.withColumnRenamed("source", "__source"), "edge_id", "left")
    identity = F.concat(F.lit("lc:curriculum:"), F.col("doc_key"), F.lit(":relationship:"), F.col("label"), F.lit(":"), F.col("source"), F.lit(":"), F.col("target"))
    wanted = {
        **{f"source {f}": (F.col("__source")[f], F.col("root")[f]) for f in fields}, "identity key": (F.col("identity_key"), identity), "approval": (F.col("approved_by"), F.lit(approver)), "provider": (F.col("provider"), F.lit(approver)),
        "author": (F.col("author"), F.lit(generator)), "license": (F.col("license"), F.col("root.license")), "template": (F.col("template"), F.lit(template)),
        "statement": (F.col("attribution_statement"), F.concat(F.lit(before), F.col("root.attribution_statement"), F.lit(after))),
    }
    told = F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in wanted.items()]))
    return finding(own.withColumn("__told", told).where(F.size("__told") > 0), "lp_source_credit_mismatch", "edge_id", F.array_join("__told", ", "))


def shard_index(declared: DataFrame, observed: DataFrame, shards: int = 64) -> list[DataFrame]:
    """A partition index (bucket, n, sha256) against the shards' own digests: missing or surplus shards, counts, digests."""
    both = declared.select("bucket", F.col("n").alias("dn"), F.col("sha256").alias("dh")).join(observed.select("bucket", F.col("n").alias("on"), F.col("sha256").alias("oh")), "bucket", "full_outer")
    return [
        finding(both.where(f"dn IS NULL OR on IS NULL OR NOT bucket BETWEEN 0 AND {shards - 1}"), "shard-missing", "bucket", "declared and there don't fit"),
        finding(both.where("dn <> on"), "shard-count", "bucket", "another number of entries"), finding(both.where("dn = on AND dh <> oh"), "shard-digest", "bucket", "another digest"),
    ]


def shared_metadata(packages: DataFrame, columns: list[str]) -> DataFrame:
    """Snapshots whose packages differ in metadata."""
    seen = packages.groupBy("snapshot_id").agg(F.count_distinct(F.struct(*columns)).alias("n"))
    return finding(seen.where("n > 1"), "snapshot-metadata", "snapshot_id", "packages of the snapshot differ")


def directory_identity(manifests: DataFrame) -> DataFrame:
    """Manifests whose directory (framework_id/snapshot_id) isn't what they say."""
    own = F.concat_ws("/", "framework_id", "snapshot_id")
    return finding(manifests.where(~F.col("directory").eqNullSafe(own)), "package-directory", "package_id", F.concat(F.lit("expected "), own))


def topology_counts(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """A report's counts (name, n) against edges (source, target) that have to be without cycles: graph_edges, graph_nodes,
    and cyclic_edges and cyclic_nodes, which have to be declared as 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    facts = edges.agg(F.count("*").alias("e")).join(ends.agg(F.count_distinct("node_id").alias("v")), F.lit(True))  # one row each
    return declared_counts(declared, facts.select(F.expr("stack(4, 'graph_edges', e, 'graph_nodes', v, 'cyclic_edges', 0L, 'cyclic_nodes', 0L) AS (name, n)")), "topology-count")


def topology_cycles(edges: DataFrame) -> DataFrame:
    """Edges (edge_id, source, target) that `peel` leaves: on a cycle or below one."""
    return finding(edges.join(peel(edges).distinct(), ["source", "target"], "left_semi"), "topology-cycle", "edge_id", "on a cycle or below one")


def normalized_delivery(delivery: DataFrame, prefix: DataFrame, suffix: DataFrame, types: tuple[str, ...] = ("hasChild", "supports")) -> list[DataFrame]:
    """A delivery's lines (line, label, edge_id, value) against the lines of its hierarchy part (line, label, value), which
    come first and unchanged, and the canonical progression lines (label, edge_id, value), which follow by (label, edge_id).

    Lines are met by number and by value, and each by the number after it, so no task sees the whole delivery.
    """
    # one row: where the progression part starts
    start = F.broadcast(prefix.agg(F.coalesce(F.max("line") + 1, F.lit(0)).alias("start")))
    placed = delivery.join(start, F.lit(True))
    first = placed.where("line < start").select("line", F.col("value").alias("there"))
    changed = prefix.join(first, "line", "left").where(~F.col("value").eqNullSafe(F.col("there")))
    rest = placed.where("line >= start").select("line", "label", "edge_id", "value")
    keys = ["label", "edge_id", "value"]
    there, wanted = rest.groupBy(*keys).agg(F.count("*").alias("n")), suffix.groupBy(*keys).agg(F.count("*").alias("m"))
    both = there.join(wanted, keys, "full_outer").fillna(0, ["n", "m"])
    after = rest.select((F.col("line") - 1).alias("line"), F.struct("label", "edge_id").alias("next"))
    turned = rest.join(after, "line").where(F.struct("label", "edge_id") > F.col("next"))
    return [
        finding(changed, "delivery-prefix", "line", "the hierarchy part's line isn't there"), finding(prefix.where(~F.col("label").isin(*types) | F.col("label").isNull()), "delivery-prefix-type", "line", "no line of the hierarchy part"),
        finding(both.where("n < m"), "delivery-missing", "edge_id", "the canonical line isn't there"), finding(both.where("n > m"), "delivery-surplus", "edge_id", "no canonical line"), finding(turned, "delivery-order", "line", "the next line comes before it"),
    ]


def archive(record: dict[str, str], package: dict[str, str], declared: DataFrame, observed: DataFrame) -> DataFrame:
    """An evidence archive: the record's fields against the package's, then its files (path, sha256, size) against those there."""
    spark = declared.sparkSession
    names = sorted(set(record) | set(package))
    fields = spark.createDataFrame([(n, record.get(n), package.get(n)) for n in names], "field string, recorded string, own string")
    told = F.concat(F.coalesce("recorded", F.lit("null")), F.lit(" and "), F.coalesce("own", F.lit("null")))
    return finding(fields.where(~F.col("recorded").eqNullSafe(F.col("own"))), "archive-record", "field", told).unionByName(declared_against_observed(declared, observed))


def slim_derivation(shipped: DataFrame, derived: DataFrame, key: str) -> list[DataFrame]:
    """Shipped slim records against those derived anew from the full ones: keys on one side only, and other values."""
    columns = [c for c in derived.columns if c != key]
    packed = lambda rows, name: rows.select(key, F.struct(*columns).alias(name))
    met = packed(shipped, "own").join(packed(derived, "anew"), key)
    return [*exact_cover(shipped, derived, key, "slim"), finding(met.where(~F.col("own").eqNullSafe(F.col("anew"))), "slim-derivation", key, "differs from its derivation")]


def slim_records(records: DataFrame, edges: DataFrame, doc_key: str) -> list[DataFrame]:
    """Slim records (edge_id, decision, source_uuid, target_uuid, identity_key) against their edges (edge_id, label, source,
    target): exactly one for each edge, its decision the label, its ends the edge's, its key made of both."""
    met = edges.join(records, "edge_id")
    identity = F.concat_ws(":", F.lit(f"lc:curriculum:{doc_key}:relationship"), "label", "source", "target")
    same = F.col("decision").eqNullSafe(F.col("label")) & F.col("source_uuid").eqNullSafe(F.col("source")) & F.col("target_uuid").eqNullSafe(F.col("target")) & F.col("identity_key").eqNullSafe(identity)
    twice = records.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1")
    return [*exact_cover(records, edges, "edge_id", "slim-record"), finding(met.where(~same), "slim-record-mismatch", "edge_id", "decision, ends or key aren't the edge's"), finding(twice, "slim-record-twice", "edge_id", "several records of an edge")]
