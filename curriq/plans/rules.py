"""Queries on scopes, choice of packages, validation rules and evidence, over the relational tables and with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curriq.functions.text import CodeRules
from curriq.operators import evidence, progressions, scopes, search, statistics, traversal, validation
from curriq.plans import views as V
from curriq.plans.registry import query
from curriq.session import cut, loop_dir, table
from curriq.sources.packages import slim

RULES = CodeRules()
TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}]+')"


def _findings(parts: list[DataFrame]) -> DataFrame:
    return validation.report(parts).select("code", "record_id", "message")


def _typed_nodes(spark, sf) -> DataFrame:
    """Nodes of the supplier hierarchy with their statement types."""
    of = lambda name, letter, key, kind: table(spark, sf, name).select(V.ident(letter, key).alias("node_id"), F.lit(kind).alias("statement_type"))
    return of("region", "R", "r_regionkey", "REGION").unionByName(of("nation", "N", "n_nationkey", "NATION")).unionByName(of("supplier", "S", "s_suppkey", "SUPPLIER")).unionByName(of("part", "P", "p_partkey", "PART"))


SCOPES = f"""{V.DAG}, {V.PARTS},
near AS (SELECT DISTINCT p.target AS node_id, 'NATION' AS scope_type, s.source AS scope_id FROM dag p JOIN dag s ON s.target = p.source WHERE p.target LIKE 'P:%'
  UNION SELECT DISTINCT p.target, 'REGION', n.source FROM dag p JOIN dag s ON s.target = p.source JOIN dag n ON n.target = s.source WHERE p.target LIKE 'P:%'),
asked AS (SELECT node_id, t AS scope_type FROM parts, (SELECT unnest(['NATION', 'REGION']) AS t))"""


def _scopes(spark, sf, *types: str) -> DataFrame:
    wanted = spark.createDataFrame([(t,) for t in types], "scope_type string")
    return scopes.nearest_scopes(V.dag(spark, sf), _typed_nodes(spark, sf), V.part_nodes(spark, sf), wanted, missing_ok=True)


@query(f"WITH {SCOPES} SELECT a.node_id, a.scope_type, n.scope_id FROM asked a LEFT JOIN near n USING (node_id, scope_type)")
def code_scope_nearest(spark, sf):
    return _scopes(spark, sf, "NATION", "REGION")


@query(f"""
WITH RECURSIVE {SCOPES}, u AS (SELECT source, target FROM dag UNION ALL SELECT 'P:3', 'P:4' UNION ALL SELECT 'P:4', 'P:3'),
c(a, node) AS (SELECT source, target FROM u WHERE source IN ('P:3', 'P:4') UNION SELECT a, target FROM c JOIN u ON source = node),
stuck AS (SELECT node AS node_id FROM c WHERE a IN (SELECT a FROM c WHERE node = a))
SELECT 'scope-missing' AS problem, a.node_id, a.scope_type FROM asked a WHERE a.node_id NOT IN (SELECT node_id FROM stuck) AND NOT EXISTS (SELECT 1 FROM near n WHERE n.node_id = a.node_id AND n.scope_type = a.scope_type)
UNION ALL SELECT 'scope-cycle', a.node_id, a.scope_type FROM asked a WHERE a.node_id IN (SELECT node_id FROM stuck)""")
def code_scope_errors(spark, sf):
    """Parts 3 and 4 stand above each other; parts that nobody sells have no nation and no region."""
    wanted = spark.createDataFrame([("NATION",), ("REGION",)], "scope_type string")
    loop = spark.createDataFrame([("h:a", "P:3", "P:4", 0), ("h:b", "P:4", "P:3", 0)], "edge_id string, source string, target string, seo long")
    return scopes.scope_problems(V.dag(spark, sf).unionByName(loop), _typed_nodes(spark, sf), V.part_nodes(spark, sf), wanted)


INDEX = f"""{SCOPES}, own AS (SELECT p.node_id, p.p_type AS statement_type, lower(p.brand) AS normalized_code, coalesce(string_agg(DISTINCT 'REGION=' || n.scope_id, ',' ORDER BY 'REGION=' || n.scope_id), '') AS scope_key
  FROM parts p LEFT JOIN near n ON n.node_id = p.node_id AND n.scope_type = 'REGION' GROUP BY ALL),
idx AS (SELECT statement_type, scope_key, normalized_code, count(*) AS nodes, min(node_id) AS first_node FROM own GROUP BY ALL)"""


def _index(spark, sf) -> DataFrame:
    parts = V.part_nodes(spark, sf).select("node_id", F.col("p_type").alias("statement_type"), F.col("brand").alias("code"))
    return scopes.code_index(parts.join(_scopes(spark, sf, "REGION"), "node_id"), RULES)


@query(f"WITH {INDEX} SELECT * FROM idx")
def code_index(spark, sf):
    return _index(spark, sf)


@query(f"WITH {INDEX} SELECT * FROM idx WHERE nodes > 1")
def code_scoped_uniqueness(spark, sf):
    return scopes.scoped_duplicates(_index(spark, sf))


PACKAGES = """
packages AS (SELECT source || '/' || lang AS package_id, source AS framework_id, source || '@' || lang AS snapshot_id, CASE WHEN min(doc_id) % 3 = 0 THEN 'curriculum' ELSE 'progression' END AS graph_type,
  lang = min(min(lang)) OVER (PARTITION BY source) AS is_current, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'passed' END AS status, [CASE WHEN max(n_chars) > 4000 THEN 'Long  TEXT' ELSE 'short text' END, lang] AS subjects, count(*) AS n FROM documents GROUP BY source, lang)"""


def _packages(spark, sf) -> DataFrame:
    """A package for each source and language of the documents; a source's first language is current."""
    groups = table(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("k"), F.max("n_chars").alias("longest"), F.count("*").alias("n"))
    first = groups.groupBy("source").agg(F.min("lang").alias("first"))
    return groups.join(first, "source").select(
        F.concat_ws("/", "source", "lang").alias("package_id"), F.col("source").alias("framework_id"), F.concat_ws("@", "source", "lang").alias("snapshot_id"), F.when(F.col("k") % 3 == 0, "curriculum").otherwise("progression").alias("graph_type"),
        (F.col("lang") == F.col("first")).alias("is_current"), F.when(F.col("n") % 5 == 0, "failed").otherwise("passed").alias("status"), F.array(F.when(F.col("longest") > 4000, "Long  TEXT").otherwise("short text"), F.col("lang")).alias("subjects"), "n",
    )


@query(f"WITH {PACKAGES} SELECT package_id, graph_type, status, n FROM packages WHERE NOT is_current AND graph_type = 'progression' AND status = 'passed' AND list_has_any(list_transform(subjects, lambda x: lower(x)), ['long  text', 'fr'])")
def catalog_facets(spark, sf):
    found = scopes.filter_packages(_packages(spark, sf), current=False, graph_types=["progression"], statuses=["passed"], metadata={"subjects": [" LONG text", "FR"]})
    return found.select("package_id", "graph_type", "status", "n")


@query(f"WITH {PACKAGES} SELECT package_id FROM packages WHERE graph_type = 'curriculum' AND snapshot_id LIKE '%@en'")
def package_scope(spark, sf):
    packages = _packages(spark, sf)
    names = [r[0] for r in packages.where(F.col("snapshot_id").endswith("@en")).select("snapshot_id").distinct().collect()]  # catalog names
    return scopes.select_packages(packages, graph_types=["curriculum"], snapshots=names).select("package_id")


@query(f"""
WITH {PACKAGES}, named AS (SELECT DISTINCT framework_id, snapshot_id, subjects FROM packages WHERE snapshot_id LIKE '%@fr'),
rest AS (SELECT DISTINCT framework_id, snapshot_id, subjects FROM packages WHERE is_current AND framework_id NOT IN (SELECT framework_id FROM named))
SELECT framework_id, snapshot_id, explicit FROM (SELECT *, TRUE AS explicit FROM named UNION ALL SELECT *, FALSE FROM rest) WHERE list_contains(subjects, 'Long  TEXT')""")
def snapshots_for_search(spark, sf):
    packages = _packages(spark, sf)
    named = [r[0] for r in packages.where(F.col("snapshot_id").endswith("@fr")).select("snapshot_id").distinct().collect()]  # catalog names
    return scopes.resolve_snapshots(packages, [], named, {"subjects": ["long text"]})


@query(f"""
WITH {PACKAGES}, d AS (SELECT doc_id, source || '/' || lang AS package_id, {TOKENS} AS t FROM documents)
SELECT p.package_id, count(d.doc_id) AS hits, CASE WHEN p.status = 'failed' THEN 'text_unavailable' WHEN count(d.doc_id) = 0 THEN 'no_match' END AS warning
FROM packages p LEFT JOIN d ON d.package_id = p.package_id AND p.status = 'passed' AND list_contains(t, 'and') AND list_contains(t, 'the') GROUP BY p.package_id, p.status""")
def federated_search(spark, sf):
    packages = _packages(spark, sf).select("package_id", "status")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("package_id"))
    # packages without text search are skipped and warned of
    searched = docs.join(packages.where("status = 'passed'").select("package_id"), "package_id", "left_semi")
    hits = search.token_search(searched, "text", "the and", every=True, keep=("package_id",)).groupBy("package_id").agg(F.count("*").alias("hits"))
    met = packages.join(hits, "package_id", "left").fillna(0, ["hits"])
    return met.select("package_id", "hits", F.when(F.col("status") == "failed", "text_unavailable").when(F.col("hits") == 0, "no_match").alias("warning"))


@query("""
SELECT DISTINCT source || '/' || lang AS package_id, CASE WHEN n_chars = 0 THEN 'text_missing' WHEN n_chars > 5000 THEN 'text_long' ELSE 'text_short' END AS code, NULL::VARCHAR AS node_id, 'documents of ' || lang AS message FROM documents WHERE n_chars > 5000 OR n_chars < 200""")
def search_warnings(spark, sf):
    docs = table(spark, sf, "documents").where("n_chars > 5000 OR n_chars < 200")
    code = F.when(F.col("n_chars") == 0, "text_missing").when(F.col("n_chars") > 5000, "text_long").otherwise("text_short")
    return scopes.ordered_warnings(docs.select(F.concat_ws("/", "source", "lang").alias("package_id"), code.alias("code"), F.lit(None).cast("string").alias("node_id"), F.concat(F.lit("documents of "), "lang").alias("message")))


@query(f"""
WITH d AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS t FROM conversations), m AS (SELECT conv_id, turn, list_filter(['a', 'and', 'how', 'the'], lambda x: list_contains(t, x)) AS k FROM d)
SELECT conv_id, turn, (1000000 * len(k) // 4)::BIGINT AS score, array_to_string(k, ',') AS matched_terms FROM m WHERE len(k) > 0""")
def component_text(spark, sf):
    return search.token_search(table(spark, sf, "conversations"), "text", "how and the a", keep=("conv_id", "turn"), most=None)


@query(f"""
WITH d AS (SELECT doc_id, list_distinct({TOKENS}) AS t FROM documents), m AS (SELECT doc_id, list_filter(['der', 'the', 'und'], lambda x: list_contains(t, x)) AS k FROM d)
SELECT doc_id, (1000000 * len(k) // 3)::BIGINT AS score, array_to_string(k, ',') AS matched_terms FROM m WHERE len(k) > 0""")
def text_postings(spark, sf):
    index = search.write_postings(table(spark, sf, "documents"), "doc_id", "text", f"{loop_dir(spark)}/postings")
    return search.posting_search(index, "doc_id", "und THE der")


ASKED = [("node_id", "P:7"), ("node_id", "P:-1"), ("case_uuid", "part 3"), ("case_uri", "brand:Brand.1"), ("code", " BRAND.3 .5"), ("code", "Brand.999")]


@query("""
WITH n AS (SELECT 'P:' || p_partkey AS node_id, 'part ' || p_partkey AS case_uuid, 'brand:' || replace(p_brand, '#', '.') AS case_uri, lower(replace(p_brand, '#', '.')) || '.' || p_size AS code FROM part),
a(kind, value, key) AS (VALUES ('node_id', 'P:7', 'P:7'), ('node_id', 'P:-1', 'P:-1'), ('case_uuid', 'part 3', 'part 3'), ('case_uri', 'brand:Brand.1', 'brand:Brand.1'), ('code', ' BRAND.3 .5', 'brand.3.5'), ('code', 'Brand.999', 'brand.999')),
m AS (SELECT a.kind, a.value, count(n.node_id) AS nodes, min(n.node_id) AS first_node FROM a LEFT JOIN n ON a.key = CASE a.kind WHEN 'node_id' THEN n.node_id WHEN 'case_uuid' THEN n.case_uuid WHEN 'case_uri' THEN n.case_uri ELSE n.code END GROUP BY ALL)
SELECT kind, value, nodes, CASE WHEN nodes = 1 THEN first_node END AS node_id, CASE nodes WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS result FROM m""")
def standard_selector(spark, sf):
    nodes = V.part_nodes(spark, sf).select("node_id", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("case_uuid"), F.concat(F.lit("brand:"), "brand").alias("case_uri"), "code")
    return scopes.resolve_selectors(spark.createDataFrame(ASKED, "kind string, value string"), nodes, RULES)


# ---- Validation ------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT 'S:' || s_suppkey AS id, s_name AS a, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) ELSE s_name END AS b, s_nationkey::VARCHAR AS c, CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey::VARCHAR END AS d FROM supplier)
SELECT 'profile-root' AS code, id AS record_id, 'name: ' || a || ' and ' || b AS message FROM r WHERE a <> b UNION ALL SELECT 'profile-root', id, 'jurisdiction: ' || c || ' and null' FROM r WHERE d IS NULL""")
def findings_root(spark, sf):
    rows = table(spark, sf, "supplier").select(V.ident("S", "s_suppkey").alias("id"), F.col("s_name").alias("root_name"), F.when(F.col("s_suppkey") % 4 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("profile_name"), F.col("s_nationkey").alias("root_nation"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_nationkey")).alias("profile_nation"))
    return _findings([evidence.field_equality(rows, "id", {"name": ("root_name", "profile_name"), "jurisdiction": ("root_nation", "profile_nation")}, "profile-root")])


@query("""
SELECT 'item-metadata' AS code, doc_id::VARCHAR AS record_id, 'source: ' || source || ' and ' || (SELECT min(source) FROM documents) AS message FROM documents WHERE source <> (SELECT min(source) FROM documents)
UNION ALL SELECT 'item-language', doc_id::VARCHAR, 'a language that the profile doesn''t have' FROM documents WHERE lang NOT IN ('en', 'fr')""")
def findings_items(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "source", F.col("lang").alias("language"))
    return _findings(evidence.item_semantics(items, items.agg(F.min("source").alias("source")), ["source"], ["en", "fr"]))


@query(f"""
WITH {V.DAG}, c AS (SELECT 'P:' || p_partkey AS node_id, count(d.edge_id) AS parents, count(d.edge_id) FILTER (WHERE d.source = 'S:1') AS roots FROM part LEFT JOIN dag d ON d.target = 'P:' || p_partkey WHERE p_type = 'STANDARD' GROUP BY p_partkey)
SELECT 'root-type-parent' AS code, node_id AS record_id, 'a root type has the framework as its only parent' AS message FROM c WHERE roots <> 1 OR parents <> 1""")
def findings_root_types(spark, sf):
    return _findings([evidence.root_types(V.dag(spark, sf), V.part_nodes(spark, sf).where("p_type = 'STANDARD'"), "S:1")])


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT 'supports-source' AS code, count(*)::BIGINT AS n FROM s WHERE o % 7 = 0 UNION ALL SELECT 'supports-target', count(*)::BIGINT FROM s WHERE p % 9 = 0
UNION ALL SELECT 'supports-confidence', count(*)::BIGINT FROM s WHERE o % 11 = 0 UNION ALL SELECT 'component-in-hierarchy', count(*)::BIGINT FROM orders WHERE o_orderkey % 7 <> 0""")
def findings_supports(spark, sf):
    orders = table(spark, sf, "orders").select(V.ident("O", "o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 7 == 0, "standard").otherwise("component").alias("kind"))
    parts = table(spark, sf, "part").select(V.ident("P", "p_partkey").alias("node_id"), F.when(F.col("p_partkey") % 9 == 0, "component").otherwise("standard").alias("kind"))
    supports = V.supports(spark, sf).select("edge_id", F.col("component").alias("source"), F.col("standard").alias("target"), F.when(F.col("l_orderkey") % 11 != 0, F.col("confidence")).alias("confidence"))
    hierarchy = V.tree(spark, sf).select("source", "target")
    found = validation.report(evidence.support_topology(supports, orders.unionByName(parts), hierarchy))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT name, n + CASE WHEN name = 'F' THEN 1 ELSE 0 END AS n FROM o WHERE name <> 'P' UNION ALL SELECT 'X', 3)
SELECT 'report-count' AS code, coalesce(d.name, o.name) AS record_id, 'declared ' || coalesce(d.n, 0) || ', observed ' || coalesce(o.n, 0) AS message FROM d FULL JOIN o ON d.name = o.name WHERE coalesce(d.n, 0) <> coalesce(o.n, 0)
UNION ALL SELECT 'code-availability', 'profile', 'declared complete, shown partial'""")
def findings_counts(spark, sf):
    observed = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))
    declared = observed.where("name <> 'P'").select("name", F.when(F.col("name") == "F", F.col("n") + 1).otherwise(F.col("n")).alias("n")).unionByName(spark.createDataFrame([("X", 3)], "name string, n long"))
    items = V.part_nodes(spark, sf).withColumn("coded", F.when(F.col("p_partkey") % 2 == 0, F.col("code")))
    return _findings([evidence.declared_counts(declared, observed, "report-count"), evidence.code_availability(items, "coded", "complete", "profile")])


@query("""
SELECT 'property-missing' AS code, o_orderkey::VARCHAR AS record_id, 'priority' AS message FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT') UNION ALL SELECT 'property-forbidden', o_orderkey::VARCHAR, 'status' FROM orders WHERE o_orderstatus = 'P'""")
def findings_components(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", " ").when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")).alias("status"))
    return _findings(evidence.properties(rows, "o_orderkey", ["priority"], ["status"]))


CLAIMS = f"""{V.BUILDS},
c AS (SELECT s, t, 'c:' || s || '>' || t AS pair_id, 'P:' || s AS f, 'P:' || t AS g, CASE s % 4 WHEN 0 THEN 'relatesTo' WHEN 1 THEN 'no_relation' WHEN 2 THEN 'needs_review' ELSE 'buildsTowards' END AS decision, CASE WHEN s % 4 = 3 OR t % 19 = 0 THEN CASE WHEN t % 2 = 0 THEN 'first_to_second' ELSE 'second_to_first' END END AS direction FROM bt)"""


def _claims(spark, sf) -> DataFrame:
    """A claim on each pair of parts; every 19th part has claims with a direction, whatever they decide, every 23rd candidates
    that admit one decision less, every 29th other ends, every 31st a producer of another pair; part 5's are there again, turned."""
    edges = cut(V.builds_towards(spark, sf).select("s", "t", "source", "target"), loop_dir(spark), "edges")
    kind = F.col("s") % 4
    decision = F.when(kind == 0, "relatesTo").when(kind == 1, "no_relation").when(kind == 2, "needs_review").otherwise("buildsTowards")
    direction = F.when((kind == 3) | (F.col("t") % 19 == 0), F.when(F.col("t") % 2 == 0, "first_to_second").otherwise("second_to_first"))
    both = edges.select("s", "t", F.concat(F.lit("c:"), F.col("s").cast("string"), F.lit(">"), F.col("t").cast("string")).alias("pair_id"), F.col("source").alias("first_id"), F.col("target").alias("second_id"), decision.alias("decision"), direction.alias("direction"))
    turned = both.where("s = 5").select("s", "t", F.concat("pair_id", F.lit("!")).alias("pair_id"), F.col("second_id").alias("first_id"), F.col("first_id").alias("second_id"), "decision", "direction")
    ends = validation.claim_endpoints(both.unionByName(turned))
    own = [F.col(c) for c in ("first_id", "second_id")]
    admissible = F.array(F.struct(F.col("decision"), F.col("direction")), F.struct(F.lit("needs_review").alias("decision"), F.lit(None).cast("string").alias("direction")))
    ends = ends.withColumn("candidate", F.struct("pair_id", *own, F.when(F.col("t") % 23 != 0, admissible).otherwise(F.slice(admissible, 2, 1)).alias("admissible")))
    ends = ends.withColumn("producer", F.struct(F.when(F.col("t") % 31 == 0, "x").otherwise(F.col("pair_id")).alias("pair_id"), *own))
    return ends.withColumn("source", F.when(F.col("t") % 29 == 0, "nobody").otherwise(F.col("source")))


@query(f"""
WITH {CLAIMS}, e AS (SELECT * FROM c UNION ALL SELECT s, t, pair_id || '!', g, f, decision, direction FROM c WHERE s = 5)
SELECT 'lp_judgment_direction' AS code, pair_id AS record_id FROM e WHERE t % 19 = 0 AND s % 4 <> 3 UNION ALL SELECT 'lp_claim_identity_mismatch', pair_id FROM e WHERE t % 23 = 0 AND NOT (s % 4 = 2 AND t % 19 <> 0)
UNION ALL SELECT 'lp_claim_endpoint_mismatch', pair_id FROM e WHERE t % 29 = 0 UNION ALL SELECT 'lp_trace_identity_mismatch', pair_id FROM e WHERE t % 31 = 0
UNION ALL SELECT 'lp_final_pair_conflict', pair_id FROM c WHERE s = 5
UNION ALL SELECT 'lp_unresolved_mismatch', pair_id FROM e WHERE decision = 'needs_review' AND t % 13 = 0
UNION ALL SELECT 'lp_final_counts_mismatch', 'no_relation' UNION ALL SELECT 'lp_final_counts_mismatch', 'total_needs_review' WHERE EXISTS (SELECT 1 FROM e WHERE decision = 'needs_review' AND t % 13 = 0)
UNION ALL SELECT 'provenance-missing', edge_id FROM bt WHERE s % 13 = 0 UNION ALL SELECT 'provenance-surplus', 'x:1' UNION ALL SELECT 'id-taken', edge_id FROM bt WHERE s = 2""")
def findings_evidence(spark, sf):
    claims = cut(_claims(spark, sf).withColumn("content", F.to_json(F.struct("pair_id", "first_id", "second_id", "decision"))), loop_dir(spark), "claims")
    excluded = claims.where("decision = 'needs_review' AND t % 13 <> 0")
    declared = claims.groupBy(F.col("decision").alias("name")).agg(F.count("*").alias("n")).withColumn("n", F.col("n") + (F.col("name") == "no_relation").cast("long"))
    totals = claims.agg(F.count("*").alias("n")).select(F.lit("total_claims").alias("name"), "n").unionByName(excluded.agg(F.count("*").alias("n")).select(F.lit("total_needs_review").alias("name"), "n"))
    edges = V.builds_towards(spark, sf)
    records = edges.where("s % 13 <> 0").select("edge_id").unionByName(spark.createDataFrame([("x:1",)], "edge_id string"))
    found = [*evidence.claim_rules(claims), *evidence.review_rules(claims, excluded, declared.unionByName(totals)), *evidence.exact_cover(records, edges.select("edge_id"), "edge_id", "provenance"), evidence.disjoint_ids(edges, edges.where("s = 2"), "edge_id")]
    return validation.report(found).select("code", "record_id")


CREDIT = "Made by a model. Source: {source_attribution_statement}. Not endorsed."


@query(f"""
WITH {V.BUILDS}, k AS (SELECT edge_id, concat_ws(', ', CASE WHEN s % 11 = 0 THEN 'source title' END, CASE WHEN s % 7 = 0 THEN 'identity key' END, CASE WHEN t % 9 = 0 THEN 'author' END, CASE WHEN t % 10 = 0 THEN 'statement' END) AS message FROM bt)
SELECT 'lp_source_credit_mismatch' AS code, edge_id AS record_id, message FROM k WHERE message <> ''""")
def findings_credit(spark, sf):
    """The framework of a progression edge is its source part's brand; every few edges have one field wrong."""
    joined = V.builds_towards(spark, sf).join(V.part_nodes(spark, sf).select("p_partkey", F.col("brand").alias("package_id")), F.col("p_partkey") == F.col("s"))
    roots = V.part_nodes(spark, sf).select(F.col("brand").alias("package_id")).distinct().select("package_id", F.concat(F.lit("Framework "), "package_id").alias("name"), F.lit("board").alias("author"), F.lit("ministry").alias("provider"), F.lit("open").alias("license"), F.concat(F.lit("by "), "package_id").alias("attribution_statement"), F.sha2(F.col("package_id").cast("binary"), 256).alias("case_identifier_uuid"))
    own = F.regexp_replace(F.lit(CREDIT), r"\{.*\}", F.concat(F.lit("by "), F.col("package_id")))
    edges = joined.select("edge_id", "package_id", "label", "source", "target", F.when(F.col("t") % 9 == 0, "board").otherwise("model").alias("author"), F.lit("maker").alias("provider"), F.lit("open").alias("license"), F.when(F.col("t") % 10 == 0, CREDIT).otherwise(own).alias("attribution_statement"))
    key = F.concat_ws(":", F.lit("lc:curriculum:K:relationship"), "label", "source", F.when(F.col("s") % 7 == 0, "x").otherwise(F.col("target")))
    title = F.when(F.col("s") % 11 == 0, "?").otherwise(F.col("name")).alias("title")
    source = F.struct("attribution_statement", "author", "case_identifier_uuid", "license", "provider", title)
    provenance = joined.join(roots, "package_id").select("edge_id", F.lit("K").alias("doc_key"), key.alias("identity_key"), F.lit("maker").alias("approved_by"), F.lit(CREDIT).alias("template"), source.alias("source"))
    return _findings([evidence.credit(edges, roots, provenance, "model", "maker", CREDIT)])


@query("""
WITH m AS (SELECT (('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::BIGINT % 64)::BIGINT AS bucket FROM documents), o AS (SELECT bucket, count(*) AS n FROM m GROUP BY bucket)
SELECT 'shard-count' AS code, bucket::VARCHAR AS record_id FROM o WHERE bucket % 8 = 1 UNION ALL SELECT 'shard-digest', bucket::VARCHAR FROM o WHERE bucket % 8 = 2 UNION ALL SELECT 'shard-missing', bucket::VARCHAR FROM o WHERE bucket % 8 = 3 UNION ALL SELECT 'shard-missing', '64'""")
def findings_shards(spark, sf):
    observed = cut(statistics.bucketed_digest(table(spark, sf, "documents"), "doc_id", "text"), loop_dir(spark), "digests")
    kind = F.col("bucket") % 8
    declared = observed.where(kind != 3).select("bucket", F.when(kind == 1, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(kind == 2, "0").otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([(64, 1, "0")], "bucket long, n long, sha256 string"))
    return validation.report(evidence.shard_index(declared, observed)).select("code", "record_id")


@query(f"WITH {PACKAGES} SELECT 'snapshot-metadata' AS code, framework_id AS record_id FROM packages GROUP BY framework_id HAVING count(DISTINCT (graph_type, status)) > 1 UNION ALL SELECT 'package-directory', package_id FROM packages WHERE NOT is_current")
def findings_packages(spark, sf):
    packages = _packages(spark, sf)
    families = packages.withColumn("snapshot_id", F.col("framework_id"))
    placed = packages.withColumn("directory", F.concat_ws("/", "framework_id", F.when(F.col("is_current"), F.col("snapshot_id")).otherwise(F.lit("elsewhere"))))
    return validation.report([evidence.shared_metadata(families, ["graph_type", "status"]), evidence.directory_identity(placed)]).select("code", "record_id")


# ---- Projections -----------------------------------------------------------------------------------------------


@query("SELECT source AS section, lang AS key, count(*) AS n FROM documents GROUP BY source, lang")
def coverage_projection(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    sections = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))
    report = sections.agg(F.map_from_entries(F.collect_list(F.struct("source", "counts"))).alias("coverage"))  # a report's sections: sources and languages
    return statistics.flattened(report, "coverage")


@query(f"""
WITH {V.PROGRESSIONS} SELECT 'edges' AS part, label AS key, count(*)::BIGINT AS total, count(*) FILTER (WHERE t % 2 = 0)::BIGINT AS affected FROM lp GROUP BY label
UNION ALL SELECT 'warnings', source, sum(CASE WHEN n_chars > 3000 THEN 2 ELSE 0 END)::BIGINT, count(*) FILTER (WHERE n_chars > 3000) FROM documents GROUP BY source""")
def lp_summary(spark, sf):
    edges = V.progressions(spark, sf).groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("t") % 2 == 0).alias("affected"))
    warned = statistics.warning_totals(table(spark, sf, "documents").withColumn("n", F.when(F.col("n_chars") > 3000, 2).otherwise(0)), "source", "n")
    shown = lambda rows, part, key: rows.select(F.lit(part).alias("part"), F.col(key).alias("key"), "total", "affected")
    return shown(edges, "edges", "label").unionByName(shown(warned, "warnings", "source"))


@query(f"""
WITH {V.SUPPORTS}, {V.DAG}, own AS (SELECT standard, confidence FROM supports WHERE component = 'O:1')
SELECT o.standard, o.confidence, (SELECT count(DISTINCT component) FROM supports s WHERE s.standard = o.standard) AS components, (SELECT count(*) FROM dag d WHERE d.target = o.standard) AS parents FROM own o""")
def component_context(spark, sf):
    supports, dag = V.supports(spark, sf), V.dag(spark, sf)
    own = supports.where("component = 'O:1'").select("standard", "confidence")
    others = supports.join(own.select("standard"), "standard", "left_semi").groupBy("standard").agg(F.count_distinct("component").alias("components"))
    parents = dag.join(own.select(F.col("standard").alias("target")), "target", "left_semi").groupBy(F.col("target").alias("standard")).agg(F.count("*").alias("parents"))
    return own.join(others, "standard").join(parents, "standard", "left").fillna(0, ["parents"])


@query(f"""
WITH {V.TREE}, up AS (SELECT source AS node_id FROM tree WHERE target = 'N:3'), down AS (SELECT target AS node_id FROM tree WHERE source = 'N:3')
SELECT node_id, min(place)::INTEGER AS place FROM (SELECT 'N:3' AS node_id, 0 AS place UNION ALL SELECT node_id, 1 FROM up UNION ALL SELECT node_id, 2 FROM down UNION ALL SELECT 'N:3', 3) GROUP BY node_id""")
def context_nodes(spark, sf):
    """A reply's nodes listed once, at the first of the parts that mention them."""
    edges = V.tree(spark, sf)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    near = lambda d, place: traversal.neighbours(edges, nodes, "N:3", d).select("node_id", F.lit(place).alias("place"))
    start = spark.createDataFrame([("N:3", 0), ("N:3", 3)], "node_id string, place int")
    return start.unionByName(near("parents", 1)).unionByName(near("children", 2)).groupBy("node_id").agg(F.min("place").alias("place"))


@query("""
SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'de'""")
def standard_provenance(spark, sf):
    """Provenance records met by the key of the standard that they are filed under."""
    docs, records = table(spark, sf, "documents").where("lang = 'de'"), table(spark, sf, "labels")
    filed = records.select(F.create_map(F.concat(F.lit("uuid-"), F.col("doc_id").cast("string")), F.struct("quality", "toxic")).alias("by_uuid"))
    rows = filed.select(F.explode("by_uuid").alias("uuid", "record"))
    return docs.select("doc_id", F.concat(F.lit("uuid-"), F.col("doc_id").cast("string")).alias("uuid")).join(rows, "uuid").select("doc_id", "record.quality", "record.toxic")


@query(f"""
WITH {V.PARTS}, r AS (SELECT node_id, '{{"node_id":"' || node_id || '","normalized_code":"' || lower(code) || '"}}' AS row_ FROM parts),
m AS (SELECT (('0x' || substr(sha256(node_id), 1, 2))::BIGINT % 64)::BIGINT AS bucket, sha256(row_) AS h, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT bucket, substr(h, 1, 3) AS head, sum(n)::BIGINT AS n, sha256(string_agg(h || ' ' || n, chr(10) ORDER BY h) || chr(10)) AS part FROM m GROUP BY ALL),
b AS (SELECT bucket, sum(n)::BIGINT AS n, sha256(string_agg(head || part, chr(10) ORDER BY head || part) || chr(10)) AS sha FROM p GROUP BY bucket)
SELECT sum(n)::BIGINT AS entries, sha256(string_agg(lpad(bucket::VARCHAR, 2, '0') || ' ' || sha, chr(10) ORDER BY lpad(bucket::VARCHAR, 2, '0'))) AS fingerprint FROM b""")
def index_fingerprint(spark, sf):
    return statistics.fingerprint(V.part_nodes(spark, sf).select("node_id", RULES.column("code").alias("normalized_code")), "node_id")


@query(f"""
WITH {V.BUILDS}, o AS (SELECT edge_id FROM bt WHERE source = 'P:1' ORDER BY edge_id LIMIT 3), n AS (SELECT count(*) AS n, (SELECT count(*) FROM bt b JOIN bt a ON a.target = b.source WHERE a.source = 'P:1' AND b.target NOT IN (SELECT target FROM bt WHERE source = 'P:1')) AS below FROM bt WHERE source = 'P:1')
SELECT edge_id, CASE WHEN n > 3 THEN 'edge_limit' WHEN below > 0 THEN 'depth_limit' END AS reason FROM o, n""")
def lp_traverse_reason(spark, sf):
    _, taken, reason = progressions.traverse(V.builds_towards(spark, sf), "P:1", max_depth=1, max_edges=3)
    return taken.where("depth = 1").select("edge_id", F.lit(reason).cast("string").alias("reason"))


@query(f"""
WITH {V.BUILDS}, l1 AS (SELECT source, target FROM bt WHERE source = 'P:1'), k AS (SELECT 'P:1' AS node_id, 0 AS depth UNION ALL SELECT DISTINCT target, 1 FROM l1)
SELECT k.node_id, k.depth::INTEGER AS depth, count(bt.edge_id) AS edges, 0::BIGINT AS pending, count(bt.edge_id) FILTER (WHERE k.depth = 1 AND bt.target NOT IN (SELECT node_id FROM k)) AS limited
FROM k LEFT JOIN bt ON bt.source = k.node_id GROUP BY k.node_id, k.depth""")
def lp_traverse_frontier(spark, sf):
    return progressions.walk_frontier(progressions.walk(V.builds_towards(spark, sf), "P:1", max_depth=1)).drop("arrival")


@query(f"""
WITH {V.BUILDS}, l AS (SELECT target FROM bt WHERE source = 'P:1'), k AS (SELECT 'P:1' AS node_id UNION SELECT target FROM l), d AS (SELECT edge_id, target FROM bt WHERE source IN (SELECT target FROM l)),
c AS (SELECT (SELECT count(*) FROM l) AS one, (SELECT count(*) FROM d) AS two, (SELECT count(*) FROM d WHERE target IN (SELECT node_id FROM k)) AS inside, (SELECT count(*) FROM k) AS nodes)
SELECT one + two AS examined, two AS examined_at_bound, nodes AS fully_examined, nodes AS returned_nodes, one + inside AS returned_edges, two = inside AS exhausted, CASE WHEN two > inside THEN 'depth_limit' ELSE '' END AS reasons FROM c""")
def lp_traverse_counters(spark, sf):
    """Part 1 and its neighbours: edges between them are returned, those further on only counted."""
    return progressions.walk_counters(progressions.walk(V.builds_towards(spark, sf), "P:1", max_depth=1, max_nodes=2000, max_edges=4000))


@query("""
WITH n AS (SELECT count(*)::BIGINT AS c FROM supplier)
SELECT 'delivery-prefix' AS code, (s_suppkey - 1)::VARCHAR AS record_id FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'delivery-prefix-type', (s_suppkey - 1)::VARCHAR FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'delivery-missing', lpad(p_partkey::VARCHAR, 12, '0') FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'delivery-surplus', lpad(p_partkey::VARCHAR, 12, '0') FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT 'delivery-order', (c + 7)::VARCHAR FROM n UNION ALL SELECT 'delivery-order', (c + 8)::VARCHAR FROM n""")
def findings_delivery(spark, sf):
    """Suppliers are the hierarchy part's lines, parts the progression lines; parts 8 and 10 changed places."""
    key = F.col("s_suppkey")
    prefix = table(spark, sf, "supplier").select((key - 1).cast("long").alias("line"), F.when(key % 4 == 0, "relatesTo").otherwise("hasChild").alias("label"), F.col("s_name").alias("value"))
    parts = table(spark, sf, "part").select("p_partkey", F.lit("buildsTowards").alias("label"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("edge_id"), F.col("p_name").alias("value"))
    start = prefix.agg(F.count("*").alias("start"))
    place = F.when(F.col("p_partkey") == 8, 10).when(F.col("p_partkey") == 10, 8).otherwise(F.col("p_partkey"))
    own = parts.join(start, F.lit(True)).select((F.col("start") + place - 1).alias("line"), "label", "edge_id", F.when(F.col("p_partkey") % 50 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))
    first = prefix.select("line", "label", F.lit(None).cast("string").alias("edge_id"), F.when((F.col("line") + 1) % 3 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))
    return validation.report(evidence.normalized_delivery(first.unionByName(own), prefix, parts.drop("p_partkey"))).select("code", "record_id")


@query(f"""
WITH {V.BUILDS}
SELECT 'topology-count' AS code, 'graph_edges' AS record_id, 'declared ' || (count(*) + 1) || ', observed ' || count(*) AS message FROM bt UNION ALL SELECT 'topology-count', 'cyclic_nodes', 'declared 2, observed 0'
UNION ALL SELECT 'topology-cycle', 'x:1', 'on a cycle or below one' UNION ALL SELECT 'topology-cycle', 'x:2', 'on a cycle or below one'""")
def findings_topology(spark, sf):
    """Counts of the progression edges, two of them wrong; the hierarchy with a cycle of two edges."""
    edges = cut(V.builds_towards(spark, sf).select("edge_id", "source", "target"), loop_dir(spark), "edges")
    facts = edges.agg(F.count("*").alias("e")).join(edges.select(F.explode(F.array("source", "target")).alias("v")).agg(F.count_distinct("v").alias("v")), F.lit(True))
    declared = facts.select(F.expr("stack(4, 'graph_edges', e + 1, 'graph_nodes', v, 'cyclic_edges', 0L, 'cyclic_nodes', 2L) AS (name, n)"))
    loop = spark.createDataFrame([("x:1", "a", "b"), ("x:2", "b", "a")], "edge_id string, source string, target string")
    return _findings([evidence.topology_counts(edges, declared), evidence.topology_cycles(V.tree(spark, sf).select("edge_id", "source", "target").unionByName(loop))])


@query("""
WITH d AS (SELECT doc_id FROM documents) SELECT 'archive-record' AS code, 'framework_id' AS record_id, 'en and fr' AS message
UNION ALL SELECT 'file-missing', 'doc/' || doc_id, 'declared and not there' FROM d WHERE doc_id % 7 = 0 UNION ALL SELECT 'file-size', 'doc/' || doc_id, 'another size' FROM d WHERE doc_id % 7 = 1
UNION ALL SELECT 'file-checksum', 'doc/' || doc_id, 'another checksum' FROM d WHERE doc_id % 7 = 2 UNION ALL SELECT 'file-undeclared', 'doc/x', 'there and not declared'""")
def findings_archive(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").cast("long").alias("size"))
    kind = F.col("k") % 7
    there = docs.where(kind != 0).select("path", F.when(kind == 2, "0").otherwise(F.col("sha256")).alias("sha256"), F.when(kind == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size")).unionByName(spark.createDataFrame([("doc/x", "0", 1)], "path string, sha256 string, size long"))
    return _findings([evidence.archive({"framework_id": "en", "snapshot_id": "1"}, {"framework_id": "fr", "snapshot_id": "1"}, docs.drop("k"), there)])


@query(f"""
WITH {V.BUILDS}
SELECT 'slim-missing' AS code, edge_id AS record_id FROM bt WHERE s % 13 = 0 UNION ALL SELECT 'slim-surplus', 'x:1' UNION ALL SELECT 'slim-derivation', edge_id FROM bt WHERE s % 13 = 1
UNION ALL SELECT 'slim-record-missing', edge_id FROM bt WHERE s % 13 = 0 UNION ALL SELECT 'slim-record-surplus', 'x:1' UNION ALL SELECT 'slim-record-mismatch', edge_id FROM bt WHERE s % 13 IN (1, 2) UNION ALL SELECT 'slim-record-twice', edge_id FROM bt WHERE s % 13 = 3""")
def findings_slim(spark, sf):
    """Full records made slim, some of them lost, changed (1), with another key (2) or twice (3)."""
    edges = cut(V.builds_towards(spark, sf), loop_dir(spark), "edges")
    key = F.concat_ws(":", F.lit("lc:curriculum:K:relationship"), "label", "source", "target")
    full = edges.select("edge_id", F.col("label").alias("decision"), F.col("source").alias("source_uuid"), F.col("target").alias("target_uuid"), F.when(F.col("s") % 13 == 2, "other").otherwise(key).alias("identity_key"), F.repeat(F.lit("reason "), 20).alias("rationale"), "s")
    derived = slim(full, ["rationale"])
    kind = F.col("s") % 13
    shipped = derived.where(kind != 0).withColumn("decision", F.when(kind == 1, "relatesTo").otherwise(F.col("decision")))
    surplus = spark.range(1).select(F.lit("x:1").alias("edge_id"), *[F.lit(None).cast(t).alias(c) for c, t in derived.dtypes if c != "edge_id"])
    shipped = shipped.unionByName(surplus)
    twice = shipped.unionByName(shipped.where(kind == 3))
    found = [*evidence.slim_derivation(shipped, derived, "edge_id"), *evidence.slim_records(twice.select("edge_id", "decision", "source_uuid", "target_uuid", "identity_key"), edges, "K")]
    return validation.report(found).select("code", "record_id")
