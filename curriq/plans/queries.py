"""The queries over the relational tables: each is an operator applied to a derived view, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.functions.text import CodeRules
from curriq.operators import catalog, paging, progressions, search, statistics, traversal, validation
from curriq.plans import frameworks, packages, rules, search_pages  # noqa: F401  (register their queries)
from curriq.plans import views as V
from curriq.plans.registry import QUERIES, SQL, query
from curriq.session import cut, loop_dir, table

TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}]+')"
GRADES = {"1-URGENT": "G1", "2-HIGH": "G2", "3-MEDIUM": "G3", "4-NOT SPECIFIED": "G4", "5-LOW": "G5"}
RULES = CodeRules()


# ---- Catalog and search ----------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT r_name AS framework_id, n_name AS snapshot_id, lower(n_name) || chr(31) || lower(r_name) AS hay FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, count(*) OVER () AS total FROM c WHERE contains(hay, 'nation') AND contains(hay, 'a'))
SELECT framework_id, snapshot_id, total FROM f ORDER BY framework_id, snapshot_id LIMIT 10""")
def catalog_filter(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("framework_id"), F.col("n_name").alias("snapshot_id"))
    found = catalog.text_filter(rows, ["snapshot_id", "framework_id"], "Nation  A")
    return paging.keyset_page(search.with_total(found, F.count("*"), "total"), ["framework_id", "snapshot_id"], None, 10)


def _text_sql(condition: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, list_distinct({TOKENS}) AS t FROM documents),
m AS (SELECT doc_id, list_filter(['in', 'the', 'zueinen'], lambda x: list_contains(t, x)) AS k FROM d)
SELECT doc_id, (1000000 * len(k) // 3)::BIGINT AS score, array_to_string(k, ',') AS matched_terms FROM m WHERE {condition} ORDER BY score DESC, doc_id LIMIT 25"""


@query(_text_sql("len(k) > 0"))
def text_any(spark, sf):
    hits = search.token_search(table(spark, sf, "documents"), "text", "The in, zueinen!", keep=("doc_id",))
    return search.page(hits, [F.desc("score"), F.asc("doc_id")])


@query(_text_sql("len(k) = 3").replace("'in', 'the', 'zueinen'", "'of', 'the', 'thing'"))
def text_all(spark, sf):
    hits = search.token_search(table(spark, sf, "documents"), "text", "thing of THE", every=True, keep=("doc_id",))
    return search.page(hits, [F.desc("score"), F.asc("doc_id")])


@query(f"""
SELECT doc_id, 1000000::BIGINT AS score, 'of,the,of' AS matched_terms, 2::BIGINT AS query_terms FROM documents
WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the of ') ORDER BY doc_id LIMIT 100""")
def text_phrase(spark, sf):
    return search.page(search.phrase_search(table(spark, sf, "documents"), "text", "of the, of", keep=("doc_id",)), [F.asc("doc_id")], 100)


@query(f"""
WITH {V.PARTS}, c AS (SELECT DISTINCT brand AS node_id, brand AS code FROM parts UNION ALL SELECT node_id, code FROM parts),
h AS (SELECT node_id, lower(code) AS normalized_code, CASE WHEN lower(code) = 'brand.1' THEN 1000000 ELSE 500000 END::BIGINT AS score FROM c WHERE lower(code) = 'brand.1' OR starts_with(lower(code), 'brand.1.'))
SELECT *, count(*) FILTER (WHERE score = 1000000) OVER () AS exact_hits FROM h ORDER BY normalized_code, node_id LIMIT 100""")
def code_exact_prefix(spark, sf):
    parts = V.part_nodes(spark, sf)
    codes = parts.select(F.col("brand").alias("node_id"), F.col("brand").alias("code")).distinct().unionByName(parts.select("node_id", "code"))
    hits = search.code_search(codes, "code", "BRAND.1", RULES, keep=("node_id",))
    return search.page(search.with_total(hits, F.count_if(F.col("score") == search.FULL_SCORE), "exact_hits"), [F.asc("normalized_code"), F.asc("node_id")], 100)


@query(f"""
WITH {V.PARTS}, n AS (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
b AS (SELECT DISTINCT brand, p_size AS k FROM parts),
x AS (SELECT p.node_id AS child, p.brand AS parent, EXISTS (SELECT 1 FROM n WHERE n.l_partkey = p.p_partkey) AS has_child,
    EXISTS (SELECT 1 FROM n JOIN b ON b.brand = p.brand AND b.k % 25 = n.s_nationkey WHERE n.l_partkey = p.p_partkey) AS meets FROM parts p)
SELECT child, parent, lower(parent) AS parent_code, (NOT has_child OR meets) AS compatible FROM x""")
def code_scope_parent(spark, sf):
    parts = V.part_nodes(spark, sf)
    nations = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_partkey").agg(F.collect_set(F.col("s_nationkey").cast("long")).alias("own"))
    scopes = lambda c: F.when(F.col(c).isNull(), F.expr("cast(map() AS map<string,array<bigint>>)")).otherwise(F.create_map(F.lit("nation"), F.col(c))).alias("scopes")
    children = parts.join(nations, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("node_id").alias("child"), RULES.column("code").alias("code"), scopes("own"))
    parents = parts.groupBy("brand").agg(F.collect_set((F.col("p_size") % 25).cast("long")).alias("own")).select(F.col("brand").alias("parent"), RULES.column("brand").alias("code"), scopes("own"))
    return search.parent_codes(children, parents, r"(.+)\.[0-9]+", "$1")


@query(f"""
WITH {V.PARTS}, {V.SUPPORTS}, h AS (SELECT node_id, code, CASE WHEN code = 'Brand.2.1' THEN 1000000 ELSE 500000 END AS score FROM parts WHERE starts_with(code, 'Brand.2.'))
SELECT component, max(score)::BIGINT AS score, count(DISTINCT lower(code)) AS codes, string_agg(DISTINCT lower(code), ',' ORDER BY lower(code)) AS matched_codes
FROM supports JOIN h ON h.node_id = standard GROUP BY component ORDER BY score DESC, component LIMIT 100""")
def supported_code(spark, sf):
    hits = search.code_search(V.part_nodes(spark, sf), "code", "Brand.2", RULES, keep=("node_id",)).withColumn("score", F.when(F.col("normalized_code") == "brand.2.1", search.FULL_SCORE).otherwise(search.PREFIX_SCORE).cast("long"))
    joined = V.supports(spark, sf).join(hits, F.col("standard") == F.col("node_id"))
    found = joined.groupBy("component").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("normalized_code")).alias("all"))
    return search.page(found.select("component", "score", F.size("all").cast("long").alias("codes"), F.array_join("all", ",").alias("matched_codes")), [F.desc("score"), F.asc("component")], 100)


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority AS grade, 'G' || substr(o_orderpriority, 1, 1) AS normalized, nullif(o_orderstatus, 'P') AS statement_type FROM orders)
SELECT * FROM o WHERE normalized IN ('G1', 'G2') AND (statement_type IS NULL OR statement_type <> 'F') ORDER BY o_orderkey LIMIT 100""")
def facet_search(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grade"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("statement_type"))
    known = search.facet_rows(rows, "grade", GRADES)
    hits = known.where(F.col("normalized").isin("G1", "G2") & (F.col("statement_type").isNull() | (F.col("statement_type") != "F")))  # F is a grouping
    return search.page(hits.select("o_orderkey", "grade", "normalized", "statement_type"), [F.asc("o_orderkey")], 100)


@query("""
WITH n AS (SELECT 'C:' || c_custkey AS node_id, c_name AS uuid, 'key:' || c_custkey AS uri FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_name, 'key:' || s_suppkey FROM supplier),
i AS (SELECT unnest(['C:7', 'Supplier#000000003', 'key:5', 'nobody']) AS identifier),
m AS (SELECT DISTINCT identifier, node_id FROM i JOIN n ON identifier IN (node_id, uuid, uri))
SELECT i.identifier, count(m.node_id) AS nodes, CASE count(m.node_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS result FROM i LEFT JOIN m ON m.identifier = i.identifier GROUP BY i.identifier""")
def resolve_node(spark, sf):
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    names = lambda rows, letter, key, name: rows.select(V.ident(letter, key).alias("node_id"), F.explode(F.array(V.ident(letter, key), F.col(name), V.ident("key", key))).alias("identifier"))
    known = names(customer, "C", "c_custkey", "c_name").unionByName(names(supplier, "S", "s_suppkey", "s_name")).distinct()
    asked = spark.createDataFrame([("C:7",), ("Supplier#000000003",), ("key:5",), ("nobody",)], "identifier string")
    found = asked.join(known, "identifier", "left").groupBy("identifier").agg(F.count("node_id").alias("nodes"))
    return found.withColumn("result", F.when(F.col("nodes") == 0, "not_found").when(F.col("nodes") == 1, "found").otherwise("ambiguous"))


@query("""
SELECT l_orderkey AS key, tag FROM (SELECT p_partkey AS l_orderkey, unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE lower(tag) = 'ring'""")
def tag_lookup(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("tags"))
    return search.tag_search(rows, "key", "tags", " RING ")


@query(f"""
WITH p AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents)
SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, count(*)::BIGINT AS postings, count(DISTINCT token) AS unique_tokens FROM p""")
def index_stats(spark, sf):
    return search.index_statistics(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT lang, n_chars, doc_id FROM documents WHERE ROW(lang, n_chars, doc_id) > (SELECT ROW(lang, n_chars, doc_id) FROM documents WHERE doc_id = 20) ORDER BY lang, n_chars, doc_id LIMIT 25")
def keyset_page(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "n_chars", "doc_id")
    return paging.keyset_page(docs, ["lang", "n_chars", "doc_id"], list(docs.where("doc_id = 20").first()), 25)


@query(f"""
WITH s AS (SELECT DISTINCT lang AS framework_id FROM documents UNION ALL SELECT 'it'),
h AS (SELECT lang AS framework_id, doc_id, (1000000 * (list_contains(t, 'the')::INT + list_contains(t, 'der')::INT) // 2)::BIGINT AS score FROM (SELECT doc_id, lang, {TOKENS} AS t FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY framework_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0)
SELECT s.framework_id, coalesce(r.doc_id, -1) AS doc_id, coalesce(r.score, 0) AS score, coalesce(r.rank, 0) AS rank FROM s LEFT JOIN r ON r.framework_id = s.framework_id AND r.rank <= 5""")
def compare_topk(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "framework_id")
    sections = docs.select("framework_id").unionByName(spark.createDataFrame([("it",)], "framework_id string"))
    hits = search.token_search(docs, "text", "der the", keep=("framework_id", "doc_id")).drop("matched_terms")
    return catalog.compare_sections(sections, hits, [F.desc("score"), F.asc("doc_id")], 5).fillna({"doc_id": -1, "score": 0, "rank": 0})  # no match


@query("""
SELECT source AS package_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE n_chars > 0) > 0 THEN 'text' END, CASE WHEN count(DISTINCT lang) > 1 THEN 'tag' END, CASE WHEN min(doc_id) % 2 = 0 THEN 'code' END, CASE WHEN min(doc_id) % 4 = 0 THEN 'code_prefix' END], lambda x: x IS NOT NULL), ',') AS modes,
  CASE WHEN min(doc_id) % 3 = 2 THEN 'not_reviewed' WHEN max(n_chars) < 5000 THEN 'no_full_text' WHEN sum(n_chars) > 100000 AND min(doc_id) % 5 <> 0 THEN 'no_bulk' ELSE 'allowed' END AS gate FROM documents GROUP BY source""")
def capabilities(spark, sf):
    facts = table(spark, sf, "documents").groupBy(F.col("source").alias("package_id")).agg(F.count_if(F.col("n_chars") > 0).alias("texts"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("k"), F.max("n_chars").alias("longest"), F.sum("n_chars").alias("chars"))
    modes = catalog.search_modes(F.col("texts") > 0, F.col("k") % 2 == 0, F.col("k") % 4 == 0, F.col("langs") > 1)
    return facts.select("package_id", F.array_join(modes, ",").alias("modes"), catalog.rights(F.col("k") % 3 != 2, F.col("longest") >= 5000, F.col("k") % 5 == 0, F.col("chars"), 100_000).alias("gate"))


# ---- Hierarchy -------------------------------------------------------------------------------------------------


@query(f"""
WITH {V.TREE} SELECT 'parent' AS relation, edge_id, source AS node_id, seo FROM tree WHERE target = 'N:3' UNION ALL SELECT 'child', edge_id, target, seo FROM tree WHERE source = 'N:3'""")
def direct_neighbors(spark, sf):
    edges = V.tree(spark, sf)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    near = lambda d, name: traversal.neighbours(edges, nodes, "N:3", d).withColumn("relation", F.lit(name))
    return near("parents", "parent").unionByName(near("children", "child")).select("relation", "edge_id", "node_id", "seo")


@query(f"""
WITH RECURSIVE {V.TREE}, d(node_id, depth) AS (SELECT 'R:1', 0 UNION SELECT target, depth + 1 FROM d JOIN tree ON source = node_id WHERE depth < 3) SELECT node_id, min(depth)::INTEGER AS depth FROM d GROUP BY node_id""")
def descendants(spark, sf):
    return traversal.traverse(V.tree(spark, sf), "R:1", max_depth=3)[0]


@query(f"""
WITH RECURSIVE {V.DAG}, a(node_id, depth) AS (SELECT 'P:1', 0 UNION SELECT source, depth + 1 FROM a JOIN dag ON target = node_id WHERE depth < 4),
m AS (SELECT node_id, min(depth)::INTEGER AS depth FROM a GROUP BY node_id), r AS (SELECT *, row_number() OVER (ORDER BY depth, node_id) AS n, count(*) OVER () AS total FROM m)
SELECT node_id, depth, CASE WHEN total > 12 THEN 'max_nodes' END AS truncation FROM r WHERE n <= 12""")
def ancestors_truncated(spark, sf):
    found, reason = traversal.traverse(V.dag(spark, sf), "P:1", down=False, max_depth=4, max_nodes=12)
    return found.withColumn("truncation", F.lit(reason).cast("string"))


@query(f"""
WITH {V.DAG}, n AS (SELECT 'R:1' AS node_id UNION SELECT target FROM dag WHERE source = 'R:1' UNION SELECT b.target FROM dag a JOIN dag b ON b.source = a.target WHERE a.source = 'R:1')
SELECT edge_id, source, target, seo FROM dag WHERE source IN (SELECT node_id FROM n) AND target IN (SELECT node_id FROM n)""")
def induced_edges(spark, sf):
    edges = V.dag(spark, sf)
    return traversal.induced_edges(edges, traversal.traverse(edges, "R:1", max_depth=2)[0]).select("edge_id", "source", "target", "seo")


@query(f"""
WITH {V.DAG}, p AS (SELECT row_number() OVER (ORDER BY p.edge_id) AS rank, 'root>' || n.source || '>' || s.source || '>' || p.source || '>P:1' AS path, 5::BIGINT AS nodes
  FROM dag p JOIN dag s ON s.target = p.source JOIN dag n ON n.target = s.source WHERE p.target = 'P:1')
SELECT rank, path, nodes, CASE WHEN (SELECT count(*) FROM p) > 20 AND 21 * 5 <= 63 THEN 'max_paths' WHEN (SELECT count(*) FROM p) > 12 THEN 'max_path_node_occurrences' END AS truncation FROM p WHERE rank <= 20 AND rank * 5 <= 63""")
def root_paths(spark, sf):
    found, reason = traversal.root_paths(V.dag(spark, sf), "root", "P:1", max_depth=8, max_paths=20, max_occurrences=63)
    return found.withColumn("truncation", F.lit(reason).cast("string"))


@query(f"""
WITH {V.TREE}, s AS (SELECT *, CASE WHEN seo % 5 = 0 THEN 'unresolvedRootFallback' END AS status FROM tree)
SELECT edge_id, status FROM s WHERE status IS NOT NULL AND (target IN ('N:1', 'R:1') OR source = 'N:1' OR source IN (SELECT target FROM tree WHERE source = 'N:1'))""")
def context_statuses(spark, sf):
    edges = V.tree(spark, sf).withColumn("status", F.when(F.col("seo") % 5 == 0, "unresolvedRootFallback"))
    around = [traversal.traverse(edges, "N:1", down=d, max_depth=2)[0] for d in (False, True)]
    parts = [traversal.induced_edges(edges, n) for n in around] + [edges.where("source = 'N:1'"), edges.where("target = 'N:1'")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.where("status IS NOT NULL").select("edge_id", "status").dropDuplicates(["edge_id"]).orderBy("edge_id")


@query(f"""
WITH {V.DAG}, {V.SUPPORTS} SELECT x.standard, count(*) AS paths, min('root>' || n.source || '>' || s.source || '>' || p.source || '>' || p.target) AS first_path
FROM supports x JOIN dag p ON p.target = x.standard JOIN dag s ON s.target = p.source JOIN dag n ON n.target = s.source WHERE x.component = 'O:1' GROUP BY x.standard""")
def component_placements(spark, sf):
    origins = V.supports(spark, sf).where("component = 'O:1'").select(F.col("standard").alias("node_id")).distinct()
    return traversal.root_paths_of(V.dag(spark, sf), origins, "root", 8).groupBy(F.col("origin").alias("standard")).agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


@query(f"""
WITH {V.SUPPORTS}, c AS (SELECT DISTINCT component FROM supports WHERE standard = 'P:1')
SELECT component, count(DISTINCT standard) AS standards, string_agg(DISTINCT standard, ',' ORDER BY standard) AS supported FROM supports WHERE component IN (SELECT component FROM c) GROUP BY component""")
def components_for_standard(spark, sf):
    supports = V.supports(spark, sf)
    own = supports.where("standard = 'P:1'").select("component").distinct()
    all_of = supports.join(own, "component", "left_semi").groupBy("component").agg(F.sort_array(F.collect_set("standard")).alias("s"))
    return all_of.select("component", F.size("s").cast("long").alias("standards"), F.array_join("s", ",").alias("supported"))


@query(f"""
WITH RECURSIVE {V.SUPPLIERS}, e AS (SELECT source, target FROM sup UNION ALL SELECT * FROM (VALUES ('S:1', 'S:2'), ('S:2', 'S:1'), ('S:2', 'X:1'), ('X:2', 'X:3'))),
r(node_id) AS (SELECT 'root' UNION SELECT target FROM r JOIN e ON source = node_id),
c(a, node_id) AS (SELECT source, target FROM e WHERE source LIKE 'S:%' OR source LIKE 'X:%' UNION SELECT a, target FROM c JOIN e ON source = node_id),
l AS (SELECT DISTINCT node_id FROM c WHERE a IN (SELECT a FROM c WHERE a = node_id))
SELECT 'reached' AS fact, count(*)::BIGINT AS n FROM r UNION ALL SELECT 'unreached', (SELECT count(*) FROM (SELECT source FROM e UNION SELECT target FROM e))::BIGINT - (SELECT count(*) FROM r)::BIGINT UNION ALL SELECT 'left by peeling', count(*)::BIGINT FROM l""")
def reach_cycle(spark, sf):
    planted = spark.createDataFrame([("S:1", "S:2"), ("S:2", "S:1"), ("S:2", "X:1"), ("X:2", "X:3")], "source string, target string")
    edges = V.supplier_tree(spark, sf).select("source", "target").unionByName(planted)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    reached = traversal.reachable(edges, spark.createDataFrame([("root",)], "node_id string"))
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fact"), "n")
    left = traversal.peel(edges).select(F.col("target").alias("node_id")).distinct()
    return count(reached, "reached").unionByName(count(nodes.join(reached, "node_id", "left_anti"), "unreached")).unionByName(count(left, "left by peeling"))


# ---- Progressions ----------------------------------------------------------------------------------------------


@query(f"""
WITH {V.BUILDS}, {V.PARTS} SELECT edge_id, label, a.p_name AS source_name, b.p_name AS target_name, CASE WHEN b.p_retailprice > a.p_retailprice THEN 'rising' ELSE 'falling' END AS judgment
FROM bt JOIN parts a ON a.node_id = source JOIN parts b ON b.node_id = target WHERE source = 'P:1'""")
def lp_lookup(spark, sf):
    parts = V.part_nodes(spark, sf)
    end = lambda name: parts.select(F.col("node_id").alias(name), F.col("p_name").alias(f"{name}_name"), F.col("p_retailprice").alias(f"{name}_price"))
    joined = V.builds_towards(spark, sf).where("source = 'P:1'").join(end("source"), "source").join(end("target"), "target")
    return joined.select("edge_id", "label", "source_name", "target_name", F.when(F.col("target_price") > F.col("source_price"), "rising").otherwise("falling").alias("judgment"))


@query(f"""
WITH {V.PROGRESSIONS} SELECT edge_id, label, CASE WHEN label = 'relatesTo' THEN 'related' WHEN source = 'P:10' THEN 'outgoing' ELSE 'incoming' END AS kind FROM lp WHERE source = 'P:10' OR target = 'P:10'""")
def lp_direct(spark, sf):
    return progressions.direct(V.progressions(spark, sf), "P:10").select("edge_id", "label", "kind")


@query(f"""
WITH {V.BUILDS}, {V.PARTS}, o AS (SELECT *, row_number() OVER (ORDER BY label, edge_id) - 1 AS position FROM bt)
SELECT position, label, edge_id, source, target, 'both' AS connection FROM o JOIN parts a ON a.node_id = source AND a.p_type = 'STANDARD' JOIN parts b ON b.node_id = target AND b.p_type = 'STANDARD'
WHERE position BETWEEN 100 AND 5099 ORDER BY position LIMIT 50""")
def lp_discovery(spark, sf):
    return progressions.discover(V.builds_towards(spark, sf).drop("s", "t"), V.part_nodes(spark, sf), F.col("p_type") == "STANDARD", "both", position=100, limit=50)


@query(f"""
WITH {V.BUILDS},
l1 AS (SELECT edge_id, source, target, row_number() OVER (ORDER BY edge_id) AS n FROM bt WHERE source = 'P:1'),
l2 AS (SELECT b.edge_id, b.source, b.target, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY l1.n, b.edge_id) AS n FROM bt b JOIN l1 ON l1.target = b.source),
n2 AS (SELECT target, min(n) AS n FROM l2 WHERE target <> 'P:1' AND target NOT IN (SELECT target FROM l1) AND n <= 100 GROUP BY target),
k AS (SELECT 'P:1' AS node_id UNION SELECT target FROM l1 UNION SELECT target FROM n2),
l3 AS (SELECT b.edge_id, b.source, b.target, (SELECT count(*) FROM l1) + (SELECT count(*) FROM l2) + row_number() OVER (ORDER BY n2.n, b.edge_id) AS n FROM bt b JOIN n2 ON n2.target = b.source WHERE b.target IN (SELECT node_id FROM k))
SELECT edge_id, source, target, depth::INTEGER AS depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) WHERE n <= 100""")
def lp_traverse(spark, sf):
    return progressions.traverse(V.builds_towards(spark, sf), "P:1", max_depth=2)[1]


LAST = "(SELECT max(b.t) FROM bt a JOIN bt b ON b.s = a.t WHERE a.s = 1)"


def _last(edges: DataFrame) -> str:
    two = edges.where("s = 1").select(F.col("t").alias("m")).join(edges.select(F.col("s").alias("m"), "t"), "m")
    return f"P:{two.agg(F.max('t')).first()[0]}"


@query(f"""
WITH RECURSIVE {V.BUILDS}, z AS (SELECT 'P:' || {LAST} AS last),
p(node, path, ids, hops) AS (SELECT 'P:1', 'P:1', ''::VARCHAR, 0 UNION ALL SELECT target, path || '>' || target, CASE WHEN hops = 0 THEN edge_id ELSE ids || ',' || edge_id END, hops + 1 FROM p JOIN bt ON source = node WHERE hops < 4 AND node <> (SELECT last FROM z)),
r AS (SELECT row_number() OVER (ORDER BY hops, string_split(ids, ',')) AS rank, hops::BIGINT AS hops, path, ids AS edge_ids FROM p WHERE node = (SELECT last FROM z))
SELECT * FROM r WHERE rank <= 20""")
def lp_paths(spark, sf):
    edges = cut(V.builds_towards(spark, sf), loop_dir(spark), "edges")
    return progressions.paths(edges, "P:1", _last(edges), max_depth=4, max_paths=20)


@query(f"""
WITH RECURSIVE {V.BUILDS}, z AS (SELECT 'P:' || {LAST} AS last), w AS (SELECT DISTINCT b.target AS node_id FROM bt a JOIN bt b ON b.source = a.target WHERE a.source = 'P:1'),
away AS (SELECT DISTINCT bt.target AS node_id FROM w JOIN bt ON bt.source = w.node_id),
r(node_id) AS (SELECT node_id FROM away UNION SELECT target FROM r JOIN bt ON source = r.node_id),
n AS (SELECT (SELECT count(*) FROM bt, z WHERE source = 'P:1' AND target = last) + (SELECT count(*) FROM bt a JOIN bt b ON b.source = a.target, z WHERE a.source = 'P:1' AND b.target = last AND a.target <> last) AS n)
SELECT least(n, 1)::BIGINT AS returned, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM r, z WHERE node_id = last) THEN 'depth_limit' END, CASE WHEN n > 1 THEN 'path_limit' END) AS reasons FROM n""")
def lp_path_reasons(spark, sf):
    edges = cut(V.builds_towards(spark, sf), loop_dir(spark), "edges")
    found, reasons = progressions.path_search(edges, "P:1", _last(edges), max_depth=2, max_paths=1)
    return found.agg(F.count("*").alias("returned")).withColumn("reasons", F.lit(",".join(reasons)))


@query(f"""
WITH RECURSIVE {V.BUILDS}, d(node_id, hops) AS (SELECT 'P:' || {LAST}, 0 UNION SELECT source, hops + 1 FROM d JOIN bt ON target = node_id WHERE hops < 4)
SELECT node_id, bit_or((1 << hops)::BIGINT)::BIGINT AS lengths, min(hops)::BIGINT AS shortest, max(hops)::BIGINT AS longest FROM d GROUP BY node_id""")
def lp_reach_dp(spark, sf):
    edges = cut(V.builds_towards(spark, sf), loop_dir(spark), "edges")
    return progressions.target_reach(edges, _last(edges), 4)


@query("""
SELECT conv_id, turn, substr(text, 1, 64) AS excerpt, length(text) > 64 AS cut_off, (SELECT count(*) FROM conversations) AS total FROM conversations""")
def judgment_excerpt(spark, sf):
    rows = table(spark, sf, "conversations")
    total = rows.agg(F.count("*").alias("total"))
    return progressions.excerpt(rows, "text", 64).select("conv_id", "turn", "excerpt", "cut_off").join(total, F.lit(True))


@query("""
SELECT 'lifted' AS stage, l_orderkey, l_partkey, NULL::VARCHAR AS flag, l_linestatus AS status FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'lowered', l_orderkey, l_partkey, 'A', l_linestatus FROM lineitem WHERE l_returnflag = 'A'""")
def compact_rehydrate(spark, sf):
    return _compacted(table(spark, sf, "lineitem"))


def _compacted(lines: DataFrame) -> DataFrame:
    """The returned lines with their constant columns lifted, and lowered again."""
    rows = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    shared, lifted = progressions.lift_constants(rows, ["flag", "status"])
    lowered = progressions.lower_constants(lifted, shared, ["flag", "status"])
    return lifted.withColumn("stage", F.lit("lifted")).unionByName(lowered.withColumn("stage", F.lit("lowered")))


# ---- Statistics, validation and sets ---------------------------------------------------------------------------


@query("SELECT nullif(o_orderstatus, 'P') AS value, count(*) AS n FROM orders GROUP BY 1")
def stat_types(spark, sf):
    return statistics.value_counts(table(spark, sf, "orders").withColumn("v", F.nullif(F.col("o_orderstatus"), F.lit("P"))), "v")


@query("""
SELECT value, count(*) AS n FROM (SELECT unnest(CASE WHEN o_orderstatus = 'P' THEN [NULL] ELSE [o_orderpriority, o_orderstatus] END) AS value FROM orders) GROUP BY value""")
def stat_grades(spark, sf):
    rows = table(spark, sf, "orders").withColumn("g", F.when(F.col("o_orderstatus") != "P", F.array("o_orderpriority", "o_orderstatus")).when(F.col("o_orderkey") % 2 == 0, F.expr("cast(array() AS array<string>)")))
    return statistics.element_counts(rows, "g")


@query(f"""
WITH {V.TREE}, s AS (SELECT CASE WHEN seo % 5 = 0 THEN 'unresolvedRootFallback' END AS status FROM tree) SELECT status AS value, count(*) AS n FROM s GROUP BY status""")
def stat_status(spark, sf):
    return statistics.value_counts(V.tree(spark, sf).withColumn("status", F.when(F.col("seo") % 5 == 0, "unresolvedRootFallback")), "status")


@query(f"""
WITH {V.DAG}, i AS (SELECT 'P:' || p_partkey AS node_id FROM part), c AS (SELECT i.node_id, count(dag.edge_id) AS parents FROM i LEFT JOIN dag ON target = node_id GROUP BY i.node_id)
SELECT parents, count(*) AS items FROM c GROUP BY parents""")
def stat_multi_parent(spark, sf):
    return statistics.parent_distribution(V.dag(spark, sf), V.part_nodes(spark, sf))


@query(f"""
WITH RECURSIVE {V.TREE}, d(node_id, depth) AS (SELECT 'root', 0 UNION SELECT target, depth + 1 FROM d JOIN tree ON source = node_id), m AS (SELECT node_id, min(depth)::INTEGER AS depth FROM d GROUP BY node_id) SELECT depth, count(*) AS n FROM m GROUP BY depth""")
def stat_depth(spark, sf):
    return traversal.traverse(V.tree(spark, sf), "root")[0].groupBy("depth").agg(F.count("*").alias("n"))


@query(f"""
WITH {V.SUPPORTS}, c AS (SELECT component, count(DISTINCT standard) AS span FROM supports GROUP BY component)
SELECT (SELECT count(DISTINCT standard) FROM supports) AS standards, count(*) AS components, count(*) FILTER (WHERE span > 1) AS bridges, max(span) AS largest_span, (SELECT min(confidence) FROM supports) AS least_confidence, (SELECT max(confidence) FROM supports) AS most_confidence FROM c""")
def stat_components(spark, sf):
    return statistics.support_statistics(V.supports(spark, sf), "l_orderkey", "l_partkey", table(spark, sf, "lineitem"))


@query(f"""
WITH {V.PROGRESSIONS}, {V.PARTS} SELECT label, count(*) AS n, (SELECT count(*) FROM parts WHERE code LIKE 'Brand.1%') AS coded, CASE WHEN (SELECT count(*) FROM parts WHERE code LIKE 'Brand.1%') = (SELECT count(*) FROM parts) THEN 'complete' ELSE 'partial' END AS availability FROM lp GROUP BY label""")
def stat_labels(spark, sf):
    facts = statistics.node_facts(V.part_nodes(spark, sf).withColumn("c", F.when(F.col("code").startswith("Brand.1"), F.col("code"))), "c", "p_name")
    counts = V.progressions(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(facts.select("coded", "availability"), F.lit(True))


@query("""
WITH m AS (SELECT (('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::BIGINT % 64)::BIGINT AS bucket, sha256(text) AS h, count(*) AS n FROM documents GROUP BY ALL),
p AS (SELECT bucket, substr(h, 1, 3) AS head, sum(n)::BIGINT AS n, sha256(string_agg(h || ' ' || n, chr(10) ORDER BY h) || chr(10)) AS part FROM m GROUP BY ALL)
SELECT bucket, sum(n)::BIGINT AS n, sha256(string_agg(head || part, chr(10) ORDER BY head || part) || chr(10)) AS sha256 FROM p GROUP BY bucket""")
def shard_digest(spark, sf):
    return statistics.bucketed_digest(table(spark, sf, "documents"), "doc_id", "text")


def _broken(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with what rules must find: raw order lines as edges, some parts missing, and loops."""
    lines = table(spark, sf, "lineitem").select(F.lit("supports").alias("label"), V.ident("K", "l_suppkey").alias("source"), F.when(F.col("l_suppkey") == F.col("l_partkey"), V.ident("K", "l_suppkey")).otherwise(V.ident("P", "l_partkey")).alias("target"), F.col("l_orderkey").alias("seo"), F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).alias("edge_id"))
    nodes = table(spark, sf, "part").where("p_partkey % 50 <> 0").select(V.ident("P", "p_partkey").alias("node_id")).unionByName(table(spark, sf, "supplier").select(V.ident("K", "s_suppkey").alias("node_id")))
    return nodes, lines


@query("""
WITH e AS (SELECT 'K:' || l_suppkey AS source, CASE WHEN l_suppkey = l_partkey THEN 'K:' || l_suppkey ELSE 'P:' || l_partkey END AS target FROM lineitem),
n AS (SELECT 'P:' || p_partkey AS node_id FROM part WHERE p_partkey % 50 <> 0 UNION ALL SELECT 'K:' || s_suppkey FROM supplier)
SELECT 'edge-duplicate' AS code, (count(*) - count(DISTINCT (source, target)))::BIGINT AS n FROM e UNION ALL SELECT 'edge-self-loop', count(*) FROM e WHERE source = target
UNION ALL SELECT 'target-unresolved', count(*) FROM e WHERE target NOT IN (SELECT node_id FROM n)""")
def findings_identity(spark, sf):
    nodes, edges = _broken(spark, sf)
    edges = edges.withColumn("edge_id", F.concat_ws("/", "edge_id", F.monotonically_increasing_id()))
    return validation.report(validation.edge_identity(edges, nodes)).groupBy("code").agg(F.count("*").alias("n")).where("n > 0")


@query("""
WITH c AS (SELECT p_partkey, p_type, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_type)
SELECT 'parent-too-few' AS code, 'P:' || p_partkey AS record_id FROM c WHERE n < 1 AND p_type IN ('STANDARD', 'PROMO') UNION ALL SELECT 'parent-too-many', 'P:' || p_partkey FROM c WHERE n > 3 AND p_type = 'STANDARD'
UNION ALL SELECT 'parent-type', 'P:' || p_partkey FROM c WHERE n > 0 AND p_type NOT IN ('STANDARD', 'PROMO')""")
def findings_parents(spark, sf):
    return _parent_findings(spark, sf, V.dag(spark, sf))


def _parent_findings(spark: SparkSession, sf: str, edges: DataFrame) -> DataFrame:
    sold = edges.where(F.col("target").startswith("P:")).withColumn("status", F.lit(None).cast("string"))
    items = V.part_nodes(spark, sf).select("node_id", F.col("p_type").alias("statement_type")).unionByName(table(spark, sf, "supplier").select(V.ident("S", "s_suppkey").alias("node_id"), F.lit("SUPPLIER").alias("statement_type")))
    policies = spark.createDataFrame([("STANDARD", "SUPPLIER", 1, 3), ("PROMO", "SUPPLIER", 1, 1_000_000)], "statement_type string, parent_type string, least int, most int")
    return validation.report(validation.parent_policy(sold, items, policies)).select("code", "record_id")


@query(f"""
WITH {V.PROGRESSIONS}, e AS (SELECT source, target, label FROM lp UNION ALL SELECT 'P:2', 'P:1', 'relatesTo' UNION ALL SELECT 'P:3', 'P:3', 'buildsTowards' UNION ALL SELECT target, source, 'buildsTowards' FROM bt WHERE source = 'P:1'),
w AS (SELECT *, count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) AS n FROM e)
SELECT 'lp-order' AS item, count(*)::BIGINT AS n FROM e WHERE label = 'relatesTo' AND source > target UNION ALL SELECT 'lp-self-loop', count(*)::BIGINT FROM e WHERE source = target UNION ALL SELECT 'lp-pair', count(*)::BIGINT FROM w WHERE n > 1
UNION ALL SELECT d, (SELECT count(*) FROM labels WHERE CASE WHEN toxic = 1 THEN 'needs_review' WHEN quality = 1 THEN 'buildsTowards' ELSE 'no_relation' END = d)::BIGINT FROM (SELECT unnest(['buildsTowards', 'relatesTo', 'no_relation', 'needs_review']) AS d)""")
def findings_lp(spark, sf):
    edges = V.progressions(spark, sf).select("edge_id", "label", "source", "target")
    planted = spark.createDataFrame([("x1", "relatesTo", "P:2", "P:1"), ("x2", "buildsTowards", "P:3", "P:3")], "edge_id string, label string, source string, target string")
    turned = edges.where("source = 'P:1' AND label = 'buildsTowards'").select(F.concat(F.lit("x:"), "edge_id").alias("edge_id"), "label", F.col("target").alias("source"), F.col("source").alias("target"))
    found = validation.report(validation.progression_graph(edges.unionByName(planted).unionByName(turned), V.part_nodes(spark, sf))).groupBy(F.col("code").alias("item")).agg(F.count("*").alias("n"))
    decided = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "needs_review").when(F.col("quality") == 1, "buildsTowards").otherwise("no_relation").alias("decision"))
    return found.unionByName(validation.decision_counts(decided).withColumnRenamed("decision", "item"))


@query("""
WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <> 7 UNION ALL SELECT 1, -1)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set_reconcile(spark, sf):
    return _reconciled(table(spark, sf, "lineitem"))


def _reconciled(rows: DataFrame) -> DataFrame:
    """Order lines against the same without the seventh ones and with one more."""
    spark = rows.sparkSession
    extra = spark.createDataFrame([(1, -1)], "l_orderkey long, l_partkey long")
    return statistics.set_difference(rows.select("l_orderkey", "l_partkey"), rows.where("l_linenumber <> 7").select("l_orderkey", "l_partkey").unionByName(extra))
