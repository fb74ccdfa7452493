"""Code scopes, the code index, and the choice of packages, snapshots and standards that a request names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curriq.functions.text import CodeRules
from curriq.operators.catalog import member_filter
from curriq.operators.traversal import cycle_witness
from curriq.session import cut, forget, loop_dir

SELECTORS = ("node_id", "case_uuid", "case_uri", "code")


class ScopeError(ValueError):
    """A coded node without a scope, or a cycle on the way up; `witness` names nodes or, of a cycle, its edges."""

    def __init__(self, message: str, witness: list[str]):
        super().__init__(f"{message}: {', '.join(witness)}")
        self.witness = witness


def _typed(ups: DataFrame, nodes: DataFrame) -> DataFrame:
    """ups (up, scope_type ...) with hit: whether up is of the type; nodes that aren't there lead nowhere."""
    kinds = nodes.select(F.col("node_id").alias("up"), "statement_type")
    return ups.join(kinds, "up").withColumn("hit", F.coalesce(F.col("statement_type") == F.col("scope_type"), F.lit(False))).drop("statement_type")


def _ways_up(edges: DataFrame, nodes: DataFrame, asked: DataFrame, folder: str) -> DataFrame:
    """(at, scope_type, up, hit): for each wanted type the edges that lead up from asked nodes (node_id, scope_type) as far
    as branches go, a branch ending at its first parent of the type. Each (node, type) goes up once."""
    front = seen = asked.select(F.col("node_id").alias("at"), "scope_type")
    found, step = None, 0
    while True:
        level = cut(_typed(front.join(edges, "at"), nodes).select("at", "scope_type", "up", "hit"), folder, f"ways-{step}")
        found = level if found is None else found.unionByName(level)
        front = cut(level.where("NOT hit").select(F.col("up").alias("at"), "scope_type").distinct().join(seen, ["at", "scope_type"], "left_anti"), folder, f"front-{step}")
        if front.isEmpty():
            return found
        seen, step = seen.unionByName(front), step + 1


def _settled(ways: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """((at, scope_type, scope_id), (at, scope_type, up)): the scopes of the nodes of ways, and the edges that a cycle leaves unsettled."""
    own, spark = ["at", "scope_type"], ways.sparkSession
    matches = cut(ways.where("hit").select(*own, F.col("up").alias("scope_id")), folder, "matches-0")
    left = cut(ways.where("NOT hit").select(*own, "up"), folder, "left-0")
    # nodes without other parents are settled at once
    places = ways.select(*own).unionByName(ways.where("NOT hit").select(F.col("up").alias("at"), "scope_type")).distinct()
    settled = cut(places.join(left.select(*own).distinct(), own, "left_anti"), folder, "settled-0")
    step = 0
    while not settled.isEmpty():
        above = settled.select(F.col("at").alias("up"), "scope_type")
        passed = left.join(above, ["up", "scope_type"], "left_semi")
        handed = passed.join(matches.select(F.col("at").alias("up"), "scope_type", "scope_id"), ["up", "scope_type"]).select(*own, "scope_id")
        rest = cut(left.join(above, ["up", "scope_type"], "left_anti"), folder, f"left-{step + 1}")
        matches = cut(matches.unionByName(handed).distinct(), folder, f"matches-{step + 1}")
        settled = cut(passed.select(*own).distinct().join(rest.select(*own).distinct(), own, "left_anti"), folder, f"settled-{step + 1}")
        forget(spark, folder, f"left-{step}", f"matches-{step}", f"settled-{step}")
        left, step = rest, step + 1
    return matches, left


def resolved_scopes(edges: DataFrame, nodes: DataFrame, coded: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node_id, scope_type, scope_id), (scope_type, source, target)): the nearest ancestors of each wanted type
    (scope_type) of each coded node, and the edges of ways up that a cycle leaves unsettled.

    Every branch of parents ends at its first match. A (node, type) is settled once all its other parents are, and then holds
    its matches and theirs: ways up are met once each, in levels from the top, and what stands above two nodes is settled
    once. Nodes on a cycle, or below one, are never settled. edges: source, target; nodes: node_id, statement_type.

    Only what stands above coded nodes is settled in levels. Edges are written once, marked where they leave a coded
    node, and a last pass over those hands down what their parents hold; so the edges of coded nodes, most of all, are
    neither joined nor written again for each level and type.
    """
    spark, folder = edges.sparkSession, loop_dir(edges.sparkSession)
    types = [r[0] for r in wanted.select("scope_type").distinct().collect()]  # a profile's scope types
    coded = coded.select("node_id").distinct()
    each = F.explode(F.array(*[F.lit(t) for t in types]).cast("array<string>"))
    asked = coded.withColumn("scope_type", each)
    marked = edges.select(F.col("target").alias("at"), F.col("source").alias("up")).join(coded.select(F.col("node_id").alias("at"), F.lit(True).alias("asked")), "at", "left")
    marked = cut(marked.select("at", "up", F.col("asked").isNotNull().alias("asked")), folder, "edges")
    first = marked.where("asked").select("up").distinct()
    first = cut(_typed(first.withColumn("scope_type", each), nodes), folder, "first")
    inner = first.where("NOT hit").select(F.col("up").alias("node_id"), "scope_type")
    matches, left = _settled(cut(_ways_up(marked.select("at", "up"), nodes, inner, folder), folder, "ways"), folder)
    held = first.where("hit").select("up", "scope_type", F.col("up").alias("scope_id")).unionByName(matches.select(F.col("at").alias("up"), "scope_type", "scope_id"))
    last = marked.where("asked").select("at", "up")
    handed = last.join(held, "up").select(F.col("at").alias("node_id"), "scope_type", "scope_id").distinct()
    open_ = left.select("scope_type", F.col("up").alias("source"), F.col("at").alias("target"))
    if not left.isEmpty():
        lost = left.select(F.col("at").alias("up"), "scope_type").distinct()
        open_ = cut(open_.unionByName(last.join(lost, "up").select("scope_type", F.col("up").alias("source"), F.col("at").alias("target"))).distinct(), folder, "open")
        asked = asked.join(open_.select(F.col("target").alias("node_id"), "scope_type").distinct(), ["node_id", "scope_type"], "left_anti")
    return asked.join(handed, ["node_id", "scope_type"], "left"), open_


def scope_problems(edges: DataFrame, nodes: DataFrame, coded: DataFrame, wanted: DataFrame) -> DataFrame:
    """(problem, node_id, scope_type): coded nodes without a scope (scope-missing), or on or below a cycle (scope-cycle)."""
    found, left = resolved_scopes(edges, nodes, coded, wanted)
    stuck = left.select(F.col("target").alias("node_id"), "scope_type").distinct().join(coded.select("node_id").distinct(), "node_id", "left_semi")
    shown = lambda rows, name: rows.select(F.lit(name).alias("problem"), "node_id", "scope_type")
    return shown(found.where("scope_id IS NULL"), "scope-missing").unionByName(shown(stuck, "scope-cycle"))


def nearest_scopes(edges: DataFrame, nodes: DataFrame, coded: DataFrame, wanted: DataFrame, missing_ok: bool = False) -> DataFrame:
    """(node_id, scope_type, scope_id) as `resolved_scopes` gives them; ScopeError for a cycle, with the edges of one, and,
    unless missing_ok, for nodes without a scope, with the first five of them."""
    found, left = resolved_scopes(edges, nodes, coded, wanted)
    if not left.isEmpty():
        stuck = left.select("source", "target").distinct()
        ring = cycle_witness(stuck.select(F.concat_ws(">", "source", "target").alias("edge_id"), "source", "target"))
        raise ScopeError("a cycle above coded nodes", ring)
    lost = [] if missing_ok else [r[0] for r in found.where("scope_id IS NULL").select("node_id").distinct().orderBy("node_id").limit(5).collect()]
    if lost:
        raise ScopeError("coded nodes without a scope", lost)
    return found


def code_index(codes: DataFrame, rules: CodeRules) -> DataFrame:
    """codes (node_id, statement_type, code, scope_type, scope_id) by (statement_type, scope_key, normalized_code): nodes, first_node.

    scope_key holds a node's scopes as type=id in order, comma-joined; a node without scopes has an empty one.
    """
    named = codes.where("code IS NOT NULL").withColumn("normalized_code", rules.column("code"))
    own = named.groupBy("node_id", "statement_type", "normalized_code").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("scope_id").isNotNull(), F.concat_ws("=", "scope_type", "scope_id")))), ",").alias("scope_key"))
    return own.groupBy("statement_type", "scope_key", "normalized_code").agg(F.count("*").alias("nodes"), F.min("node_id").alias("first_node"))


def scoped_duplicates(index: DataFrame) -> DataFrame:
    """Entries of a code index that break uniqueness within their type and scope."""
    return index.where("nodes > 1")


def select_packages(packages: DataFrame, package_id: str | None = None, frameworks: list[str] | None = None, graph_types: list[str] | None = None, snapshots: list[str] | None = None) -> DataFrame:
    """The one package that is named (LookupError if it isn't there), or those of the named frameworks, types and snapshots."""
    if package_id is not None:
        own = packages.where(F.col("package_id") == package_id)
        if own.isEmpty():
            raise LookupError(f"no package {package_id}")
        return own
    for column, wanted in (("framework_id", frameworks), ("graph_type", graph_types), ("snapshot_id", snapshots)):
        packages = packages.where(F.col(column).isin(*wanted)) if wanted else packages
    return packages


def filter_packages(packages: DataFrame, current: bool | None = None, graph_types: list[str] | None = None, statuses: list[str] | None = None, metadata: dict[str, list[str]] | None = None) -> DataFrame:
    """Packages by currency, graph type, validation status, and normalized members of array columns (subjects, grades ...)."""
    if current is not None:
        packages = packages.where(F.col("is_current") == current)
    packages = select_packages(packages, graph_types=graph_types)
    packages = packages.where(F.col("status").isin(*statuses)) if statuses else packages
    for column, wanted in sorted((metadata or {}).items()):
        packages = packages.where(member_filter(column, wanted))
    return packages


def resolve_snapshots(packages: DataFrame, framework_ids: list[str], snapshot_ids: list[str], metadata: dict[str, list[str]] | None = None) -> DataFrame:
    """(framework_id, snapshot_id, explicit): the named snapshots, and the current ones of frameworks without a named one."""
    all_of = packages.select("framework_id", "snapshot_id", "is_current", *(metadata or {})).dropDuplicates(["framework_id", "snapshot_id"])
    named = all_of.where(F.col("snapshot_id").isin(*snapshot_ids)) if snapshot_ids else all_of.limit(0)
    rest = all_of.where("is_current")
    rest = rest.where(F.col("framework_id").isin(*framework_ids)) if framework_ids else rest
    rest = rest.join(named.select("framework_id").distinct(), "framework_id", "left_anti")
    both = named.withColumn("explicit", F.lit(True)).unionByName(rest.withColumn("explicit", F.lit(False)))
    for column, wanted in sorted((metadata or {}).items()):
        both = both.where(member_filter(column, wanted))
    return both.select("framework_id", "snapshot_id", "explicit")


def resolve_selectors(asked: DataFrame, nodes: DataFrame, rules: CodeRules) -> DataFrame:
    """asked (kind, value) with the number of standards hit and found, ambiguous or not_found; kinds: SELECTORS.

    nodes: node_id, case_uuid, case_uri, code. A code has to hit exactly one standard, compared as the rules say.
    """
    names = F.array(*[F.struct(F.lit(k).alias("kind"), (rules.column(k) if k == "code" else F.col(k)).alias("key")) for k in SELECTORS])
    keyed = asked.withColumn("key", F.when(F.col("kind") == "code", rules.column("value")).otherwise(F.col("value")))
    known = nodes.select("node_id", F.explode(names).alias("n")).select("node_id", "n.kind", "n.key")
    known = known.join(F.broadcast(keyed.select("kind", "key").distinct()), ["kind", "key"], "left_semi").distinct()  # a request's few keys: only what they hit is gathered
    found = keyed.join(known, ["kind", "key"], "left").groupBy("kind", "value").agg(F.count("node_id").alias("nodes"), F.min("node_id").alias("first_node"))
    result = F.when(F.col("nodes") == 0, "not_found").when(F.col("nodes") == 1, "found").otherwise("ambiguous")
    return found.select("kind", "value", "nodes", F.when(F.col("nodes") == 1, F.col("first_node")).alias("node_id"), result.alias("result"))


def normalized_filters(filters: dict[str, list[str]], supported: dict[str, list[str]]) -> dict[str, list[str]]:
    """Progression filters with normalized values; an unsupported facet, an unknown, blank or repeated value is an error."""
    from curriq.functions.text import facet_text

    out = {}
    for facet, values in filters.items():
        if facet not in supported:
            raise ValueError(f"unsupported facet {facet}")
        keys = [facet_text(v) for v in values]
        if not all(keys) or len(set(keys)) < len(keys) or set(keys) - {facet_text(v) for v in supported[facet]}:
            raise ValueError(f"blank, repeated or unknown values of {facet}")
        out[facet] = sorted(keys)
    return out


def ordered_warnings(warnings: DataFrame) -> DataFrame:
    """Distinct warnings in order of (package_id, code, node_id, message)."""
    keys = ["package_id", "code", "node_id", "message"]
    return warnings.select(*keys).dropDuplicates(keys).orderBy(*[F.col(k).asc_nulls_first() for k in keys])
