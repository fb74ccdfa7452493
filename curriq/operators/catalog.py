"""The catalog of packages: filters, snapshot choice, building families, capabilities and comparisons.

Packages: framework_id, snapshot_id, package_id, graph_type, is_current, status, array columns of facets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curriq.functions.text import facet_key, facet_keys, facet_text
from curriq.operators.paging import keyset_page


def text_filter(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose normalized columns hold every word of the query as a substring."""
    hay = F.concat_ws("\x1f", *[facet_key(c) for c in columns])
    for word in facet_text(query).split(" "):
        rows = rows.where(F.contains(hay, F.lit(word))) if word else rows
    return rows


def member_filter(column: str, wanted: list[str] | None) -> Column:
    """Does the value, or array of values, meet the wanted ones? Nothing wanted: always."""
    if not wanted:
        return F.lit(True)
    keys = F.array(*[F.lit(facet_text(w)) for w in wanted])
    return F.coalesce(F.arrays_overlap(facet_keys(column), keys), F.lit(False))


def select_snapshot(packages: DataFrame, framework_id: str, snapshot_id: str | None = None) -> str:
    """The snapshot asked for, or the only current one; none or several are errors."""
    own = packages.where(F.col("framework_id") == framework_id)
    own = own.where(F.col("snapshot_id") == snapshot_id) if snapshot_id else own.where("is_current")
    found = [r[0] for r in own.select("snapshot_id").distinct().limit(2).collect()]
    if not found:
        raise LookupError(f"no snapshot of {framework_id}")
    if len(found) > 1:
        raise LookupError(f"{framework_id} has several current snapshots")
    return found[0]


def build_catalog(packages: DataFrame) -> DataFrame:
    """Accepted packages as families: framework_id, snapshots (each with its packages), in order of ids."""
    accepted = packages.where("status = 'passed'")
    snapshots = accepted.groupBy("framework_id", "snapshot_id").agg(F.max("is_current").alias("is_current"), F.sort_array(F.collect_list(F.struct("graph_type", "package_id"))).alias("packages"))
    return snapshots.groupBy("framework_id").agg(F.sort_array(F.collect_list(F.struct("snapshot_id", "is_current", "packages"))).alias("snapshots")).orderBy("framework_id")


def catalog_conflicts(packages: DataFrame) -> DataFrame:
    """(conflict, id): repeated packages, two packages of a snapshot and type, snapshots of two families."""
    twice = lambda keys, name, shown: packages.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("conflict"), F.col(shown).alias("id"))
    families = packages.groupBy("snapshot_id").agg(F.count_distinct("framework_id").alias("n")).where("n > 1").select(F.lit("snapshot-families").alias("conflict"), F.col("snapshot_id").alias("id"))
    return twice(["package_id"], "package-twice", "package_id").unionByName(twice(["snapshot_id", "graph_type"], "route-twice", "snapshot_id")).unionByName(families)


def search_modes(text: Column, code: Column, prefix: Column, tags: Column) -> Column:
    """The search modes that a package has, in the order text, tag, code, code prefix."""
    return F.array_compact(F.array(F.when(text, "text"), F.when(tags, "tag"), F.when(code, "code"), F.when(code & prefix, "code_prefix")))


def rights(reviewed: Column, full_text: Column, bulk: Column, size: Column, most: int) -> Column:
    """allowed, or the first gate that closes."""
    return F.when(~reviewed, "not_reviewed").when(~full_text, "no_full_text").when(~bulk & (size > most), "no_bulk").otherwise("allowed")


def compare_sections(sections: DataFrame, hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    """For each section (framework_id) its k first hits, and one row with a null hit for those without any."""
    if not 1 <= k <= 10:
        raise ValueError("a section shows 1 to 10 hits")
    w = Window.partitionBy("framework_id").orderBy(*order)
    best = hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return sections.select("framework_id").distinct().join(best, "framework_id", "left")


@dataclass(frozen=True)
class ListRequest:
    """What frameworks are listed: free text, currency, graph types, statuses, normalized members of array columns, and a page."""

    query: str = ""
    current: bool | None = None
    graph_types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    members: tuple[tuple[str, tuple[str, ...]], ...] = ()
    limit: int = 25
    after: tuple[str, str] | None = None


def list_frameworks(packages: DataFrame, request: ListRequest) -> DataFrame:
    """A page of snapshots (framework_id, snapshot_id, is_current, graph_types, package_ids, total) in order of their ids.

    Filters are combined; a snapshot passes those on types and statuses if any of its packages does, so its row shows all of
    them. Array columns of a snapshot's packages are put together. total counts what passes, whatever the page; `after` is the
    last (framework_id, snapshot_id) of the page before and has to be among them. packages: as above, and name.
    """
    arrays = [c for c, _ in request.members]
    whole = packages.groupBy("framework_id", "snapshot_id").agg(
        F.max("is_current").alias("is_current"), F.sort_array(F.collect_set("graph_type")).alias("graph_types"), F.sort_array(F.collect_set("package_id")).alias("package_ids"), F.collect_set("status").alias("statuses"), F.min("name").alias("name"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in arrays],
    )
    if request.current is not None:
        whole = whole.where(F.col("is_current") == request.current)
    for column, wanted in (("graph_types", request.graph_types), ("statuses", request.statuses)):
        whole = whole.where(F.arrays_overlap(column, F.array(*map(F.lit, wanted)))) if wanted else whole
    for column, wanted in request.members:
        whole = whole.where(member_filter(column, list(wanted)))
    found = text_filter(whole, ["framework_id", "snapshot_id", "name"], request.query)
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    return keyset_page(found.join(total, F.lit(True)).select("framework_id", "snapshot_id", "is_current", "graph_types", "package_ids", "total"), ["framework_id", "snapshot_id"], list(request.after) if request.after else None, request.limit)
