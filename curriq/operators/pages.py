"""Search over many packages as pages: one global order, a cursor, and warnings of packages that can't answer.

A page is TakeOrderedAndProject: each task keeps as many of its hits as a page has, whatever the packages hold. The next
page starts after the last key, which its cursor names together with the request and the packages' index fingerprints. In
the scope of one named package a capability that it lacks is an error; in a wider scope the package is left out with a warning.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curriq.functions.text import CodeRules
from curriq.operators import facets, scopes, search
from curriq.operators.paging import decode_cursor, encode_cursor, numbered
from curriq.session import cut, loop_dir

MODES = ("text", "code_exact", "code_prefix")
IDENTITY = ("framework_id", "snapshot_id", "graph_type", "package_revision", "package_id")
TEXT_OFF, CODE_OFF, PREFIX_OFF, CODE_PARTIAL, SEVERAL = "text_search_unavailable", "code_search_unavailable", "code_prefix_unavailable", "partial_code_coverage", "multiple_exact_code_matches"
SHOWN = ("score", "matched_terms", "package_id", "node_id", "normalized_code")
WARNING = "package_id string, code string, node_id string, message string"


class CapabilityError(ValueError):
    """A package that a request names can't answer it."""


@dataclass(frozen=True)
class Request:
    """What is looked for, in which packages: the one of package_id, or those of frameworks, graph types and snapshots."""

    query: str
    mode: str = "text"
    match: str = "any"
    filters: facets.Filters = field(default_factory=facets.Filters)
    package_id: str | None = None
    frameworks: tuple[str, ...] = ()
    graph_types: tuple[str, ...] = ()
    snapshots: tuple[str, ...] = ()
    limit: int = 25

    def __post_init__(self):
        if self.mode not in MODES or self.match not in ("any", "all", "phrase"):
            raise ValueError(f"no search of {self.mode} for {self.match}")
        if not 1 <= self.limit <= 100:
            raise ValueError("a page has 1 to 100 hits")
        if self.mode == "text":
            search.query_terms(self.query)


@dataclass
class Page:
    """hits in order, with their place in the page from 1; warnings, distinct and in order; the cursor of a next page."""

    hits: DataFrame
    warnings: DataFrame
    has_more: bool
    next_cursor: str | None


def _sha(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _warning(rows: DataFrame, code: str, message: Column | str, node: str | None = None) -> DataFrame:
    return rows.select("package_id", F.lit(code).alias("code"), (F.col(node) if node else F.lit(None)).cast("string").alias("node_id"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def modes_text() -> Column:
    """The modes that a package has, as a warning names them."""
    coded = F.col("code_availability") != "none"
    held = F.array_compact(F.array(F.when(F.col("text_search"), "text"), F.when(coded, "code_exact"), F.when(coded & F.col("allow_prefix"), "code_prefix")))
    return F.when(F.size(held) == 0, "none").otherwise(F.array_join(held, ", "))


def able(packages: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """(packages that can answer, warnings of them all); CapabilityError where the one named package can't.

    packages: IDENTITY, text_search, code_availability (none, partial, complete), allow_prefix.
    """
    if request.mode == "text":
        closed = {TEXT_OFF: (~F.col("text_search"), F.lit("The package disables text search and was skipped."))}
    else:
        skipped = lambda what: F.concat(F.lit(f"The package has no {what} and was skipped; its search modes: "), modes_text(), F.lit("."))
        closed = {CODE_OFF: (F.col("code_availability") == "none", skipped("statement codes"))}
        if request.mode == "code_prefix":
            closed[PREFIX_OFF] = ((F.col("code_availability") != "none") & ~F.col("allow_prefix"), skipped("code prefix search"))
    off = F.lit(False)
    for test, _ in closed.values():
        off = off | test
    if request.package_id is not None:
        lacking = packages.where(off).select(*[F.when(test, code).alias(code) for code, (test, _) in closed.items()]).first()
        if lacking is not None:
            raise CapabilityError(f"{request.package_id}: {next(c for c in lacking if c)}")
    told = [_warning(packages.where(test), code, message) for code, (test, message) in closed.items()]
    if request.mode != "text":
        told.append(_warning(packages.where(~off & (F.col("code_availability") == "partial")), CODE_PARTIAL, "The package has partial code coverage; its other nodes are found by text."))
    warnings = told[0]
    for more in told[1:]:
        warnings = warnings.unionByName(more)
    return packages.where(~off), warnings


def ranked(nodes: DataFrame, packages: DataFrame, policies: DataFrame, request: Request, rules: CodeRules, code_scopes: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """All hits with their facets, and the columns that order them (ascending)."""
    placed = nodes.join(packages.select(*IDENTITY), "package_id")
    kept = tuple(dict.fromkeys([*placed.columns]))
    if request.mode == "text":
        found = search.phrase_search(placed, "text", request.query, kept).drop("query_terms") if request.match == "phrase" else search.token_search(placed, "text", request.query, request.match == "all", kept)
        found, first = found.withColumn("descending", -F.col("score")), "descending"
        found = facets.evidence(found, policies)
    else:
        prefix = request.mode == "code_prefix"
        found, first = search.code_search(placed, "code", request.query, rules, prefix, kept), "normalized_code"
        found = facets.evidence(found.withColumn("matched_terms", F.lit(rules.normalize_prefix(request.query) if prefix else rules.normalize(request.query))), policies, code_scopes, nodes)
    # facets are looked at after the candidates are found
    return found.where(facets.matches(request.filters)), [first, *IDENTITY, "node_id", "seo"]


def whole_search(nodes: DataFrame, packages: DataFrame, policies: DataFrame, request: Request, rules: CodeRules | None = None, code_scopes: DataFrame | None = None) -> DataFrame:
    """The hits of all pages of a request, with their place among all: one search, however many pages. See `search_page`."""
    chosen = scopes.select_packages(packages, request.package_id, list(request.frameworks), list(request.graph_types), list(request.snapshots))
    hits, keys = ranked(nodes, able(chosen, request)[0], policies, request, rules or CodeRules(), code_scopes)
    shown = [c for c in SHOWN if c in hits.columns]
    placed = numbered(hits.select(*dict.fromkeys([*shown, *keys, *facets.EVIDENCE])), keys, loop_dir(nodes.sparkSession))
    return placed.select("place", *shown, *facets.EVIDENCE)


def search_page(nodes: DataFrame, packages: DataFrame, policies: DataFrame, request: Request, cursor: str | None = None, rules: CodeRules | None = None, code_scopes: DataFrame | None = None) -> Page:
    """A page of standards.

    nodes: package_id, node_id, seo, text, code, and what `facets.evidence` reads. packages: see `able`, and index_sha256.
    code_scopes (package_id, node_id, scope_id) hand grades down to hits of codes. Hits: place, score, matched_terms, package_id,
    node_id, for codes normalized_code, and the facets. A cursor of another request or other indexes is an error.
    """
    rules = rules or CodeRules()
    chosen = scopes.select_packages(packages, request.package_id, list(request.frameworks), list(request.graph_types), list(request.snapshots))
    usable, warnings = able(chosen, request)
    # packages of a request are a list for the reader: their ids and fingerprints come to the driver
    known = chosen.select(*IDENTITY, "index_sha256").orderBy("package_id").collect()
    asked = asdict(request) | {"query": search.split_tokens(request.query) if request.mode == "text" else rules.normalize(request.query), "raw": request.query}
    query_sha, index_sha = _sha([asked, [list(r)[:-1] for r in known]]), _sha([[r.package_id, r.index_sha256] for r in known])
    hits, keys = ranked(nodes, usable, policies, request, rules, code_scopes)
    if request.mode == "code_exact":
        # found once, read by the page and by the warnings
        hits = cut(hits, loop_dir(nodes.sparkSession), "hits")
        several = hits.groupBy("package_id").agg(F.count("*").alias("n")).where("n > 1")
        warnings = warnings.unionByName(_warning(hits.join(several, "package_id"), SEVERAL, "Several standards of the package have this code.", "node_id"))
    if cursor is not None:
        last = decode_cursor(cursor, query_sha, index_sha)
        spot = F.struct(*[F.lit(v).cast(hits.schema[k].dataType).alias(k) for k, v in zip(keys, last, strict=True)])
        if hits.where(F.struct(*keys) == spot).isEmpty():
            raise LookupError("the cursor's hit is not among the results")
        hits = hits.where(F.struct(*keys) > spot)
    shown = [c for c in SHOWN if c in hits.columns]
    first = cut(hits.select(*dict.fromkeys([*shown, *keys, *facets.EVIDENCE])).orderBy(*keys).limit(request.limit + 1), loop_dir(nodes.sparkSession), "page")
    # a window over one hit more than the page
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    ends = placed.where(F.col("place") >= request.limit).select("place", *keys).orderBy("place").collect()
    more = len(ends) > 1
    page = placed.where(F.col("place") <= request.limit).select("place", *shown, *facets.EVIDENCE)
    return Page(page, scopes.ordered_warnings(warnings), more, encode_cursor(query_sha, index_sha, list(ends[0])[1:]) if more else None)
