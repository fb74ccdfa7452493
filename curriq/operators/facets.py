"""Facet evidence of standards, with grades handed down from code scopes, and the filters that read it.

A profile's policies are one row a package (`profiles`), so evidence is an expression over a row of nodes joined with its
package's profile. All comparisons are between facet keys: folded text with single spaces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.functions.text import facet_key, facet_keys, facet_text

PROFILE = """package_id string, grade_mappings array<struct<label:string,keys:array<string>,grade_keys:array<string>>>, subject_keys array<string>,
  normalized_subjects array<string>, statement_types map<string,string>"""
GROUPING = "Standard Grouping"


@dataclass(frozen=True)
class Profile:
    """Policies of a package: grade mappings (local label, aliases, normalized grades) in order, the local subject with its
    aliases, the normalized subjects it stands for, and statement types with their aliases."""

    package_id: str
    grades: list[tuple[str, list[str], list[str]]] = field(default_factory=list)
    subjects: list[str] = field(default_factory=list)
    normalized_subjects: list[str] = field(default_factory=list)
    statement_types: dict[str, list[str]] = field(default_factory=dict)

    def row(self) -> tuple:
        mappings = [(label, [facet_text(x) for x in (label, *aliases)], [facet_text(g) for g in grades]) for label, aliases, grades in self.grades]
        types: dict[str, str] = {}
        for name, aliases in self.statement_types.items():
            for key in map(facet_text, (name, *aliases)):
                if types.setdefault(key, name) != name:
                    raise ValueError(f"{key} names two statement types of {self.package_id}")
        keys = [k for _, own, _ in mappings for k in set(own)]
        if len(set(keys)) < len(keys):
            raise ValueError(f"a grade label of {self.package_id} names two mappings")
        return self.package_id, mappings, [facet_text(s) for s in self.subjects], list(self.normalized_subjects), types


def profiles(spark: SparkSession, policies: list[Profile]) -> DataFrame:
    return spark.createDataFrame([p.row() for p in policies], PROFILE)


@dataclass(frozen=True)
class Filters:
    """Facets that a request asks for: values of one facet are alternatives, facets are combined; none asked: all pass.
    Groupings are left out unless asked for."""

    include_groupings: bool = False
    normalized_statement_types: tuple[str, ...] = ()
    local_grade_labels: tuple[str, ...] = ()
    normalized_grades: tuple[str, ...] = ()
    local_subjects: tuple[str, ...] = ()
    normalized_subjects: tuple[str, ...] = ()
    statement_types: tuple[str, ...] = ()


def inherited_grades(scopes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(package_id, node_id, scope_grades): grades of a node's scopes (package_id, node_id, scope_id), in order of the
    scopes' (seo, node_id), as arrays one after another; repeated grades stay for `evidence` to drop."""
    own = nodes.select("package_id", F.col("node_id").alias("scope_id"), "seo", "grade_level")
    met = scopes.join(own, ["package_id", "scope_id"]).dropDuplicates(["package_id", "node_id", "scope_id"])
    listed = met.groupBy("package_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("seo", "scope_id", F.coalesce("grade_level", F.array().cast("array<string>")).alias("grades")))).alias("s"))
    return listed.select("package_id", "node_id", F.flatten("s.grades").alias("scope_grades"))


def evidence(nodes: DataFrame, policies: DataFrame, scopes: DataFrame | None = None, scope_nodes: DataFrame | None = None) -> DataFrame:
    """nodes with their facets: local_subject, node_grade_levels, normalized_grades (own, then scopes', each once),
    normalized_subjects (the profile's, if the subject is one of its own), resolved_local_grade_labels (in the profile's order).

    nodes: package_id, node_id, seo, grade_level, academic_subject, statement_type, normalized_statement_type.
    scopes, if asked for: package_id, node_id, scope_id; scope_nodes holds those nodes, if `nodes` doesn't. Nodes of
    packages without a profile have no labels and subjects.
    """
    none = F.array().cast("array<string>")
    if scopes is None:
        placed = nodes.withColumn("scope_grades", none)
    else:
        placed = nodes.join(inherited_grades(scopes, nodes if scope_nodes is None else scope_nodes), ["package_id", "node_id"], "left")
    placed = placed.join(policies, "package_id", "left")
    own = F.coalesce("grade_level", none)
    placed = placed.withColumns({"node_grade_levels": own, "normalized_grades": F.array_distinct(F.concat(own, F.coalesce("scope_grades", none))), "local_subject": F.col("academic_subject")})
    placed = placed.withColumns({"grade_keys": facet_keys("normalized_grades"), "subject_key": facet_key("academic_subject"), "type_key": facet_key("statement_type")})
    meets = F.filter("grade_mappings", lambda m: F.arrays_overlap(m["grade_keys"], F.col("grade_keys")))
    known = F.coalesce(F.array_contains("subject_keys", F.col("subject_key")), F.lit(False))
    placed = placed.withColumns({
        "resolved_local_grade_labels": F.coalesce(F.transform(meets, lambda m: m["label"]), none), "normalized_subjects": F.when(known, F.col("normalized_subjects")).otherwise(none),
        "subject_known": known, "canonical_type": F.try_element_at("statement_types", F.col("type_key")),
    })
    return placed.drop("scope_grades", "subject_key", "type_key")


def _keys(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(facet_text(v)) for v in values])


def matches(filters: Filters) -> Column:
    """Do a row's facets (`evidence`) fit? An unknown label, subject or type that is asked for matches nothing of its own."""
    test = F.lit(True)
    if not filters.include_groupings:
        test &= ~F.col("normalized_statement_type").eqNullSafe(F.lit(GROUPING))
    if filters.normalized_statement_types:
        test &= F.coalesce(F.col("normalized_statement_type").isin(*filters.normalized_statement_types), F.lit(False))
    if filters.local_grade_labels:
        asked = F.filter("grade_mappings", lambda m: F.arrays_overlap(m["keys"], _keys(filters.local_grade_labels)))
        test &= F.coalesce(F.arrays_overlap(F.flatten(F.transform(asked, lambda m: m["grade_keys"])), F.col("grade_keys")), F.lit(False))
    if filters.normalized_grades:
        test &= F.arrays_overlap("grade_keys", _keys(filters.normalized_grades))
    if filters.local_subjects:  # a profile has one subject: a known one that is asked for is that of a row whose own is known
        test &= F.col("subject_known") & F.coalesce(F.arrays_overlap("subject_keys", _keys(filters.local_subjects)), F.lit(False))
    if filters.normalized_subjects:
        test &= F.arrays_overlap(facet_keys("normalized_subjects"), _keys(filters.normalized_subjects))
    if filters.statement_types:
        asked = F.transform(_keys(filters.statement_types), lambda k: F.try_element_at(F.col("statement_types"), k))
        test &= F.coalesce(F.array_contains(F.array_compact(asked), F.col("canonical_type")), F.lit(False))
    return test


EVIDENCE = ("local_subject", "node_grade_levels", "normalized_grades", "normalized_statement_type", "normalized_subjects", "resolved_local_grade_labels", "statement_type")
