"""Rules on whole packages: manifest, profile and root against each other, components against the root, and rules in order.

packages: package_id and three structs. manifest: framework_id, snapshot_id, local_subject, normalized_subjects,
subject_mapping_status, subject_mapping_note, languages, local_grades, normalized_grades, name, adoption_status, is_current,
jurisdiction, issuing_authority, provider, source_version, rights (with attribution_statement, source_license among its
fields). profile: framework_ids, relationship_type, local_subject, normalized_subjects, subject_mapping_status, subject_mapping_note,
languages, grade_labels, stage_labels, grade_mapping (arrays of normalized grades), rights. root: node_id, name, academic_subject,
adoption_status, is_current, jurisdiction, author, provider, attribution_statement, license, in_language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIERARCHY = "hasChild"
#: Code of a finding, what it is about, and both sides.
PAIRS = (
    ("manifest_profile_local_subject_mismatch", "framework local subject", "manifest.local_subject", "profile.local_subject"),
    ("manifest_profile_normalized_subjects_mismatch", "framework normalized subjects", "manifest.normalized_subjects", "profile.normalized_subjects"),
    ("manifest_profile_subject_mapping_status_mismatch", "framework subject mapping status", "manifest.subject_mapping_status", "profile.subject_mapping_status"),
    ("manifest_profile_subject_mapping_note_mismatch", "framework subject mapping note", "manifest.subject_mapping_note", "profile.subject_mapping_note"),
    ("manifest_profile_languages_mismatch", "framework languages", "manifest.languages", "profile.languages"),
    ("manifest_profile_local_grades_mismatch", "framework local grades or stages", "manifest.local_grades", "own.local_grades"),
    ("manifest_profile_normalized_grades_mismatch", "framework normalized grades", "manifest.normalized_grades", "own.normalized_grades"),
    ("manifest_profile_rights_mismatch", "package rights policy", "manifest.rights", "profile.rights"),
    ("manifest_root_name_mismatch", "framework name", "manifest.name", "root.name"),
    ("manifest_root_subject_mismatch", "framework academic subject", "manifest.local_subject", "root.academic_subject"),
    ("manifest_root_adoption_status_mismatch", "framework adoption status", "manifest.adoption_status", "root.adoption_status"),
    ("manifest_root_current_status_mismatch", "framework current status", "manifest.is_current", "root.is_current"),
    ("manifest_root_jurisdiction_mismatch", "framework jurisdiction", "manifest.jurisdiction", "root.jurisdiction"),
    ("manifest_root_author_mismatch", "framework issuing authority", "manifest.issuing_authority", "root.author"),
    ("manifest_root_provider_mismatch", "framework provider", "manifest.provider", "root.provider"),
    ("manifest_root_attribution_mismatch", "framework attribution statement", "manifest.rights.attribution_statement", "root.attribution_statement"),
    ("manifest_root_license_mismatch", "framework source license", "manifest.rights.source_license", "root.license"),
    ("manifest_snapshot_version_mismatch", "framework source version", "manifest.source_version", "own.version"),
)
#: What components inherit, have to have, and may not have (wire name: column).
INHERITED = ("academic_subject", "attribution_statement", "license")
REQUIRED = {"academicSubject": "academic_subject", "attributionStatement": "attribution_statement", "author": "author", "identifier": "property_identifier", "inLanguage": "in_language", "license": "license", "provider": "provider"}
PUBLISHED = {"caseIdentifierURI": "case_identifier_uri", "caseIdentifierUUID": "case_identifier_uuid", "adoptionStatus": "adoption_status", "isCurrent": "is_current", "jurisdiction": "jurisdiction"}


def _told(rows: DataFrame, record: str, told: list[Column]) -> DataFrame:
    """(package_id, code, record_id, message) of the structs (code, message) that aren't null."""
    found = rows.withColumn("__told", F.explode(F.array_compact(F.array(*told))))
    return found.select("package_id", "__told.code", F.col(record).cast("string").alias("record_id"), "__told.message")


def _if(test: Column, code: str, message: str) -> Column:
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))


def framework_rules(packages: DataFrame) -> DataFrame:
    """(package_id, code, record_id, message): every pair of fields that has to be equal and isn't, nulls equal to nulls and
    lists in order; a profile of other frameworks or another hierarchy; a root in a language that the manifest hasn't."""
    own = packages.withColumn("own", F.struct(
        F.array_distinct(F.concat("profile.grade_labels", "profile.stage_labels")).alias("local_grades"), F.array_distinct(F.flatten("profile.grade_mapping")).alias("normalized_grades"),
        F.regexp_extract("manifest.snapshot_id", r"@(.*)\+[^+]*$", 1).alias("version"),
    ))
    pairs = [_if(~F.col(a).eqNullSafe(F.col(b)), code, f"{name} differs") for code, name, a, b in PAIRS]
    member = lambda values, value: F.coalesce(F.array_contains(values, F.col(value)), F.lit(False))
    more = [
        _if(~member("profile.framework_ids", "manifest.framework_id"), "profile_framework_id_mismatch", "the profile doesn't declare the framework"),
        _if(~F.col("profile.relationship_type").eqNullSafe(F.lit(HIERARCHY)), "profile_relationship_type_unsupported", "another hierarchy than that of deliveries"),
        _if(~member("manifest.languages", "root.in_language"), "framework_root_language_mismatch", "the root's language isn't the manifest's"),
    ]
    return _told(own, "root.node_id", [*more[:2], *pairs, more[2]])


def component_rules(components: DataFrame, roots: DataFrame) -> DataFrame:
    """(package_id, code, record_id, message): components (package_id, node_id, ...) whose inherited fields differ from their
    root's (roots: package_id, INHERITED), that lack a required field or have one of published standards."""
    met = components.join(roots.select("package_id", F.struct(*INHERITED).alias("__root")), "package_id", "left")
    told = [_if(~F.col(c).eqNullSafe(F.col(f"__root.{c}")), "learning_component_framework_metadata_mismatch", c) for c in INHERITED]
    told += [_if(F.col(c).isNotNull(), "learning_component_published_property_present", name) for name, c in PUBLISHED.items()]
    told += [_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", "learning_component_required_property_absent", name) for name, c in REQUIRED.items()]
    return _told(met, "node_id", told)


def of_packages(findings: DataFrame, owners: DataFrame) -> DataFrame:
    """Findings (code, record_id, ...) of records with the package that owns them (owners: record_id, package_id)."""
    return findings.join(owners.select("record_id", "package_id").distinct(), "record_id")


def settled_rules(packages: DataFrame, findings: DataFrame, gates: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """((package_id, gate, code, record_id), findings that stand) of rules in order, for all packages at once.

    gates: groups of codes; each rests on those before it, so where one fails, findings of later ones are hidden. The first row
    names the first failure: lowest gate, then code in the gate's order, then record; null codes: nothing failed. Codes that no
    gate names come last.
    """
    places = {code: (g, i) for g, codes in enumerate(gates) for i, code in enumerate(codes)}
    known = F.create_map(*[x for code, (g, i) in places.items() for x in (F.lit(code), F.struct(F.lit(g).alias("gate"), F.lit(i).alias("i")))]) if places else None
    last = F.struct(F.lit(len(gates)).alias("gate"), F.lit(0).alias("i"))
    placed = findings.withColumn("__at", F.coalesce(F.try_element_at(known, F.col("code")), last) if places else last)
    first = placed.groupBy("package_id").agg(F.min(F.struct("__at.gate", "__at.i", "code", "record_id")).alias("f"))
    verdict = packages.select("package_id").distinct().join(first, "package_id", "left").select("package_id", "f.gate", "f.code", "f.record_id")
    standing = placed.join(first.select("package_id", F.col("f.gate").alias("__gate")), "package_id").where(F.col("__at.gate") <= F.col("__gate")).drop("__at", "__gate")
    return verdict, standing


#: The order in which evidence of progressions is checked.
EVIDENCE_GATES = [
    ["shard-missing", "shard-count", "shard-digest"], ["delivery-prefix", "delivery-prefix-type", "delivery-missing", "delivery-surplus", "delivery-order"], ["provenance-missing", "provenance-surplus", "id-taken"],
    ["claim-decision", "lp_judgment_direction", "lp_claim_identity_mismatch", "lp_claim_endpoint_mismatch", "lp_trace_identity_mismatch", "lp_final_pair_conflict", "lp_unresolved_mismatch", "lp_final_counts_mismatch"],
    ["report-count"], ["topology-count", "topology-cycle"], ["lp_source_credit_mismatch"],
]
