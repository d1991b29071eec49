"""Record schemas, closed value domains and row validation.

A record is validated by one array column of messages, so a table is checked in
one projection; violations are the exploded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRACKS = ("structure", "pose", "binding_rank", "human_effect")

_PEPTIDE = "peptide STRUCT<sequence: STRING, modifications: ARRAY<STRING>, description: STRING>"
_XYZ = "ARRAY<STRUCT<atom_id: STRING, residue_id: STRING, x: DOUBLE, y: DOUBLE, z: DOUBLE>>"
_CONTACTS = "ARRAY<STRUCT<target_residue: STRING, peptide_residue: STRING, distance_angstrom: DOUBLE>>"

# The record formats.
CASE_BASE = (
    "benchmark_id STRING, track STRING, release_mode STRING, source_database STRING, source_id STRING, source_url STRING, source_version STRING, retrieval_date STRING, license_or_usage_note STRING, "
    "redistribution_policy_snapshot STRUCT<raw_data_redistribution: STRING, processed_label_redistribution: STRING, commercial_use: STRING, attribution_required: BOOLEAN, share_alike_obligation: BOOLEAN, use_in_public_leaderboard: STRING>, "
    "curator_notes STRING, qc_status STRING, qc_result STRING, qc_notes ARRAY<STRING>, qc_disagreement BOOLEAN, qc_resolution STRING, scoring_subset STRING, exclusion_reason STRING, citation STRING, evidence_quote_or_label STRING, "
    "source_record_hash STRING, processed_record_hash STRING, split STRING, leakage_group STRUCT<peptide_cluster: STRING, target_family: STRING, interface_cluster: STRING, source_release_date: STRING, panel_id: STRING>"
)
CASE_OWN = {
    "structure": f"{_PEPTIDE}, structure_id STRING, chain_id STRING, entity_id STRING, peptide_length INT, structure_file_url STRING, experimental_method STRING, resolution_angstrom DOUBLE, gold_structure_reference STRUCT<source_database: STRING, source_id: STRING, source_url: STRING, source_version: STRING, retrieval_date: STRING, citation: STRING>, gold_coordinates {_XYZ}, confidence_notes STRING",
    "pose": f"{_PEPTIDE}, target STRUCT<protein: STRUCT<name: STRING, accession: STRING, chain_id: STRING, sequence: STRING>, organism: STRING, target_family: STRING>, pdb_id STRING, target_chain_id STRING, peptide_chain_id STRING, peptide_length INT, target_length INT, contact_map_method STRING, coordinate_reference STRING, native_contacts {_CONTACTS}, binding_site_residues ARRAY<STRING>, orientation_label STRING, pose_subset STRING, contact_label_status STRING",
    "binding_rank": f"panel_id STRING, target_id STRING, target_name STRING, assay_type STRING, assay_unit STRING, assay_conditions STRING, measurement_direction STRING, normalization_method STRING, comparable_panel BOOLEAN, panel_exclusion_reason STRING, items ARRAY<STRUCT<item_id: STRING, {_PEPTIDE.replace('peptide ', 'peptide: ')}, measured_value: DOUBLE, normalized_rank: DOUBLE>>, source_ids ARRAY<STRING>, assay_compatibility_status STRING",
    "human_effect": f"{_PEPTIDE}, claim_text STRING, category STRING, evidence_level STRING, evidence_direction STRING, claim_status STRING, safety_status STRING, source_evidence_type STRING, target STRING, mechanism_support STRING, source_result_count INT, trial_status STRING, trial_phase STRING, trial_has_results BOOLEAN, evidence_validation_status STRING",
}
PREDICTION_BASE = "prediction_id STRING, benchmark_id STRING, track STRING, model_name STRING, status STRING, json_valid BOOLEAN, schema_valid BOOLEAN, error_type STRING, error_message STRING"
PREDICTION_OWN = {
    "structure": f"coordinates {_XYZ}, confidence DOUBLE",
    "pose": f"predicted_contacts {_CONTACTS}, binding_site_residues ARRAY<STRING>, orientation_label STRING, clash_score DOUBLE",
    "binding_rank": "scores ARRAY<STRUCT<item_id: STRING, score: DOUBLE, rank: INT>>",
    "human_effect": "category STRING, evidence_level STRING, evidence_direction STRING, claim_status STRING, safety_status STRING, abstained BOOLEAN, rationale_source_ids ARRAY<STRING>",
}

# The closed domains.
DOMAINS = {
    "track": TRACKS,
    "split": ("train", "dev", "test"),
    "qc_status": ("unchecked", "source_checked", "external_qc", "excluded"),
    "source_bucket": ("A", "B", "C"),
    "redistribution": ("allowed", "restricted", "unknown"),
    "leaderboard_use": ("allowed", "caution", "avoid"),
    "adapter_status": ("planned", "stub", "implemented"),
    "release_mode": ("bundled", "derived", "source_reference_only", "excluded"),
    "qc_result": ("passed_qc", "passed_with_warnings", "downgraded_by_qc", "excluded_by_qc"),
    "contact_label_status": ("computed_contacts", "coordinate_reference_only", "source_interface_reference", "excluded"),
    "assay_compatibility_status": ("compatible", "compatible_with_normalization", "incompatible_excluded"),
    "evidence_validation_status": ("source_supported", "downgraded", "insufficient_information", "excluded"),
    "qc_resolution": ("kept_conservative_label", "downgraded", "excluded_from_primary_scoring", "excluded"),
    "scoring_subset": ("primary", "source_reference_only", "contact_labeled_subset", "warning_only", "excluded"),
    "category": ("metabolic_weight_glucose", "endocrine_hormonal", "antimicrobial_antiinfective", "anticancer_tumor_homing", "immune_vaccine_antigen_presentation", "neuro_cns", "cardiovascular", "reproductive", "diagnostic_imaging", "toxic_adverse_effect_concern", "no_known_human_effect_evidence"),
    "evidence_level": ("approved_human_indication", "human_clinical_evidence", "animal_preclinical_phenotype_evidence", "in_vitro_target_activity_evidence", "mechanistic_pathway_or_similarity_hypothesis", "unsupported_contradicted_or_unsafe_claim"),
    "evidence_direction": ("positive", "negative", "mixed", "inconclusive", "not_reported", "not_applicable"),
    "claim_status": ("supported", "plausible_but_unproven", "unsupported", "contradicted", "unsafe_to_claim", "insufficient_information"),
    "safety_status": ("known_acceptable_under_approved_use", "known_risk", "serious_known_risk", "insufficient_safety_data", "not_for_human_use"),
    "measurement_direction": ("lower_is_stronger", "higher_is_stronger", "unknown"),
}
REQUIRED = ("benchmark_id", "track", "release_mode", "source_database", "source_id", "source_url", "retrieval_date", "license_or_usage_note", "qc_status", "split")
QUOTE_WORDS = 35


def case_schema(track: str) -> StructType:
    return StructType.fromDDL(f"{CASE_BASE}, {CASE_OWN[track]}")


def prediction_schema(track: str) -> StructType:
    return StructType.fromDDL(f"{PREDICTION_BASE}, {PREDICTION_OWN[track]}")


def missing(c: Column, kind: str = "string") -> Column:
    """True where a value is null, empty, zero or an empty collection, as Python's truth would have it."""
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) <= 0, F.lit(True))
    if kind == "string":
        return F.coalesce(c == "", F.lit(True))
    if kind == "boolean":
        return ~F.coalesce(c, F.lit(False))
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal"):
        return F.coalesce(c == 0, F.lit(True))
    return c.isNull()


def absent(df: DataFrame, name: str) -> Column:
    """``missing`` for a column by name; a column that the table lacks is missing in every row."""
    return missing(F.col(name), dict(df.dtypes)[name]) if name in df.columns else F.lit(True)


def messages(*rules: tuple[Column, str | Column]) -> Column:
    """Array of the messages of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in rules])) if rules else F.array().cast("array<string>")


def in_domain(name: str, domain: str | None = None) -> Column:
    return F.col(name).isin(*DOMAINS[domain or name])


def quote_too_long(c: Column, most: int = QUOTE_WORDS) -> Column:
    """More words than may be quoted."""
    return F.coalesce(F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")) > most, F.lit(False))


def sequence_ok(c: Column) -> Column:
    """Not empty and without white space."""
    return F.coalesce((F.length(c) > 0) & ~c.rlike(r"\s"), F.lit(False))


def residues_ok(contacts: Column) -> Column:
    """Both residue labels of every contact name a chain (``chain:residue``), and no distance is negative."""
    return F.coalesce(F.forall(contacts, lambda c: c["target_residue"].contains(":") & c["peptide_residue"].contains(":") & (F.coalesce(c["distance_angstrom"], F.lit(0.0)) >= 0)), F.lit(True))


def case_errors(df: DataFrame, track: str) -> Column:
    """Messages for each violated constraint of a case."""
    rules = [(absent(df, c), f"{c}: required") for c in REQUIRED]
    rules += [(F.col(c).isNotNull() & ~in_domain(c), f"{c}: not in domain") for c in DOMAINS if c in df.columns]
    rules.append((F.col("track") != track, "track: another track"))
    rules.append((quote_too_long(F.col("evidence_quote_or_label")), "evidence_quote_or_label: too many words"))
    if "peptide" in df.columns:
        rules.append((~sequence_ok(F.col("peptide.sequence")), "peptide.sequence: empty or with white space"))
    if track == "structure":
        rules.append((F.col("resolution_angstrom") <= 0, "resolution_angstrom: not positive"))
    if track == "pose":
        rules.append((~residues_ok(F.col("native_contacts")), "native_contacts: residue without chain or negative distance"))
    if track == "binding_rank":
        rules.append((F.coalesce(F.size("items"), F.lit(-1)) < 2, "items: fewer than two"))
        rules.append((F.exists("items", lambda i: (i["normalized_rank"] < 0) | (i["normalized_rank"] > 1)), "items.normalized_rank: outside 0..1"))
    return messages(*rules)


def prediction_errors(df: DataFrame, track: str) -> Column:
    """Messages for each violated constraint of a prediction."""
    rules = [(absent(df, c), f"{c}: required") for c in ("prediction_id", "benchmark_id", "track", "model_name")]
    rules.append((F.col("track") != track, "track: another track"))
    if track == "structure":
        rules.append(((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence: outside 0..1"))
    if track == "pose":
        rules += [(F.col("clash_score") < 0, "clash_score: negative"), (~residues_ok(F.col("predicted_contacts")), "predicted_contacts: residue without chain or negative distance")]
    if track == "binding_rank":
        rules += [(F.coalesce(F.size("scores"), F.lit(-1)) < 1, "scores: none"), (F.exists("scores", lambda s: s["rank"] < 1), "scores.rank: below 1")]
    if track == "human_effect":
        rules += [(F.col(c).isNotNull() & ~in_domain(c), f"{c}: not in domain") for c in ("category", "evidence_level", "evidence_direction", "claim_status", "safety_status")]
    return messages(*rules)


def validate(df: DataFrame, track: str) -> DataFrame:
    """The table with ``errors``; a record with a prediction_id is a prediction."""
    errors = prediction_errors(df, track) if "prediction_id" in df.columns else case_errors(df, track)
    return df.withColumn("errors", errors)


def validation_report(validated: DataFrame, key: str = "benchmark_id") -> DataFrame:
    """(key, error) of each violation."""
    return validated.select(F.col(key), F.explode("errors").alias("error"))


def without_nulls(df: DataFrame) -> Column:
    """The record as JSON; null fields are left out."""
    return F.to_json(F.struct(*df.columns))
