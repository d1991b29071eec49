"""Two-pass quality control as declarative rules.

A rule is a condition with a severity, a note, field updates and, for an
exclusion, a reason. A pass is an ordered list of rules; its outcome is one
struct column (result, notes, updates, exclude_reason): the worst severity, the
notes in order, and of updates of one field the last. Both passes and their
merge are one projection, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.hashes import with_hashes
from lectern.operators.keys import unique_notes
from lectern.schemas import absent

SEVERITY = ("pass", "warn", "downgrade", "exclude")
# From the least to the most conservative value.
SCALES = {
    "evidence_level": ("approved_human_indication", "human_clinical_evidence", "animal_preclinical_phenotype_evidence", "in_vitro_target_activity_evidence", "mechanistic_pathway_or_similarity_hypothesis", "unsupported_contradicted_or_unsafe_claim"),
    "evidence_direction": ("positive", "mixed", "inconclusive", "not_reported", "negative", "not_applicable"),
    "claim_status": ("supported", "plausible_but_unproven", "insufficient_information", "unsupported", "contradicted", "unsafe_to_claim"),
    "safety_status": ("known_acceptable_under_approved_use", "insufficient_safety_data", "known_risk", "serious_known_risk", "not_for_human_use"),
    "evidence_validation_status": ("source_supported", "downgraded", "insufficient_information", "excluded"),
}
LABEL_SOURCES = ("dailymed", "regulatory_label")
PATHWAY_SOURCES = ("reactome", "gene_ontology", "opentargets")
SIGNAL_SOURCES = ("sider", "openfda_faers")
ASSAYS = ("KD", "KI", "IC50", "EC50", "MIC", "DG")
MECHANISM = "mechanistic_pathway_or_similarity_hypothesis"
APPROVED = "approved_human_indication"
PROVENANCE = ("benchmark_id", "track", "source_database", "source_id", "source_url", "retrieval_date", "license_or_usage_note", "release_mode", "qc_status", "leakage_group", "split", "processed_record_hash")
OUTCOME = "struct<result:string,notes:array<string>,updates:map<string,string>,exclude_reason:string>"


@dataclass(frozen=True)
class Rule:
    when: Column
    severity: str = "pass"
    note: str | Column | None = None
    updates: dict[str, str] = field(default_factory=dict)


def exclude(when: Column, note: str | Column) -> Rule:
    return Rule(when, "exclude", note)


def _text(c: str | Column | None) -> Column:
    return c if isinstance(c, Column) else F.lit(c).cast("string")


def outcome(rules: list[Rule]) -> Column:
    """Struct of the rules' joint outcome."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    hits = []
    for r in rules:
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in r.updates.items()]).cast("array<struct<k:string,v:string>>")
        hits.append(F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(SEVERITY.index(r.severity)).alias("s"), _text(r.note).alias("n"), pairs.alias("u"))))
    found = F.array_compact(F.array(*hits))
    updates = F.aggregate(F.flatten(F.transform(found, lambda h: h["u"])), empty, lambda m, u: F.map_concat(F.map_filter(m, lambda k, v: k != u["k"]), F.map_from_arrays(F.array(u["k"]), F.array(u["v"]))))
    worst = F.coalesce(F.array_max(F.transform(found, lambda h: h["s"])), F.lit(0))
    reasons = F.filter(found, lambda h: h["s"] == 3)
    return F.struct(
        F.get(F.array(*[F.lit(s) for s in SEVERITY]), worst).alias("result"),
        F.array_compact(F.transform(found, lambda h: h["n"])).alias("notes"),
        updates.alias("updates"),
        F.try_element_at(reasons, F.lit(-1))["n"].alias("exclude_reason"),
    )


def _c(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _many(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.size(F.col(name)), F.lit(0)) if name in df.columns else F.lit(0)


def integrity_rules(df: DataFrame) -> list[Rule]:
    lacking = F.array_compact(F.array(*[F.when(absent(df, c), F.lit(c)) for c in PROVENANCE]))
    only_hash = F.array_join(lacking, ",") == "processed_record_hash"
    return [
        Rule(only_hash, "warn", "processed hash renewed"),
        exclude((F.size(lacking) > 0) & ~only_hash, F.concat(F.lit("missing provenance: "), F.array_join(lacking, ", "))),
        Rule(_c(df, "qc_status") == "external_qc", "warn", "external marker replaced", {"qc_status": "source_checked"}),
        exclude((_c(df, "source_database") == "synthetic_fixture") | _c(df, "synthetic", "boolean"), "synthetic record"),
        Rule(absent(df, "citation"), "warn", "no citation; source url and id kept"),
    ]


def _pose_updates(df: DataFrame, prefix: str) -> list[Rule]:
    contacts, reference = _many(df, "native_contacts") > 0, ~absent(df, "coordinate_reference")
    return [
        Rule(contacts, updates={"pose_subset": "pose_contact_labeled", "contact_label_status": "computed_contacts"}),
        Rule(~contacts & reference, "warn", f"{prefix}coordinates only; no contact metrics", {"pose_subset": "pose_coordinate_reference", "contact_label_status": "coordinate_reference_only"}),
        exclude(~contacts & ~reference, f"{prefix}neither contacts nor coordinates"),
    ]


def track_rules_a(df: DataFrame) -> dict[str, list[Rule]]:
    source, evidence = F.lower(_c(df, "source_database")), _c(df, "evidence_level")
    method = F.lower(F.coalesce(_c(df, "experimental_method"), F.lit("")))
    has_reference = F.col("gold_structure_reference").isNotNull() if "gold_structure_reference" in df.columns else F.lit(False)
    target, peptide = _c(df, "target_chain_id"), _c(df, "peptide_chain_id")
    p_len, t_len = _c(df, "peptide_length", "int"), _c(df, "target_length", "int")
    assay = F.upper(F.coalesce(_c(df, "assay_type"), F.lit("")))
    kinds = sum((assay.contains(t).cast("int") for t in ASSAYS), F.lit(0))
    label = source.isin(*LABEL_SOURCES) & F.lower(F.coalesce(_c(df, "source_evidence_type"), F.lit(""))).contains("label")
    approved = evidence == APPROVED
    trial = (source == "clinicaltrials") & _c(df, "trial_has_results", "boolean").eqNullSafe(False)
    weak = {"claim_status": "plausible_but_unproven", "evidence_validation_status": "downgraded"}
    no_label = F.coalesce(~label, F.lit(True))
    return {
        "structure": [
            exclude(_c(df, "source_database").isin("alphafold_db", "alphafold") & (method.contains("experimental") | has_reference), "predicted structure as experimental gold"),
            exclude(absent(df, "experimental_method"), "no structure source type"),
            exclude(absent(df, "chain_id") & absent(df, "entity_id"), "neither chain nor entity"),
            exclude(absent(df, "structure_file_url"), "no structure file url"),
        ],
        "pose": [
            exclude(absent(df, "target_chain_id") | absent(df, "peptide_chain_id"), "chain missing"),
            exclude(~absent(df, "target_chain_id") & (target == peptide), "chains are the same"),
            exclude(p_len.isNull() | (p_len < 2) | (p_len > 60), "peptide length out of bounds"),
            exclude(t_len.isNull() | (t_len < 30), "target length out of bounds"),
            *_pose_updates(df, ""),
        ],
        "binding_rank": [
            exclude(_many(df, "items") < 5, "fewer than five items"),
            *[exclude(absent(df, c), f"missing {c}") for c in ("assay_type", "assay_unit", "measurement_direction", "normalization_method")],
            exclude(_c(df, "measurement_direction") == "unknown", "unknown measurement direction"),
            exclude(~_c(df, "comparable_panel", "boolean").eqNullSafe(True), "panel not comparable"),
            exclude(kinds > 1, "mixed assay types"),
            Rule(F.lit(True), updates={"assay_compatibility_status": "compatible"}),
        ],
        "human_effect": [
            Rule(approved & no_label, "downgrade", "approved indication without label source", {"evidence_level": MECHANISM, **weak, "safety_status": "insufficient_safety_data"}),
            Rule(approved & label, updates={"evidence_validation_status": "source_supported"}),
            Rule(trial & (_c(df, "evidence_direction") == "positive"), "downgrade", "positive direction of a trial without results", {"evidence_direction": "not_reported", **weak}),
            Rule((source == "clinicaltrials") & ~(trial & F.coalesce(_c(df, "evidence_direction") == "positive", F.lit(False))), updates={"evidence_validation_status": "source_supported"}),
            Rule(source.isin(*PATHWAY_SOURCES) & approved, "downgrade", "pathway source for an approved indication", {"evidence_level": MECHANISM}),
            Rule(source.isin(*PATHWAY_SOURCES), updates={"evidence_validation_status": "source_supported"}),
            Rule(source.isin(*SIGNAL_SOURCES) & (_c(df, "claim_status") == "supported") & (_c(df, "category") != "toxic_adverse_effect_concern"), "downgrade", "safety signal is no support of efficacy", weak),
            Rule(evidence == "unsupported_contradicted_or_unsafe_claim", updates={"evidence_validation_status": "insufficient_information"}),
            Rule((_c(df, "safety_status") == "known_acceptable_under_approved_use") & F.coalesce(~approved, F.lit(True)), "downgrade", "safety without approved use", {"safety_status": "insufficient_safety_data", "evidence_validation_status": "downgraded"}),
        ],
    }


def track_rules_b(df: DataFrame) -> dict[str, list[Rule]]:
    source, evidence = F.lower(F.coalesce(_c(df, "source_database"), F.lit(""))), F.coalesce(_c(df, "evidence_level"), F.lit(""))
    approved, label, pathway = evidence == APPROVED, source.isin(*LABEL_SOURCES), source.isin(*PATHWAY_SOURCES)
    first, second = approved & ~label, approved & label
    unsupported = evidence == "unsupported_contradicted_or_unsafe_claim"
    trial = (source == "clinicaltrials") & _c(df, "trial_has_results", "boolean").eqNullSafe(False)
    incomplete = F.coalesce(F.exists("items", lambda i: i["measured_value"].isNull()), F.lit(False)) if "items" in df.columns else F.lit(False)
    return {
        "structure": [
            exclude(_c(df, "source_database") == "alphafold_db", "second check: predicted structure as gold"),
            exclude(absent(df, "chain_id") & absent(df, "entity_id"), "second check: neither chain nor entity"),
        ],
        "pose": [exclude(_c(df, "target_chain_id").eqNullSafe(_c(df, "peptide_chain_id")), "second check: same chains"), *_pose_updates(df, "second check: ")],
        "binding_rank": [
            exclude((_many(df, "items") < 5) | incomplete, "second check: incomplete panel"),
            exclude(~F.coalesce(_c(df, "measurement_direction").isin("lower_is_stronger", "higher_is_stronger"), F.lit(False)), "second check: invalid direction"),
            exclude(~_c(df, "comparable_panel", "boolean").eqNullSafe(True), "second check: panel not comparable"),
            Rule(F.lit(True), updates={"assay_compatibility_status": "compatible"}),
        ],
        "human_effect": [
            Rule(first, "downgrade", "second check: approved indication without label source", {"evidence_level": MECHANISM, "claim_status": "plausible_but_unproven", "safety_status": "insufficient_safety_data", "evidence_validation_status": "downgraded"}),
            Rule(second, updates={"evidence_validation_status": "source_supported"}),
            Rule(~first & ~second & pathway & (evidence != MECHANISM), "downgrade", "second check: pathway evidence kept at mechanism", {"evidence_level": MECHANISM}),
            Rule(~first & ~second & pathway, updates={"evidence_validation_status": "source_supported"}),
            Rule(~first & ~second & ~pathway & unsupported, updates={"evidence_validation_status": "insufficient_information"}),
            Rule(trial & (_c(df, "evidence_direction") == "positive"), "downgrade", "second check: positive direction of a trial without results", {"evidence_direction": "not_reported"}),
            Rule(source == "clinicaltrials", updates={"evidence_validation_status": "source_supported"}),
        ],
    }


def _by_track(df: DataFrame, own: dict[str, list[Rule]], shared: list[Rule], stop: bool) -> Column:
    track = _c(df, "track")
    scoped = [Rule((track == name) & F.coalesce(r.when, F.lit(False)), r.severity, r.note, r.updates) for name, rules in own.items() for r in rules]
    scoped.append(exclude(F.coalesce(~track.isin(*own), F.lit(True)), "unknown track"))
    if not stop:
        return outcome(shared + scoped)
    before = outcome(shared)
    return F.when(before["result"] == "exclude", before).otherwise(outcome(shared + scoped))


def pass_a(df: DataFrame) -> Column:
    """First pass; provenance failures end it."""
    return _by_track(df, track_rules_a(df), integrity_rules(df), stop=True)


def pass_b(df: DataFrame) -> Column:
    """Independent second pass."""
    shared = [exclude(absent(df, c), f"second check: missing {c}") for c in ("benchmark_id", "track", "source_database", "source_id", "release_mode")]
    shared.append(Rule(_c(df, "qc_status") == "external_qc", "warn", "second check: external marker replaced", {"qc_status": "source_checked"}))
    return _by_track(df, track_rules_b(df), shared, stop=False)


def more_conservative(key: Column, left: Column, right: Column) -> Column:
    """The more conservative of two values of a field; equal ranks keep the left one, fields without a scale take the right one."""
    out = right
    for name, scale in SCALES.items():
        rank = lambda v, s=scale: F.array_position(F.array(*[F.lit(x) for x in s]), v)
        out = F.when(key == name, F.when(rank(right) > rank(left), right).otherwise(left)).otherwise(out)
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(out)


def merged(a: Column, b: Column) -> Column:
    """Union of two update maps, field by field the more conservative value."""
    return F.map_zip_with(a, b, more_conservative)


def differences(a: Column, b: Column) -> Column:
    """Fields on which two update maps disagree."""
    zipped = F.map_zip_with(a, b, lambda k, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(zipped, lambda k, v: v)))


def worst(*results: Column) -> Column:
    order = F.array(*[F.lit(s) for s in SEVERITY])
    return F.element_at(order, reduce(lambda x, y: F.greatest(x, y), [F.array_position(order, r) for r in results]).cast("int"))


def default_subset(df: DataFrame) -> Column:
    contacts = (_c(df, "contact_label_status") == "computed_contacts") & (_many(df, "native_contacts") > 0)
    return (
        F.when(_c(df, "release_mode") == "excluded", "excluded")
        .when(_c(df, "track") == "pose", F.when(contacts, "contact_labeled_subset").otherwise("source_reference_only"))
        .when((_c(df, "track") == "structure") & (_many(df, "gold_coordinates") == 0), "source_reference_only")
        .otherwise("primary")
    )


def check_records(df: DataFrame) -> DataFrame:
    """Adds ``qc``: both passes, their disagreements, merged updates, action, result, resolution, subset and notes."""
    if {"source_record_hash", "processed_record_hash"} <= set(df.columns):
        df = with_hashes(df)
    df = df.withColumn("_a", pass_a(df)).withColumn("_b", pass_b(df))
    df = df.withColumn("_worst", worst(F.col("_a.result"), F.col("_b.result"))).withColumn("_diff", F.concat(F.when(F.col("_a.result") != F.col("_b.result"), F.array(F.lit("result"))).otherwise(F.array().cast("array<string>")), differences(F.col("_a.updates"), F.col("_b.updates")))).withColumn("_new", merged(F.col("_a.updates"), F.col("_b.updates")))
    disagree = F.size("_diff") > 0
    only_validation = disagree & F.forall("_diff", lambda k: k == "evidence_validation_status")
    resolution = F.when(only_validation, "kept_conservative_label").when(disagree & (F.col("_worst") == "downgrade"), "downgraded").when(disagree, "excluded_from_primary_scoring")
    action = F.when(F.col("_worst") == "exclude", "excluded").when(F.col("_worst") == "downgrade", "downgraded").otherwise("kept")
    label = F.when(action == "excluded", "excluded_by_qc").when(action == "downgraded", "downgraded_by_qc").when((F.col("_worst") == "warn") | (resolution == "excluded_from_primary_scoring"), "passed_with_warnings").otherwise("passed_qc")
    subset = F.when(action == "excluded", "excluded").when(resolution == "excluded_from_primary_scoring", "warning_only").otherwise(F.coalesce(F.nullif(_c(df, "scoring_subset"), F.lit("")), default_subset(df)))
    settled = F.when((action == "excluded") & disagree, "excluded").when(action == "excluded", F.lit(None).cast("string")).otherwise(resolution)
    noted = unique_notes(F.col("_a.notes"), F.col("_b.notes"))
    noted = F.when((F.size(noted) == 0) & (action != "excluded"), F.array(F.lit("passed"))).otherwise(noted)
    noted = F.when(disagree & (action != "excluded"), F.array_append(noted, F.concat(F.lit("disagreement resolved as "), resolution))).otherwise(noted)
    qc = F.struct(
        F.col("_a").alias("pass_a"),
        F.col("_b").alias("pass_b"),
        F.col("_diff").alias("disagreements"),
        F.col("_new").alias("updates"),
        action.alias("action"),
        label.alias("qc_result"),
        settled.alias("qc_resolution"),
        subset.alias("scoring_subset"),
        noted.alias("notes"),
        F.coalesce("_a.exclude_reason", "_b.exclude_reason").alias("exclude_reason"),
    )
    return df.withColumn("qc", qc).drop("_a", "_b", "_worst", "_diff", "_new")


UPDATED = ("qc_status", "pose_subset", "contact_label_status", "assay_compatibility_status", "evidence_level", "evidence_direction", "claim_status", "safety_status", "evidence_validation_status")


def apply_qc(checked: DataFrame) -> DataFrame:
    """Records that stay, with the merged updates, results and fresh hashes."""
    kept = checked.where("qc.action <> 'excluded'")
    for c in UPDATED:
        if c in kept.columns:
            kept = kept.withColumn(c, F.coalesce(F.try_element_at("qc.updates", F.lit(c)), F.col(c)))
    own = {"qc_status": F.lit("source_checked"), "qc_result": F.col("qc.qc_result"), "qc_resolution": F.col("qc.qc_resolution"), "scoring_subset": F.col("qc.scoring_subset"), "qc_notes": F.col("qc.notes"), "qc_disagreement": F.size("qc.disagreements") > 0}
    return with_hashes(kept.withColumns(own).drop("qc"))


def excluded_log(checked: DataFrame) -> DataFrame:
    return checked.where("qc.action = 'excluded'").select("benchmark_id", "track", "source_database", "source_id", F.col("qc.exclude_reason").alias("exclusion_reason"))


def cards(checked: DataFrame) -> DataFrame:
    """One card a record: both passes' results, what they disagree on and what became of it."""
    return checked.select("benchmark_id", "track", "source_database", "source_id", F.col("qc.pass_a.result").alias("pass_a_result"), F.col("qc.pass_b.result").alias("pass_b_result"), "qc.disagreements", "qc.action", "qc.qc_result", "qc.qc_resolution", "qc.scoring_subset", F.array_join("qc.notes", "; ").alias("notes"))


def resolve_stored(records: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Resolve stored outcomes again: records joined with both passes' rows (benchmark_id, result, notes, updates), defaults where a pass has none. Only records still there get cards."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    side = lambda d, p: d.select("benchmark_id", F.col("result").alias(f"{p}_result"), F.col("updates").alias(f"{p}_updates"))
    df = records.join(side(a, "a"), "benchmark_id", "left").join(side(b, "b"), "benchmark_id", "left")
    x, y = F.coalesce("a_updates", empty), F.coalesce("b_updates", empty)
    bad = worst(F.coalesce("a_result", F.lit("pass")), F.coalesce("b_result", F.lit("pass")))
    diff = differences(x, y)
    resolution = F.when(F.size(diff) == 0, F.lit(None).cast("string")).when(F.forall(diff, lambda k: k == "evidence_validation_status"), "kept_conservative_label").when(bad == "downgrade", "downgraded").otherwise("excluded_from_primary_scoring")
    return df.select(*records.columns, diff.alias("disagreements"), merged(x, y).alias("updates"), resolution.alias("resolution"))
