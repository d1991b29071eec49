"""Release checks, counts, status grids and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.keys import union_all, with_order
from lectern.schemas import DOMAINS, TRACKS, absent, quote_too_long

MINIMUM = {"structure": 200, "pose": 100, "binding_rank": 25, "human_effect": 200}
LEAST_CONTACT_MAPS = 25
# The files of a release to publish.
REQUIRED_FILES = ("release_manifest.json", "release_metadata_summary.json", "quality_check_summary.json", "source_manifest_snapshot.yaml", "source_status_report.jsonl", "references/source_ids.jsonl", "references/citations.jsonl", "references/nonredistributable_source_index.jsonl", "references/exclusion_log.jsonl", "references/case_qc_cards.jsonl", "references/qc_pass_a.jsonl", "references/qc_pass_b.jsonl")


def audit_rules(df: DataFrame) -> tuple[Column, Column]:
    """(errors, warnings) arrays of one case."""
    has = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    effect, panel, pose = (F.col("track") == t for t in ("human_effect", "binding_rank", "pose"))
    lacking = F.lit(False)
    for c in ("source_database", "source_id", "source_version", "retrieval_date", "license_or_usage_note", "qc_status", "split"):
        lacking = lacking | absent(df, c)
    contacts = F.coalesce(F.size("native_contacts"), F.lit(0)) if "native_contacts" in df.columns else F.lit(0)
    errors = [
        (lacking, "missing provenance"),
        (quote_too_long(has("evidence_quote_or_label")), "quote too long"),
        (effect & (has("evidence_level") == "approved_human_indication") & ~F.lower(has("source_database")).isin("dailymed", "regulatory_label"), "approved indication needs a label source"),
        (effect & has("trial_has_results", "boolean").eqNullSafe(False) & (has("evidence_direction") == "positive"), "trial without results is no positive evidence"),
        (effect & (has("claim_status") == "supported") & (has("evidence_level") == "mechanistic_pathway_or_similarity_hypothesis"), "pathway evidence alone supports no claim"),
        (panel & absent(df, "normalization_method"), "panel without normalization"),
        (panel & (has("measurement_direction") == "unknown"), "panel with unknown direction"),
        (panel & has("comparable_panel", "boolean").eqNullSafe(False) & absent(df, "panel_exclusion_reason"), "incomparable panel without reason"),
        (pose & (absent(df, "target_chain_id") | absent(df, "peptide_chain_id")), "pose without chains"),
    ]
    warnings = [(has("qc_status") == "unchecked", "unchecked"), (pose & (contacts == 0), "no contact labels")]
    pack = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules]))
    return pack(errors), pack(warnings)


def audit(df: DataFrame) -> DataFrame:
    """(benchmark_id, severity, message) of each finding."""
    errors, warnings = audit_rules(df)
    both = F.concat(F.transform(errors, lambda m: F.struct(F.lit("error").alias("severity"), m.alias("message"))), F.transform(warnings, lambda m: F.struct(F.lit("warning").alias("severity"), m.alias("message"))))
    return df.select("benchmark_id", F.explode(both).alias("f")).select("benchmark_id", "f.*")


def count_violations(cases: DataFrame, minimum: dict[str, int] | None = None) -> DataFrame:
    """(track, n, minimum) of the tracks with too few cases, those without any included."""
    need = cases.sparkSession.createDataFrame(list((minimum or MINIMUM).items()), "track string, minimum int")
    return need.join(cases.groupBy("track").agg(F.count(F.lit(1)).alias("n")), "track", "left").select("track", F.coalesce("n", F.lit(0)).alias("n"), "minimum").where("n < minimum")


def release_check(cases: DataFrame, minimum: dict[str, int] | None = None, files: DataFrame | None = None, required: tuple[str, ...] = REQUIRED_FILES) -> DataFrame:
    """(scope, message) of all violations: case counts, contact maps, audit errors, files that are missing or not allowed."""
    parts = [
        count_violations(cases, minimum).select(F.col("track").alias("scope"), F.format_string("%d cases, %d needed", F.col("n").cast("int"), "minimum").alias("message")),
        audit(cases).where("severity = 'error'").select(F.col("benchmark_id").alias("scope"), "message"),
    ]
    if "native_contacts" in cases.columns:
        maps = cases.agg(F.count_if((F.col("track") == "pose") & (F.coalesce(F.size("native_contacts"), F.lit(0)) > 0)).alias("n"))
        parts.append(maps.where(F.col("n") < LEAST_CONTACT_MAPS).select(F.lit("pose").alias("scope"), F.format_string("%d contact maps, %d needed", F.col("n").cast("int"), F.lit(LEAST_CONTACT_MAPS)).alias("message")))
    if files is not None:
        names = files.select(F.substring_index("path", "/", -1).alias("name"))
        parts.append(missing_files(files, required))
        parts.append(names.where(F.lower("name").endswith(".md")).select(F.col("name").alias("scope"), F.lit("file not allowed").alias("message")))
    return union_all(*parts)


def missing_files(files: DataFrame, required: tuple[str, ...] = REQUIRED_FILES) -> DataFrame:
    """(scope, message) of the required files that no path of ``files`` (path) ends with."""
    need = files.sparkSession.createDataFrame([(r, r.count("/") + 1) for r in required], "scope string, parts int")
    depths = sorted({r.count("/") + 1 for r in required})
    have = union_all(*[files.select(F.substring_index("path", "/", -d).alias("scope")) for d in depths]).distinct()
    return need.join(have, "scope", "left_anti").select("scope", F.lit("file missing").alias("message"))


def caveats(df: DataFrame) -> Column:
    """What a reader of a case should know, as an array in fixed order."""
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False)) if c in df.columns else F.lit(False)
    return F.array_compact(F.array(
        F.lit("source-backed; no external qc claimed"),
        F.when(is_("release_mode", "source_reference_only"), "source-reference-only record; raw source record is not bundled"),
        F.when(is_("track", "pose") & is_("contact_label_status", "coordinate_reference_only"), "excluded from contact-labeled leaderboard subset"),
        F.when(is_("track", "human_effect"), "evidence classification only; not medical advice or human-use validation"),
    ))


def unreferenced(cases: DataFrame, index: DataFrame) -> DataFrame:
    """Source-reference cases that the reference index lacks."""
    keys = ["benchmark_id", "source_database", "source_id"]
    return cases.where("release_mode = 'source_reference_only'").select(*keys).join(index.select(*keys).distinct(), keys, "left_anti")


def publish_check(cases: DataFrame, index: DataFrame, cards: DataFrame, texts: DataFrame, minimum: dict[str, int] | None = None) -> DataFrame:
    """(scope, message): the release check, the index, unresolved cards, unknown words and prohibited claims in the texts (name, text)."""
    from lectern.functions.text import claim_errors

    vocabulary = cases.select("benchmark_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*DOMAINS[c]), F.lit(f"{c}: unknown value")) for c in ("qc_status", "qc_result", "scoring_subset", "release_mode") if c in cases.columns]))).alias("message"))
    return union_all(
        release_check(cases, minimum),
        unreferenced(cases, index).select(F.col("benchmark_id").alias("scope"), F.lit("not in the reference index").alias("message")),
        cards.where("size(disagreements) > 0 and qc_resolution is null and action <> 'excluded'").select(F.col("benchmark_id").alias("scope"), F.lit("disagreement not resolved").alias("message")),
        vocabulary.withColumnRenamed("benchmark_id", "scope"),
        texts.select(F.col("name").alias("scope"), F.explode(claim_errors(F.col("text"))).alias("message")),
    )


def counts_by_source(cases: DataFrame) -> DataFrame:
    """Cases of each source, a column a track."""
    return cases.groupBy("source_database").pivot("track", list(TRACKS)).count().na.fill(0)


def histogram(cases: DataFrame, column: str, domain: str | None = None) -> DataFrame:
    """(value, n) over the whole domain, zeros included."""
    values = cases.sparkSession.createDataFrame([(v,) for v in DOMAINS[domain or column]], "value string")
    return values.join(cases.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value", "left").na.fill(0, ["n"])


def status_grid(manifest: DataFrame, cases: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row for each source and track: manifest fields, cases, exclusions and the most frequent release mode (the first seen on ties)."""
    cases = with_order(cases)
    names = manifest.select(F.col("name").alias("source_database")).union(cases.select("source_database")).distinct()
    grid = names.select("source_database", F.explode(F.array(*[F.lit(t) for t in TRACKS])).alias("track"))
    keys = ["source_database", "track"]
    modes = cases.groupBy(*keys, "release_mode").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen")).groupBy(*keys).agg(F.sum("n").alias("cases"), F.min_by("release_mode", F.struct(-F.col("n"), "seen")).alias("release_mode"))
    gone = excluded.groupBy(*keys).agg(F.count(F.lit(1)).alias("excluded"))
    about = manifest.select(F.col("name").alias("source_database"), *[c for c in ("bucket", "adapter_status", "raw_redistribution") if c in manifest.columns])
    return grid.join(modes, keys, "left").join(gone, keys, "left").join(about, "source_database", "left").na.fill(0, ["cases", "excluded"])


def references(cases: DataFrame) -> dict[str, DataFrame]:
    """Source ids, citations, and the index of what may not be redistributed."""
    restricted = (F.col("release_mode") == "source_reference_only") | (F.col("redistribution_policy_snapshot.raw_data_redistribution") != "allowed")
    return {
        "source_ids": cases.select("benchmark_id", "track", "source_database", "source_id", "source_url"),
        "citations": cases.where(F.coalesce("citation", F.lit("")) != "").select("benchmark_id", "citation").distinct(),
        "nonredistributable": cases.where(restricted).select("benchmark_id", "source_database", "source_id", "release_mode"),
    }


def bucket_policy(bucket: Column, raw: Column) -> Column:
    """Message where a source of bucket B or C doesn't allow redistribution of raw data."""
    return F.when(bucket.isin("B", "C") & (raw != "allowed"), F.concat(F.lit("bucket "), bucket, F.lit(": raw data may not be redistributed")))


def final_label(track: Column) -> Column:
    """JSON of the label that a case ends with, by track."""
    return (
        F.when(track == "human_effect", F.to_json(F.struct("category", "evidence_level", "evidence_direction", "claim_status", "safety_status")))
        .when(track == "binding_rank", F.to_json(F.struct("panel_id", "measurement_direction", F.size("items").alias("items"))))
        .when(track == "pose", F.to_json(F.struct("pose_subset", "contact_label_status", F.size("native_contacts").alias("contacts"))))
        .when(track == "structure", F.to_json(F.struct("structure_id", "experimental_method", "resolution_angstrom")))
    )


def governance_note(note: Column, affects: Column) -> Column:
    """Public wording of an internal note."""
    low = F.lower(note)
    return F.when(low.contains("license"), "License terms limit what is redistributed.").when(low.contains("no cases") | ~affects, "No case of the current release comes from this source.").when(low.contains("manual") | low.contains("curation"), "Labels were checked against the source.").otherwise(note)


def metadata(cases: DataFrame, cards: DataFrame) -> DataFrame:
    """(kind, key, n): cases by track, release mode and subset; cards by action and resolution."""
    count = lambda d, c: d.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("kind"), "key", "n")
    return union_all(*[count(cases, c) for c in ("track", "release_mode", "scoring_subset") if c in cases.columns], *[count(cards, c) for c in ("action", "qc_resolution")])
