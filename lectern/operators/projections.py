"""Case projections: what a model may see, what must not leak, prompts and curation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from lectern.functions.hashes import source_hash
from lectern.functions.text import options
from lectern.operators.ordering import positions
from lectern.operators.splits import case_split

# Gold and QC fields that no model input may hold, and the columns that each mode and track shows.
FORBIDDEN = frozenset({"labels", "expected_output", "gold_labels", "label_ranking", "category", "evidence_level", "evidence_direction", "claim_status", "safety_status", "evidence_validation_status", "final_label_summary", "native_contacts", "gold_coordinates", "measured_value", "normalized_rank", "baseline_outputs", "prediction", "predictions", "scoring_metadata", "qc_result", "qc_notes", "qc_status", "qc_disagreement", "qc_resolution"})
COMMON = ("benchmark_id", "track", "source_database", "release_mode")
PROVENANCE = ("source_id", "source_url", "citation", "source_version", "retrieval_date")
SHOWN = {
    "human_effect": ("peptide", "claim_text"),
    "binding_rank": ("panel_id", "target_id", "target_name", "assay_type", "assay_unit", "assay_conditions", "measurement_direction", "normalization_method"),
    "pose": ("pdb_id", "target_chain_id", "peptide_chain_id", "peptide_length", "target_length", "peptide", "target", "pose_subset", "contact_label_status"),
    "structure": ("peptide", "structure_id", "chain_id", "entity_id", "peptide_length"),
}
SHOWN_WITH_TOOLS = {
    "human_effect": ("target", "source_evidence_type", "source_result_count", "trial_status", "trial_phase", "trial_has_results", "mechanism_support"),
    "binding_rank": (),
    "pose": ("coordinate_reference", "contact_map_method"),
    "structure": ("structure_file_url", "experimental_method", "resolution_angstrom", "scoring_subset"),
}
TOOLS = "tools_high_reasoning"


def without_forbidden(c: Column, kind: DataType) -> tuple[Column, DataType]:
    """The value without forbidden fields at any depth, rebuilt from its schema."""
    if isinstance(kind, StructType):
        parts = [(f.name, *without_forbidden(c[f.name], f.dataType)) for f in kind.fields if f.name not in FORBIDDEN]
        new = StructType()
        for name, _, t in parts:
            new = new.add(name, t)
        return F.when(c.isNotNull(), F.struct(*[p.alias(n) for n, p, _ in parts])) if parts else F.lit(None), new
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        _, inner = without_forbidden(F.lit(None), kind.elementType)
        return F.transform(c, lambda x: without_forbidden(x, kind.elementType)[0]), ArrayType(inner)
    return c, kind


def strip_forbidden(df: DataFrame) -> DataFrame:
    return df.select(*[without_forbidden(F.col(f"`{f.name}`"), f.dataType)[0].alias(f.name) for f in df.schema.fields if f.name not in FORBIDDEN])


def forbidden_paths(kind: DataType, path: str = "$") -> list[str]:
    """JSON paths of forbidden fields that a schema still has."""
    out: list[str] = []
    if isinstance(kind, StructType):
        for f in kind.fields:
            here = f"{path}.{f.name}"
            out += [here] if f.name in FORBIDDEN else forbidden_paths(f.dataType, here)
    elif isinstance(kind, ArrayType):
        out += forbidden_paths(kind.elementType, f"{path}[*]")
    return out


def sanitize(cases: DataFrame, track: str, mode: str) -> DataFrame:
    """Model input of a track and mode; an error names every forbidden field that would remain."""
    names = [*COMMON, *(PROVENANCE if mode == TOOLS else ()), *SHOWN[track], *(SHOWN_WITH_TOOLS[track] if mode == TOOLS else ())]
    df = strip_forbidden(cases.select(*[n for n in names if n in cases.columns], *(["items"] if track == "binding_rank" and "items" in cases.columns else [])))
    if "items" in df.columns:
        df = df.withColumn("candidate_peptides", F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), i["peptide"].alias("peptide")))).drop("items")
    left = forbidden_paths(df.schema)
    if left:
        raise ValueError(f"forbidden input fields: {', '.join(left)}")
    return df


def prompts(sanitized: DataFrame, track: str, instructions: str, size: int | None = None) -> DataFrame:
    """Chat messages: one row a case, or one a chunk of ``size`` cases by id."""
    record = F.to_json(F.struct(*sanitized.columns))
    system = F.struct(F.lit("system").alias("role"), F.lit(instructions).alias("content"))
    user = lambda text: F.struct(F.lit("user").alias("role"), text.alias("content"))
    if size is None:
        return sanitized.select("benchmark_id", F.array(system, user(F.concat(F.lit(f"Track: {track}. Case: "), record))).alias("messages"))
    packed = positions(sanitized.select("benchmark_id", record.alias("record")), ["benchmark_id"]).groupBy(F.floor(F.col("position") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("position", "benchmark_id", "record"))).alias("c"))
    text = F.concat(F.lit(f"Track: {track}. Cases: ["), F.array_join(F.transform("c", lambda x: x["record"]), ","), F.lit("]"))
    return packed.select("chunk", F.transform("c", lambda x: x["benchmark_id"]).alias("benchmark_ids"), F.array(system, user(text)).alias("messages"))


def repair_prompt(raw: Column, expected: Column) -> Column:
    """Message that asks for the JSON alone after an answer that couldn't be parsed."""
    return F.concat(F.lit("Return only the JSON object for these ids: "), F.array_join(expected, ", "), F.lit(". Previous answer: "), F.left(raw, F.lit(4000)))


def prompt_prefix(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The turns before the first assistant's; conversations without one keep all."""
    first = turns.where(F.col(role) == "assistant").groupBy(conversation).agg(F.min(turn).alias("_first"))
    return turns.join(first, conversation, "left").where(F.col("_first").isNull() | (F.col(turn) < F.col("_first"))).drop("_first")


def trainable(rows: DataFrame) -> DataFrame:
    """Rows with a non-empty list of messages."""
    return rows.where(F.coalesce(F.size("messages"), F.lit(0)) > 0)


def base_fields(csv: DataFrame, track: str, retrieval_date: str) -> DataFrame:
    """CSV rows of strings as case rows with defaults: empty cells take them."""
    get = lambda name, default: F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")) if name in csv.columns else F.lit(None).cast("string"), F.lit(default))
    own = {
        "track": F.lit(track),
        "release_mode": get("release_mode", "source_reference_only"),
        "source_version": get("source_version", "unknown"),
        "retrieval_date": get("retrieval_date", retrieval_date),
        "license_or_usage_note": get("license_or_usage_note", "see source"),
        "qc_status": get("qc_status", "unchecked"),
        "split": get("split", "test"),
        "source_record_hash": F.sha2(F.to_json(F.struct(*sorted(csv.columns))), 256),
    }
    return csv.withColumns(own)


def as_bool(c: Column) -> Column:
    """true, 1 and yes; an empty cell is null."""
    low = F.lower(F.trim(c))
    return F.when(low == "", F.lit(None).cast("boolean")).otherwise(low.isin("true", "1", "yes"))


def prepare(csv: DataFrame, track: str, retrieval_date: str) -> DataFrame:
    """Curated CSV rows of a track with typed columns."""
    from lectern.schemas import case_schema

    df = base_fields(csv, track, retrieval_date)
    kinds = {f.name: f.dataType for f in case_schema(track).fields}
    for name in csv.columns:
        kind = kinds.get(name)
        if kind is None or name in ("track",):
            continue
        simple = kind.simpleString()
        if simple == "boolean":
            df = df.withColumn(name, as_bool(F.col(name)))
        elif simple in ("int", "double"):
            df = df.withColumn(name, F.col(name).try_cast(simple))
        elif simple == "array<string>":
            df = df.withColumn(name, options(F.replace(F.col(name), F.lit(";"), F.lit(","))))
        elif simple.startswith(("array", "struct")):
            df = df.withColumn(name, F.from_json(name, kind))
    for json_name, name in (("items_json", "items"), ("native_contacts_json", "native_contacts")):
        if json_name in csv.columns and name in kinds:
            df = df.withColumn(name, F.from_json(json_name, kinds[name]))
    if "sequence" in csv.columns:
        df = df.withColumn("peptide", F.struct(F.col("sequence").alias("sequence"), F.array().cast("array<string>").alias("modifications"), F.lit(None).cast("string").alias("description")))
    return df


def envelope(df: DataFrame, hint: str) -> DataFrame:
    """Split by turns and source hash of freshly built cases."""
    return df.withColumn("split", case_split(F.col(hint))).withColumn("source_record_hash", source_hash(F.col("source_database"), F.col("source_id"), F.col("source_url")))
