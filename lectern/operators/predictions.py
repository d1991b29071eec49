"""From model answers to predictions: extraction, normalisation, matching with cases, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.json import extraction
from lectern.functions.numbers import clamp
from lectern.operators.keys import union_all
from lectern.schemas import DOMAINS

MOST_CONTACTS = 50
_CONTACTS = "array<struct<target_residue:string,peptide_residue:string,distance_angstrom:double>>"
#: What a field outside its domain becomes.
DEFAULTS = {"category": "no_known_human_effect_evidence", "evidence_level": "unsupported_contradicted_or_unsafe_claim", "evidence_direction": "not_applicable", "claim_status": "insufficient_information", "safety_status": "insufficient_safety_data"}


def parsed(answers: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Answers with ``payload`` (VARIANT, null if there is none), ``method`` and ``json_valid``."""
    found = answers.withColumn("_x", extraction(key)(F.col(text)))
    return found.withColumn("payload", F.try_parse_json("_x.payload")).withColumn("method", F.col("_x.method")).withColumn("json_valid", F.col("payload").isNotNull()).drop("_x")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("payload", path, kind)


def in_domain_or(c: Column, field: str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(s.isin(*DOMAINS[field]), s).otherwise(DEFAULTS[field])


def clean_contacts(c: Column, most: int = MOST_CONTACTS) -> Column:
    """Contacts whose labels name a chain, distances not negative, the first ``most``."""
    good = F.filter(F.coalesce(c, F.array().cast(_CONTACTS)), lambda x: x["target_residue"].contains(":") & x["peptide_residue"].contains(":") & (F.coalesce(x["distance_angstrom"], F.lit(0.0)) >= 0))
    return F.slice(good, 1, most)


def predictions(answers: DataFrame, track: str, model: str) -> DataFrame:
    """Predictions from parsed answers (benchmark_id, payload): other names of fields accepted, numbers clamped, words put into their domains."""
    base = [F.concat_ws(":", F.lit(model), "benchmark_id").alias("prediction_id"), F.col("benchmark_id"), F.lit(track).alias("track"), F.lit(model).alias("model_name"), F.when(F.col("payload").isNull(), "failed").otherwise("completed").alias("status"), F.col("payload").isNotNull().alias("json_valid")]
    if track == "human_effect":
        own = [in_domain_or(_get(f"$.{f}", "string"), f).alias(f) for f in DEFAULTS] + [F.coalesce(_get("$.abstained", "boolean"), F.lit(False)).alias("abstained")]
    elif track == "pose":
        contacts = F.coalesce(_get("$.predicted_contacts", _CONTACTS), _get("$.contacts", _CONTACTS))
        own = [clean_contacts(contacts).alias("predicted_contacts"), F.coalesce(_get("$.binding_site_residues", "array<string>"), F.array().cast("array<string>")).alias("binding_site_residues"), _get("$.orientation_label", "string").alias("orientation_label"), F.greatest(F.lit(0.0), F.coalesce(_get("$.clash_score", "double"), F.lit(0.0))).alias("clash_score")]
    elif track == "structure":
        xyz = "array<struct<atom_id:string,residue_id:string,x:double,y:double,z:double>>"
        confidence = clamp(F.coalesce(_get("$.confidence", "double"), F.lit(0.0)))
        coordinates = F.coalesce(_get("$.coordinates", xyz), F.array().cast(xyz))
        own = [coordinates.alias("coordinates"), F.when((F.size(coordinates) == 0) & (confidence == 0), 0.01).otherwise(confidence).alias("confidence")]
    else:
        own = [_get("$.scores", "array<struct<item_id:string,score:double,rank:int>>").alias("scores")]
    return answers.select(*base, *own)


def zipped_scores(scores: Column, items: Column) -> Column:
    """Scores given as bare numbers, set against the case's items in order; surplus numbers are dropped."""
    return F.transform(F.slice(F.arrays_zip(F.slice(items, 1, F.size(scores)).alias("i"), F.slice(scores, 1, F.size(items)).alias("s")), 1, F.least(F.size(items), F.size(scores))), lambda x: F.struct(x["i"]["item_id"].alias("item_id"), x["s"].alias("score")))


def regrouped(flat: DataFrame, order: str = "ord") -> DataFrame:
    """Flat rows (benchmark_id, item_id, score) as one prediction a benchmark, scores in order."""
    return flat.groupBy("benchmark_id").agg(F.array_sort(F.collect_list(F.struct(order, "item_id", "score"))).alias("s")).select("benchmark_id", F.transform("s", lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"))).alias("scores"))


def matching_errors(found: DataFrame, cases: DataFrame) -> DataFrame:
    """(benchmark_id, error): answers to unknown cases and cases without an answer."""
    both = found.select("benchmark_id").distinct().withColumn("_f", F.lit(True)).join(cases.select("benchmark_id").distinct().withColumn("_c", F.lit(True)), "benchmark_id", "full")
    error = F.when(F.col("_c").isNull(), "unknown benchmark_id").when(F.col("_f").isNull(), "missing prediction")
    return both.select("benchmark_id", error.alias("error")).where("error is not null")


def failed(cases: DataFrame, model: str, message: str = "unresolved_invalid_json") -> DataFrame:
    """Predictions that stand for failures: counted, and wrong in every metric."""
    return cases.select(F.concat_ws(":", F.lit(model), "benchmark_id").alias("prediction_id"), "benchmark_id", F.lit("human_effect").alias("track"), F.lit(model).alias("model_name"), F.lit("failed").alias("status"), F.lit(False).alias("json_valid"), F.lit(False).alias("schema_valid"), F.lit("unresolved_invalid_json").alias("error_type"), F.lit(message).alias("error_message"))


def report_notes(payload: str = "payload", sections: tuple[str, ...] = ("summary", "evidence", "contacts", "confidence")) -> Column:
    """Notes on what a report lacks of its template."""
    return F.array_compact(F.array(*[F.when(F.try_variant_get(payload, f"$.{s}", "variant").isNull(), F.lit(f"{s}: missing")) for s in sections]))


def stats_by_task(rows: DataFrame) -> DataFrame:
    """(task_type, n, valid, valid_rate) of sanity rows."""
    return rows.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("schema_valid").alias("valid")).withColumn("valid_rate", F.col("valid") / F.col("n"))


def sanity_summary(rows: DataFrame, holdout_count: int, model_name: str, source: str) -> DataFrame:
    """One row over all tasks of sanity rows (task_type, json_valid, parse_valid, schema_valid): counts, rates and the same by task; completed only where there are rows and all are valid JSON."""
    tasks = rows.withColumn("task_type", F.coalesce(F.nullif("task_type", F.lit("")), F.lit("unknown")))
    each = tasks.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("json_valid", "parse_valid", "schema_valid")])
    by_task = F.array_sort(F.collect_list(F.struct("task_type", "n", F.col("schema_valid").alias("valid"), (F.col("schema_valid") / F.col("n")).alias("valid_rate"))))  # a row a task
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = each.agg(total("n").alias("attempted"), *[total(c).alias(f"{c}_count") for c in ("json_valid", "parse_valid", "schema_valid")], by_task.alias("validity_by_task_type"))
    rate = F.coalesce(F.try_divide("json_valid_count", "attempted"), F.lit(0.0))
    status = F.when((F.col("attempted") > 0) & (F.col("json_valid_count") == F.col("attempted")), "completed").otherwise("completed_with_warnings")
    same = {"prediction_count": F.col("attempted"), "sampled_examples": F.col("attempted"), "json_valid_rate": rate, "json_validity": rate, "schema_adherence": rate}
    return out.select(status.alias("status"), "*", *[v.alias(k) for k, v in same.items()], F.lit(model_name).alias("model_name"), F.lit(holdout_count).cast("long").alias("holdout_examples_available"), F.lit(source).alias("source"))


def complete_with_fallback(found: DataFrame, cases: DataFrame, fallback: DataFrame) -> DataFrame:
    """Answers there are, and the fallback for every other case."""
    rest = fallback.join(found.select("benchmark_id"), "benchmark_id", "left_anti").join(cases.select("benchmark_id"), "benchmark_id", "left_semi")
    return union_all(found, rest)
