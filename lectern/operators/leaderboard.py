"""Leaderboard: track scores, coverage, strict row status, ranks and the public rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import clamp, count_of
from lectern.functions.text import provider
from lectern.operators.keys import last_by, union_all, with_order
from lectern.operators.retries import latest

RANKABLE = ("clean_completed", "completed_with_failures")
STATUSES = (*RANKABLE, "excluded_provider_error", "excluded_invalid_json", "excluded_incomplete", "noncompetitive_baseline", "noncompetitive_oracle")
MODES = {"base": ("human_effect", "binding_rank"), "tools_high_reasoning": ("human_effect", "binding_rank", "pose", "structure")}
COUNTS = ("retry_queue_size", "retry_recovered_count", "retry_still_failed_count", "fallback_prediction_count", "unresolved_provider_error_count", "post_retry_api_error_count", "api_error_count", "unresolved_invalid_json_count", "post_retry_invalid_json_count", "invalid_json_count", "failed_prediction_count")
COLUMNS = {
    "model_id": "string", "provider": "string", "mode": "string", "is_baseline": "boolean", "mean_score": "double", "coverage_adjusted_score": "double", "scored": "boolean", "competitive": "boolean",
    "coverage": "map<string,struct<attempted:int,completed:int>>", "total_cases_attempted": "bigint", "total_cases_completed": "bigint", "valid_prediction_rate": "double",
    "human_effect_category_macro_f1": "double", "human_effect_evidence_accuracy": "double", "human_effect_overclaim_penalty": "double", "binding_rank_spearman": "double", "binding_rank_kendall": "double", "binding_rank_pairwise_accuracy": "double",
    "pose_contact_precision": "double", "pose_contact_recall": "double", "pose_contact_f1": "double", "structure_score": "double", "structure_rmsd_status": "string", "benchmark_release": "string", "run_timestamp": "string", **{c: "bigint" for c in COUNTS},
}


def complete(rows: DataFrame) -> DataFrame:
    """Rows with every column of a leaderboard; those that are missing are null."""
    return rows.select(*[c for c in rows.columns if c not in COLUMNS], *[(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()])


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def track_score(track: Column, n_cases: Column) -> Column:
    """Score of one track from its metric columns; null for structures without RMSD."""
    five = ("category_macro_f1", "evidence_level_ordinal_accuracy", "evidence_direction_accuracy", "claim_status_accuracy", "unsupported_claim_detection_rate")
    effect = F.greatest(F.lit(0.0), sum((_number(c) for c in five), F.lit(0.0)) / 5 - _number("overclaim_penalty") / F.greatest(n_cases, F.lit(1)))
    binding = ((_number("spearman") + 1) / 2 + (_number("kendall_tau") + 1) / 2 + _number("pairwise_ranking_accuracy")) / 3
    precision, recall = _number("interface_contact_precision"), _number("interface_contact_recall")
    pose = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    structure = 1 / (1 + F.col("all_atom_rmsd").try_cast("double"))
    return F.when(track == "human_effect", effect).when(track == "binding_rank", binding).when(track == "pose", pose).when(track == "structure", structure)


METRICS = ("category_macro_f1", "evidence_level_ordinal_accuracy", "evidence_direction_accuracy", "claim_status_accuracy", "unsupported_claim_detection_rate", "overclaim_penalty", "spearman", "kendall_tau", "pairwise_ranking_accuracy", "interface_contact_precision", "interface_contact_recall", "all_atom_rmsd")


def with_track_scores(results: DataFrame) -> DataFrame:
    """Results (track, n_cases, metric columns or none of them) with ``score``."""
    for c in METRICS:
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast("double"))
    return results.withColumn("score", track_score(F.col("track"), F.col("n_cases")))


def rows_from_results(results: DataFrame) -> DataFrame:
    """One row a model and mode from its track results: mean of the scores there are, coverage by track, metrics side by side."""
    scored = with_track_scores(results)
    of = lambda track, c: F.max(F.when(F.col("track") == track, F.col(c)))
    entry = F.struct("track", F.struct(F.col("attempted").cast("int").alias("attempted"), F.col("completed").cast("int").alias("completed")))
    rows = scored.groupBy("model_id", "mode").agg(
        F.avg("score").alias("mean_score"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("coverage"),
        F.sum("attempted").alias("total_cases_attempted"),
        F.sum("completed").alias("total_cases_completed"),
        of("human_effect", "category_macro_f1").alias("human_effect_category_macro_f1"),
        of("human_effect", "evidence_level_ordinal_accuracy").alias("human_effect_evidence_accuracy"),
        of("human_effect", "overclaim_penalty").alias("human_effect_overclaim_penalty"),
        of("binding_rank", "spearman").alias("binding_rank_spearman"),
        of("binding_rank", "kendall_tau").alias("binding_rank_kendall"),
        of("binding_rank", "pairwise_ranking_accuracy").alias("binding_rank_pairwise_accuracy"),
        of("pose", "interface_contact_precision").alias("pose_contact_precision"),
        of("pose", "interface_contact_recall").alias("pose_contact_recall"),
        of("pose", "score").alias("pose_contact_f1"),
        of("structure", "score").alias("structure_score"),
    )
    return complete(rows.withColumn("provider", provider(F.col("model_id"))))


def coverage_fraction() -> Column:
    """Completed over attempted cases of all tracks, else of the totals, clamped; 0 where nothing was attempted."""
    total = lambda field: F.aggregate(F.coalesce(F.map_values("coverage"), F.array()), F.lit(0), lambda s, x: s + F.coalesce(x[field], F.lit(0)))
    attempted, completed = total("attempted"), total("completed")
    by_totals = F.coalesce(F.try_divide(F.coalesce("total_cases_completed", F.lit(0)), F.coalesce("total_cases_attempted", F.lit(0))), F.lit(0.0))
    return clamp(F.when(attempted > 0, F.try_divide(completed, attempted)).otherwise(by_totals))


def is_oracle_name(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("oracle") & ~low.contains("non_oracle")


def is_sanity() -> Column:
    """Rows that copy labels, or ran as a sanity check."""
    low = F.lower(F.coalesce("model_id", F.lit("")))
    return (is_oracle_name(F.col("model_id")) & ~low.contains("non-oracle")) | F.col("mode").eqNullSafe("sanity_check")


def _or_else(*cols: str) -> Column:
    """First count that isn't 0, else 0."""
    return F.coalesce(*[F.nullif(count_of(F.col(c)), F.lit(0)) for c in cols], F.lit(0))


def strict(rows: DataFrame) -> DataFrame:
    """Rows with settled counts, ``row_status`` by precedence, and competitive, scored and score to match."""
    rows = complete(rows)
    fallback = F.when(count_of(F.col("fallback_prediction_count")) != 0, count_of(F.col("fallback_prediction_count"))).otherwise(F.greatest(F.lit(0), count_of(F.col("retry_queue_size")) - F.when(count_of(F.col("retry_queue_size")) != 0, count_of(F.col("retry_recovered_count"))).otherwise(0)))
    rows = rows.withColumns({
        "fallback_prediction_count": fallback,
        "unresolved_provider_error_count": _or_else("unresolved_provider_error_count", "post_retry_api_error_count", "api_error_count"),
        "unresolved_invalid_json_count": _or_else("unresolved_invalid_json_count", "post_retry_invalid_json_count", "invalid_json_count"),
        "coverage_fraction": coverage_fraction(),
    })
    blocked = (F.col("unresolved_provider_error_count") > 0) | (F.col("fallback_prediction_count") > 0)
    accounted = (count_of(F.col("failed_prediction_count")) >= F.col("unresolved_invalid_json_count")) & F.col("valid_prediction_rate").isNotNull() & (F.col("coverage_fraction") >= 1)
    status = (
        F.when(is_sanity(), "noncompetitive_oracle")
        .when(F.coalesce("is_baseline", F.lit(False)), "noncompetitive_baseline")
        .when(blocked, "excluded_provider_error")
        .when(F.col("unresolved_invalid_json_count") > 0, F.when(accounted, "completed_with_failures").otherwise("excluded_invalid_json"))
        .when(F.col("coverage_fraction") < 1, "excluded_incomplete")
        .otherwise("clean_completed")
    )
    rows = rows.withColumn("row_status", status).withColumn("competitive", F.col("row_status").isin(*RANKABLE)).withColumn("scored", F.col("competitive"))
    adjusted = F.coalesce("coverage_adjusted_score", F.col("mean_score") * F.col("coverage_fraction") * clamp(F.coalesce("valid_prediction_rate", F.lit(1.0))))
    return rows.withColumn("coverage_adjusted_score", F.when(F.col("scored"), adjusted))


def status_tags() -> Column:
    """Comma-separated tags of a strict row."""
    errors = count_of(F.col("api_error_count")) + count_of(F.col("invalid_json_count")) + count_of(F.col("unresolved_provider_error_count")) + count_of(F.col("unresolved_invalid_json_count")) > 0
    tags = F.array_compact(F.array(
        F.when(F.col("row_status").startswith("excluded") | (F.col("row_status") == "completed_with_failures"), F.col("row_status")),
        F.when(errors, "errors"),
        F.when(F.col("coverage_fraction") < 1, "incomplete"),
        F.when(F.coalesce("is_baseline", F.lit(False)), "baseline"),
        F.when(is_sanity(), "non-competitive"),
    ))
    return F.when(F.size(tags) == 0, "clean").otherwise(F.array_join(tags, ", "))


def public_rows(rows: DataFrame) -> DataFrame:
    """Rows to publish: ranked ones first in order of adjusted, then mean score; ranks are 1..n over rankable rows."""
    done = strict(rows).withColumn("status", status_tags()).withColumn("leaderboard_status", F.col("row_status"))
    rankable = done.where("competitive and scored")
    order = Window.orderBy(F.col("coverage_adjusted_score").desc_nulls_last(), F.col("mean_score").desc_nulls_last(), "model_id", "mode")  # as many rows as models
    ranks = rankable.select("model_id", "mode", F.row_number().over(order).alias("rank"))
    display = {
        "human_effect": F.col("human_effect_category_macro_f1"),
        "binding_rank": F.coalesce("binding_rank_kendall", "binding_rank_spearman"),
        "pose": F.col("pose_contact_f1"),
        "structure": F.coalesce(F.col("structure_score").cast("string"), F.lit("not computed")),
    }
    return done.join(ranks, ["model_id", "mode"], "left").withColumns(display).orderBy(F.col("rank").asc_nulls_last(), F.col("coverage_adjusted_score").desc_nulls_last(), "model_id")


def failure_reason() -> Column:
    return F.when(F.col("row_status") == "excluded_provider_error", F.when(F.col("fallback_prediction_count") > 0, "fallback predictions present").otherwise("unresolved provider errors")).when(F.col("row_status") == "excluded_invalid_json", "unresolved invalid JSON").when(F.col("row_status") == "excluded_incomplete", "incomplete coverage").otherwise(F.col("row_status"))


def excluded(rows: DataFrame) -> DataFrame:
    """(model_id, mode, row_status, reason, counts) of the rows that are not ranked for a failure."""
    return strict(rows).where(F.col("row_status").startswith("excluded")).select("model_id", "mode", "row_status", failure_reason().alias("reason"), "fallback_prediction_count", "unresolved_provider_error_count", "unresolved_invalid_json_count", "coverage_fraction")


def diagnosis(rows: DataFrame, retries: DataFrame) -> DataFrame:
    """(kind, key, n): rows by status, causes of the failed ones, latest retry results by status, and what still failed by model, mode, track and error."""
    done, last = strict(rows), latest(retries)
    still = last.where("retry_status = 'still_failed'")
    count = lambda df, kind, key: df.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    failed = done.where(~F.coalesce("is_baseline", F.lit(False)) & ~F.col("row_status").isin(*RANKABLE))
    return union_all(count(done, "row_status", F.col("row_status")), count(failed, "root_cause", failure_reason()), count(last, "retry_status", F.col("retry_status")), *[count(still, c, F.col(c)) for c in ("model_id", "mode", "track", "error_type")])


def run_status() -> Column:
    """Status of a run's row: a known row status counts; else what coverage and errors say."""
    errors = (count_of(F.col("api_error_count")) > 0) | (count_of(F.col("invalid_json_count")) > 0)
    return F.when(F.col("row_status").isin(*STATUSES), F.col("row_status")).when(coverage_fraction() < 1, "excluded_incomplete").when(errors, "excluded_provider_error").otherwise("clean_completed")


def manifest_status(tracks: DataFrame, by: list[str]) -> DataFrame:
    """(by, status, reason) of a run's tracks (attempted, completed, unresolved_api_errors, unresolved_invalid_json, retry_recovered_count), with the sums of the errors."""
    total = lambda c: F.sum(count_of(F.col(c)))
    sums = tracks.groupBy(*by).agg(total("unresolved_api_errors").alias("api_errors"), total("unresolved_invalid_json").alias("invalid_json"), total("retry_recovered_count").alias("recovered"), F.count_if(count_of(F.col("attempted")) != count_of(F.col("completed"))).alias("incomplete"))
    open_, bad = (F.col("api_errors") > 0) | (F.col("incomplete") > 0), F.col("invalid_json") > 0
    return sums.select(*by, F.when(open_, "incomplete").when(bad, "completed_with_failures").otherwise("completed_clean").alias("status"), F.when(open_, "remote_sampler_outputs_incomplete").when(bad, "explicit_failed_prediction_rows").otherwise("completed_clean").alias("reason"), "api_errors", "invalid_json", "recovered")


def error_counts(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(model_id, mode, api_error_count, invalid_json_count) of each pair's last row."""
    counts = [count_of(F.col(c)).alias(c) for c in ("api_error_count", "invalid_json_count")]
    return last_by(with_order(rows, order).select("model_id", "mode", *counts, order), ["model_id", "mode"], order).drop(order)


def models_for(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """Each wanted model_id with its record, or one by default: the provider of its id, no structured outputs."""
    found = wanted.select("model_id").distinct().join(models, "model_id", "left")
    return found.withColumn("provider", F.coalesce("provider", provider(F.col("model_id")))).withColumn("structured_outputs_supported", F.coalesce("structured_outputs_supported", F.lit(False)))


def check(rows: DataFrame) -> DataFrame:
    """Violations (model_id, mode, error) of a finished leaderboard, and one if nothing can be ranked."""
    done = strict(rows)
    stated = F.col("row_status").isin(*STATUSES)
    rules = F.array_compact(F.array(
        F.when(~stated, F.lit("unknown row status")),
        F.when(F.col("competitive") & F.col("coverage_adjusted_score").isNull(), F.lit("rankable row without score")),
        F.when(F.col("competitive") & (F.col("coverage_fraction") < 1), F.lit("rankable row is incomplete")),
        F.when(is_sanity() & F.col("competitive"), F.lit("sanity row is competitive")),
    ))
    each = done.select("model_id", "mode", F.explode(rules).alias("error"))
    none = done.agg(F.count_if("competitive").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("model_id"), F.lit(None).cast("string").alias("mode"), F.lit("no rankable competitive rows").alias("error"))
    return each.unionByName(none)


PRIMARY = {"structure": "backbone_rmsd", "pose": "interface_contact_recall", "binding_rank": "spearman", "human_effect": "category_macro_f1"}


def primary_metric(long: DataFrame) -> DataFrame:
    """(result_id, metric, value, status) of each result's preferred metric, else its first by name; ``long`` holds (result_id, track, metric, value, status)."""
    wanted = F.lit(None).cast("string")
    for track, metric in PRIMARY.items():
        wanted = F.when(F.col("track") == track, metric).otherwise(wanted)
    return long.groupBy("result_id").agg(F.min_by(F.struct("metric", "value", "status"), F.struct((F.col("metric") != F.coalesce(wanted, F.lit(""))).alias("other"), "metric")).alias("m")).select("result_id", "m.*")


def client_rows(rows: DataFrame, view: str = "competitive", sort: str = "rank", descending: bool = False) -> DataFrame:
    """The page's filter (competitive, all, base, tools, baselines) and sort by any column, nulls last upwards."""
    public = public_rows(rows)
    keep = {"all": F.lit(True), "competitive": F.col("competitive"), "base": F.col("mode") == "base", "tools": F.col("mode") == "tools_high_reasoning", "baselines": F.coalesce("is_baseline", F.lit(False))}[view]
    return public.where(keep).orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last())
