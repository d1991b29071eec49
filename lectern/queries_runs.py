"""Queries of runs, leaderboards, baselines and scalar functions, an operator or a few each, with the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import hashes, numbers
from lectern.functions import text as texts
from lectern.functions.json import object_in
from lectern.operators import builders, evidence, keys, leaderboard, projections, qc, ranking, retries
from lectern.operators.ordering import positions
from lectern.plans import model_runs, rounds, workflows
from lectern.queries import _ROWS, _items, _rows, pick, query, sql_pick, table
from lectern.runtime import scratch
from lectern.schemas import DOMAINS, TRACKS, case_schema
from lectern.sinks import files as sinks
from lectern.sources import files
from lectern.streaming import runs

big = lambda c: c.cast("bigint")
text = lambda c: F.col(c).cast("string")

# Leaderboard


@query(f"with {_ROWS} select model_id, mode, row_status, round(adjusted, 6) as adjusted, completed::bigint as completed, 'Supplier' = split_part(model_id, '#', 1) as known from v")
def leaderboard_files(spark, sf):
    """SRC34, SNK6, SNK7, CHK21, CHK34: the public rows written as JSON and CSV and read back."""
    where = scratch(spark, "board")
    sinks.write_leaderboard(leaderboard.public_rows(_rows(spark, sf)), where)
    read = files.read_jsonl(spark, f"{where}/leaderboard.json", "model_id string, mode string, row_status string, coverage_adjusted_score double, total_cases_completed bigint", strict=False)
    flat = files.read_csv(spark, f"{where}/leaderboard.csv")
    assert tuple(flat.columns) == sinks.LEADERBOARD_CSV
    both = read.join(flat.select("model_id", F.col("row_status").alias("again")), "model_id").where("row_status = again")
    return both.select("model_id", "mode", "row_status", F.round("coverage_adjusted_score", 6).alias("adjusted"), F.col("total_cases_completed").alias("completed"), (F.substring_index("model_id", "#", 1) == "Supplier").alias("known"))


@query(f"""with {_ROWS}, e as (select *, coalesce(api, 0) > 0 or bad_json > 0 as err from v) select model_id, mode, case when list_count(t2) = 0 then 'clean' else array_to_string(t2, ', ') end as tags,
case row_status when 'excluded_provider_error' then 'unresolved provider errors' when 'excluded_invalid_json' then 'unresolved invalid JSON' when 'excluded_incomplete' then 'incomplete coverage' else row_status end as reason, row_status as run_status
from (select *, list_filter([case when row_status like 'excluded%' or row_status = 'completed_with_failures' then row_status end, case when err then 'errors' end, case when cov < 1 then 'incomplete' end, case when baseline then 'baseline' end, case when mode = 'sanity_check' then 'non-competitive' end], lambda x: x is not null) as t2 from e)""")
def row_states(spark, sf):
    """STR19, CHK24, CHK25, AGG28: tags, failure reason and run status of a row."""
    done = leaderboard.strict(_rows(spark, sf))
    return done.select("model_id", "mode", leaderboard.status_tags().alias("tags"), leaderboard.failure_reason().alias("reason"), leaderboard.run_status().alias("run_status"))


@query(f"""with {_ROWS} select model_id, mode, 'rankable row is incomplete' as error from v where false union all select null, null, 'no rankable competitive rows' where (select count(*) from v where ok and k % 5 = 99) = 0""")
def leaderboard_errors(spark, sf):
    """CHK20: what is wrong with a leaderboard that ranks nothing."""
    return leaderboard.check(_rows(spark, sf).withColumn("is_baseline", F.lit(True)))


@query("""with l as (select user_id % 20 as m, user_id % 997 as b, max_by(event_type, event_id) as e from events group by 1, 2), s as (select * from l where e in ('error', 'view'))
select 'retry_status' as kind, case when e in ('error', 'view') then 'still_failed' else 'recovered' end as key, count(*) as n from l group by 2 union all select 'model_id', m::varchar, count(*) from s group by 2 union all select 'mode', 'base', count(*) from s union all select 'track', 'human_effect', count(*) from s
union all select 'error_type', case e when 'error' then 'invalid_json' else 'api_error' end, count(*) from s group by 2 union all select 'row_status', 'excluded_incomplete', 1 union all select 'root_cause', 'incomplete coverage', 1""")
def failure_diagnosis(spark, sf):
    """AGG32, AGG14: failures counted by status, cause, model, mode, track and error."""
    from lectern.queries import _log

    one = spark.createDataFrame([("m", "base", 5, 4)], "model_id string, mode string, total_cases_attempted int, total_cases_completed int")
    return leaderboard.diagnosis(one, _log(spark, sf))


_RESULTS = """x as (select l_suppkey as k, avg(l_discount) * 10 as a, avg(l_tax) * 12 as b, avg(l_quantity) / 50 as c, count(*) as n from lineitem group by 1),
s as (select k, 'human_effect' as track, n, greatest(0, (a + b + c + a + b) / 5 - 1.0 / greatest(n, 1)) as score, n - 1 as completed from x union all select k, 'binding_rank', n, ((a + 1) / 2 + (b + 1) / 2 + c) / 3, n from x union all select k, 'pose', n, coalesce(2 * a * c / nullif(a + c, 0), 0), n from x union all select k, 'structure', n, case when k % 2 = 0 then 1 / (1 + a) end, n from x)"""


def _results(spark, sf) -> DataFrame:
    x = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((F.avg("l_discount") * 10).alias("a"), (F.avg("l_tax") * 12).alias("b"), (F.avg("l_quantity") / 50).alias("c"), F.count(F.lit(1)).alias("n_cases"))
    metrics = {"category_macro_f1": "a", "evidence_level_ordinal_accuracy": "b", "evidence_direction_accuracy": "c", "claim_status_accuracy": "a", "unsupported_claim_detection_rate": "b", "spearman": "a", "kendall_tau": "b", "pairwise_ranking_accuracy": "c", "interface_contact_precision": "a", "interface_contact_recall": "c"}
    rows = x.select("k", "n_cases", F.explode(F.array(*[F.lit(t) for t in TRACKS])).alias("track"), *[F.col(c).alias(m) for m, c in metrics.items()], F.lit(1.0).alias("overclaim_penalty"), F.when(F.col("k") % 2 == 0, F.col("a")).alias("all_atom_rmsd"))
    return rows.withColumns({"model_id": F.concat(F.lit("p/"), text("k")), "mode": F.lit("base"), "attempted": F.col("n_cases"), "completed": F.col("n_cases") - F.when(F.col("track") == "human_effect", 1).otherwise(0)})


@query(f"with {_RESULTS} select 'p/' || k as model_id, 'p' as provider, round(avg(score), 6) as mean_score, sum(n)::bigint as attempted, sum(completed)::bigint as completed, max(case when track = 'structure' then round(score, 6) end) as structure_score from s group by k")
def rows_from_results(spark, sf):
    """AGG23, AGG22, AGG58, EXT6, EXT19, PRJ21: one leaderboard row a model and mode from the results of its tracks; tracks without a score don't count."""
    rows = leaderboard.rows_from_results(_results(spark, sf))
    return rows.select("model_id", "provider", F.round("mean_score", 6).alias("mean_score"), F.col("total_cases_attempted").alias("attempted"), F.col("total_cases_completed").alias("completed"), F.round("structure_score", 6).alias("structure_score"))


@query(f"with {_RESULTS}, t as (select k, max(case when track = 'pose' then round(score, 6) end) as pose, max(case when track = 'structure' and score is not null then 'computed' end) as st, max(n) as n from s group by 1), b as (select k, round(b, 6) as kendall from x) select 'p/' || k as model_id, kendall as binding_rank, pose, coalesce(st, 'not computed') as structure from t join b using (k)")
def display_values(spark, sf):
    """PRJ55, PRJ56, PRJ57: values as the page shows them."""
    public = workflows.leaderboard_from_results(_results(spark, sf))
    shown = F.when(F.col("structure") == "not computed", F.col("structure")).otherwise("computed")
    return public.select("model_id", F.round("binding_rank", 6).alias("binding_rank"), F.round("pose", 6).alias("pose"), shown.alias("structure"))


@query(f"""with {_ROWS} select 'competitive' as view, count(*) filter (ok) as n, min(model_id) filter (ok) as first_id from v union all select 'all', count(*), min(model_id) from v union all select 'base', count(*) filter (mode = 'base'), min(model_id) filter (mode = 'base') from v union all select 'tools', 0, null union all select 'baselines', count(*) filter (baseline), min(model_id) filter (baseline) from v""")
def client_views(spark, sf):
    """SRT10, SRT11, SRT12: the page's filters, sorted by a column."""
    views = [leaderboard.client_rows(_rows(spark, sf), v, "model_id").agg(F.count(F.lit(1)).alias("n"), F.min("model_id").alias("first_id")).select(F.lit(v).alias("view"), "n", "first_id") for v in ("competitive", "all", "base", "tools", "baselines")]
    return keys.union_all(*views)


@query("select c_custkey, c_custkey % 3 = 0 as oracle, c_custkey % 4 = 0 or c_custkey % 3 = 0 as sanity from customer")
def oracle_names(spark, sf):
    """PRJ34, PRJ35: names of label copies, and rows that don't compete."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.when(k % 3 == 0, "My_Oracle").when(k % 5 == 0, "non_oracle").when(k % 5 == 1, "non-oracle").otherwise("m").alias("model_id"), F.when(k % 4 == 0, "sanity_check").otherwise("base").alias("mode"))
    plain = F.regexp_replace("model_id", "non-oracle", "non_oracle")
    return rows.select("c_custkey", leaderboard.is_oracle_name(plain).alias("oracle"), leaderboard.is_sanity().alias("sanity"))


@query("""select o_custkey % 50 as run, case when max(o_orderkey % 97) = 96 or max(case when o_orderstatus = 'P' then 1 else 0 end) = 1 then 'incomplete' when max(o_orderkey % 3) = 2 then 'completed_with_failures' else 'completed_clean' end as status, sum((o_orderkey % 97 = 96)::int)::bigint as api_errors, sum((o_orderkey % 3 = 2)::int)::bigint as invalid_json from orders where o_orderstatus <> 'P' or o_custkey % 5 = 0 group by 1""")
def manifest_states(spark, sf):
    """AGG44, AGG45: errors summed over a run's tracks, and its status."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").where("o_orderstatus <> 'P' or o_custkey % 5 = 0").select((F.col("o_custkey") % 50).alias("run"), F.lit(2).alias("attempted"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("completed"), (k % 97 == 96).cast("int").alias("unresolved_api_errors"), (k % 3 == 2).cast("int").alias("unresolved_invalid_json"), F.lit(None).cast("int").alias("retry_recovered_count"))
    return leaderboard.manifest_status(rows, ["run"]).select("run", "status", "api_errors", "invalid_json")


@query("select user_id % 30 || '' as model_id, event_type as mode, max_by(event_id % 7, event_id) as api_error_count, max_by(event_id % 11, event_id) as invalid_json_count from events group by 1, 2")
def error_counts(spark, sf):
    """AGG29, SRC35: counts of each model and mode, the last row wins."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 30).cast("string").alias("model_id"), F.col("event_type").alias("mode"), (F.col("event_id") % 7).alias("api_error_count"), (F.col("event_id") % 11).alias("invalid_json_count"), F.col("event_id").alias("ord"))
    return leaderboard.error_counts(rows)


@query("select 'p' || c_nationkey || '/m' as model_id, case when c_nationkey % 2 = 0 then 'own' else 'p' || c_nationkey end as provider, c_nationkey % 2 = 0 as structured from customer group by all")
def model_records(spark, sf):
    """JN24, STR7, PRJ22: models with their records, or one by default."""
    ident = lambda c: F.concat(F.lit("p"), text(c), F.lit("/m"))
    known = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(ident("n_nationkey").alias("model_id"), F.lit("own").alias("provider"), F.lit(True).alias("structured_outputs_supported"))
    return leaderboard.models_for(table(spark, sf, "customer").select(ident("c_nationkey").alias("model_id")), known).select("model_id", "provider", F.col("structured_outputs_supported").alias("structured"))


@query("""select 'r' || c_custkey as result_id, case when c_custkey % 4 = 3 and c_custkey % 5 > 0 then 'category_macro_f1' when c_custkey % 4 = 2 and c_custkey % 5 > 0 then 'spearman' else 'a_metric' end as metric, case when c_custkey % 4 >= 2 and c_custkey % 5 > 0 then c_acctbal else 1.0 end::double as value from customer""")
def primary_metrics(spark, sf):
    """AGG56, AGG15: the preferred metric of each result, else its first."""
    k = F.col("c_custkey")
    track = pick(TRACKS, k)
    wanted = F.when(track == "human_effect", "category_macro_f1").when(track == "binding_rank", "spearman")
    two = F.array(F.struct(F.when(k % 5 > 0, F.coalesce(wanted, F.lit("z"))).otherwise("z").alias("metric"), F.col("c_acctbal").alias("value")), F.struct(F.lit("a_metric").alias("metric"), F.lit(1.0).alias("value")))
    long = table(spark, sf, "customer").select(F.concat(F.lit("r"), k).alias("result_id"), track.alias("track"), F.explode(two).alias("m")).select("result_id", "track", "m.*", F.lit("computed").alias("status"))
    once = keys.first_by(long.union(long).withColumn("ord", F.lit(0)), ["result_id", "track", "metric"]).drop("ord")
    return leaderboard.primary_metric(once).select("result_id", "metric", "value")


@query("select track, metric, status, count(*) as n from (select 'structure' as track, unnest(['backbone_rmsd', 'all_atom_rmsd']) as metric, 'not_computed' as status union all select 'structure', unnest(['rmsd_evaluated_cases', 'rmsd_skipped_count']), 'computed') group by all")
def metric_rows(spark, sf):
    """EXT14, JN4, AGG20, GEN2: metrics of a track as rows; reference coordinates that aren't there leave nothing to compute."""
    base = [F.concat(F.lit("c"), text("c_custkey")).alias("benchmark_id"), F.lit("structure").alias("track")]
    cases = table(spark, sf, "customer").select(*base, F.array().cast("array<struct<atom_id:string,residue_id:string,x:double,y:double,z:double>>").alias("gold_coordinates"))
    result = workflows.evaluate("structure", cases, builders.baseline(cases, "structure"))
    return workflows.long_metrics(result).groupBy("track", "metric", "status").agg(F.count(F.lit(1)).alias("n"))


# Retries


@query("""with l as (select user_id % 20 as m, user_id % 997 as b, max_by(event_type, event_id) as e from events group by 1, 2) select m::varchar as model_id, b::varchar as benchmark_id, case when e in ('error', 'view') and b % 2 = 1 then 'still_failed' else 'recovered' end as retry_status from l""")
def reconciled_retries(spark, sf):
    """JN22, JN23, AGG57: latest results, recovered where a valid prediction is there by now."""
    from lectern.queries import _log

    log = _log(spark, sf)
    return retries.reconcile(log, log.where("cast(benchmark_id as int) % 2 = 0")).select("model_id", "benchmark_id", "retry_status")


@query("""with c as (select 'm' || c_nationkey as model_id, (['structure', 'pose', 'binding_rank', 'human_effect'])[c_custkey % 4 + 1] as track, count(*) as items from customer group by 1, 2) select model_id, track, items, ceil(items / case track when 'human_effect' then 50 when 'binding_rank' then 25 else 1 end)::bigint as requests from c""")
def retry_plans(spark, sf):
    """AGG54, SRT5, EXT10: requests of a queue by model, mode and track."""
    items = table(spark, sf, "customer").select(F.concat(F.lit("m"), text("c_nationkey")).alias("model_id"), F.lit("base").alias("mode"), pick(TRACKS, F.col("c_custkey")).alias("track"))
    return retries.plan(items).select("model_id", "track", "items", big(F.col("requests")).alias("requests"))


def _requests(spark, sf) -> DataFrame:
    chunk = F.floor(F.col("c_custkey") / 10).alias("chunk")
    packed = table(spark, sf, "customer").groupBy(chunk).agg(F.collect_list(text("c_custkey")).alias("benchmark_ids"))
    prompts = packed.select(F.lit("base").alias("mode"), F.lit("human_effect").alias("track"), big(F.col("chunk")).alias("chunk"), "benchmark_ids", F.col("chunk").cast("string").alias("messages"), F.concat(F.lit("short "), F.col("chunk")).alias("compact"))
    models = table(spark, sf, "region").select(F.concat(F.lit("m"), text("r_regionkey")).alias("model_id"), F.lit("base").alias("mode"), F.lit("human_effect").alias("track"))
    return model_runs.requests_for(models, prompts)


def _answer(model: str, messages: str, options: dict) -> str:
    """A stand-in for a provider: m0 has no credits, m1 breaks its JSON from chunk 7 on unless asked shortly, all others answer."""
    if model == "m0":
        from lectern.sources.adapters import OutOfCredits

        raise OutOfCredits("pay")
    if model == "m1" and not messages.startswith("short") and int(messages) >= 7:
        return "no object"
    return '{"predictions": []}'


@query("""with c as (select distinct c_custkey // 10 as chunk from customer), m as (select 'm' || r_regionkey as model_id from region)
select model_id, case when model_id = 'm0' then case when chunk = 0 then 'failed' else 'fallback' end when model_id = 'm1' and chunk >= 7 then case when chunk = 7 then 'failed' else 'fallback' end else 'completed' end as status, case when model_id = 'm0' and chunk = 0 then 'credits_exhausted' when model_id = 'm1' and chunk = 7 then 'invalid_json' end as error_type,
sum(case when model_id = 'm0' then (chunk = 0)::int when model_id = 'm1' and chunk >= 7 then case when chunk = 7 then 3 else 0 end else 1 end)::bigint as attempts, count(*) as n from c, m group by 1, 2, 3""")
def run_results(spark, sf):
    """EXT1, EXT2, EXT3, EXT4, EXT15, EXT16, EXT17: chunked calls with pauses; after a chunk that failed for good the rest gets the fallback."""
    out = model_runs.run_tracks(_requests(spark, sf), _answer, json.loads, model_runs.run_ladder(2), wait=lambda seconds: None)
    return out.groupBy("model_id", "status", "error_type").agg(big(F.sum("attempts")).alias("attempts"), F.count(F.lit(1)).alias("n"))


@query("""with c as (select distinct c_custkey // 10 as chunk from customer), m as (select 'm' || r_regionkey as model_id from region)
select model_id, case when model_id = 'm0' then 'failed' else 'completed' end as status, count(*) as n, max(case when model_id = 'm1' then 3 else 1 end)::bigint as attempts from c, m where model_id in ('m0', 'm1') and (model_id = 'm0' or chunk >= 7) group by 1, 2""")
def retry_results(spark, sf):
    """EXT5, EXT7, EXT8, EXT9, EXT24: what a run left open, asked by a ladder of simpler requests; finished chunks are skipped."""
    requests = _requests(spark, sf).where("model_id in ('m0', 'm1')")
    done = requests.where("model_id = 'm1' and chunk < 7").select("model_id", "mode", "track", "chunk")
    out = model_runs.run_tracks(requests, _answer, json.loads, model_runs.retry_ladder(0), done, fail_over=False, wait=lambda seconds: None)
    return out.groupBy("model_id", "status").agg(F.count(F.lit(1)).alias("n"), big(F.max("attempts")).alias("attempts"))


@query("select c_custkey::varchar as prompt_id, case when c_custkey % 3 = 0 then 2 else 1 end::bigint as attempts, case when c_custkey % 6 = 0 then 'empty' end as degenerate, case when c_custkey % 2 = 0 then '256' else '1024' end as tokens from customer")
def sampled_answers(spark, sf):
    """EXT20, EXT25, EXT28, NUM11: answers of a sampler, asked once more where they are degenerate, within the tokens of their task."""
    prompts = table(spark, sf, "customer").select(text("c_custkey").alias("prompt_id"), text("c_custkey").alias("model_id"), F.when(F.col("c_custkey") % 2 == 0, "short_report").otherwise("x").alias("task_type"), F.lit("m").alias("messages"))

    def caller(model: str, messages: str, options: dict, asked: dict = {}) -> str:  # noqa: B006 - counts the calls of this worker
        asked[model] = asked.get(model, 0) + 1
        bad = int(model) % 6 == 0 or (int(model) % 3 == 0 and asked[model] % 2 == 1)
        return ("" if bad else "{}") + f" {options['max_tokens']}"

    out = model_runs.sampled(prompts, caller, lambda t: None if "{" in t else "empty", {"short": 256})
    return out.select("prompt_id", big(F.col("attempts")).alias("attempts"), "degenerate", F.substring_index("text", " ", -1).alias("tokens"))


@query("select 'm' || r_regionkey as model_id, 'blocked' as status, 'no key' as reason, 0::bigint as completed, false as competitive from region")
def blocked_runs(spark, sf):
    """EXT31: rows of runs that couldn't start."""
    models = table(spark, sf, "region").select(F.concat(F.lit("m"), text("r_regionkey")).alias("model_id"), F.lit("base").alias("mode"), F.lit("pose").alias("track"))
    return model_runs.blocked(models, "no key").select("model_id", "status", "reason", big(F.col("completed")).alias("completed"), "competitive")


@query("select event_type as task_type, count(*) as n, count(*) filter (value > 20) as valid, (count(*) filter (value > 20))::double / count(*) as valid_rate from events group by 1")
def sanity_rates(spark, sf):
    """AGG41: valid answers by task."""
    from lectern.operators.predictions import stats_by_task

    return stats_by_task(table(spark, sf, "events").select(F.col("event_type").alias("task_type"), (F.col("value") > 20).alias("schema_valid")))


@query("""with e as (select coalesce(nullif(case when event_id % 11 = 0 then '' else event_type end, ''), 'unknown') as task, value > 1 as j, value > 5 as p, value > 20 as s from events), t as (select task, count(*) as n, count(*) filter (s) as v from e group by 1)
select 'completed_with_warnings' as status, count(*) as attempted, count(*) as sampled_examples, count(*) filter (j) as json_valid_count, count(*) filter (p) as parse_valid_count, count(*) filter (s) as schema_valid_count, round(count(*) filter (j) / count(*), 9) as json_validity, (select string_agg(task || ':' || n || ':' || v, ',' order by task) from t) as tasks, (select count(*) from orders) as holdout_examples_available from e""")
def sanity_summary(spark, sf):
    """AGG42: the figures of all answers, and by task."""
    from lectern.operators.predictions import sanity_summary as summary

    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("task_type"), (F.col("value") > 1).alias("json_valid"), (F.col("value") > 5).alias("parse_valid"), (F.col("value") > 20).alias("schema_valid"))
    out = summary(rows, table(spark, sf, "orders").count(), "m", "events")
    tasks = F.array_join(F.transform("validity_by_task_type", lambda t: F.concat_ws(":", t["task_type"], t["n"].cast("string"), t["valid"].cast("string"))), ",")
    return out.select("status", "attempted", "sampled_examples", "json_valid_count", "parse_valid_count", "schema_valid_count", F.round("json_validity", 9).alias("json_validity"), tasks.alias("tasks"), "holdout_examples_available")


# Baselines


_SOURCES = ("dailymed", "clinicaltrials", "reactome", "other")


def _effects(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    claims = DOMAINS["claim_status"]
    return table(spark, sf, "customer").select(k.cast("string").alias("benchmark_id"), F.lit("human_effect").alias("track"), pick(_SOURCES, k).alias("source_database"), text("c_nationkey").alias("source_id"), F.lit("neuro_cns").alias("category"), F.lit("human_clinical_evidence").alias("evidence_level"), F.lit("mixed").alias("evidence_direction"), pick(claims, k).alias("claim_status"), F.lit("known_risk").alias("safety_status"))


@query(f"""select c_custkey::varchar as benchmark_id, 'rule' as model, case c_custkey % 4 when 0 then 'approved_human_indication' when 1 then 'human_clinical_evidence' when 2 then 'mechanistic_pathway_or_similarity_hypothesis' else 'unsupported_contradicted_or_unsafe_claim' end as evidence_level, c_custkey % 4 > 0 as abstained, case c_custkey % 4 when 0 then 'supported' when 3 then 'insufficient_information' else 'plausible_but_unproven' end as claim_status from customer
union all select c_custkey::varchar, 'copy', 'human_clinical_evidence', {sql_pick(DOMAINS["claim_status"], "c_custkey")} in ('unsupported', 'unsafe_to_claim', 'insufficient_information'), case when {sql_pick(DOMAINS["claim_status"], "c_custkey")} in ('unsupported', 'unsafe_to_claim', 'insufficient_information') then 'insufficient_information' else {sql_pick(DOMAINS["claim_status"], "c_custkey")} end from customer""")
def effect_baselines(spark, sf):
    """GEN1, GEN5, GEN6, AGG3: the rule baseline by source, and the copy of the labels that abstains where nothing is supported."""
    cases = _effects(spark, sf)
    parts = [builders.baseline(cases, "human_effect", name).select("benchmark_id", F.lit(label).alias("model"), "evidence_level", "abstained", "claim_status") for name, label in (("rules", "rule"), ("oracle_copy", "copy"))]
    return parts[0].union(parts[1])


@query(f"with m as (select {sql_pick(DOMAINS['claim_status'], 'c_custkey')} as s, c_custkey % 4 as r from customer) select count(*) filter (s in ('unsupported', 'unsafe_to_claim', 'insufficient_information') and r = 3) / count(*) filter (s in ('unsupported', 'unsafe_to_claim', 'insufficient_information')) as detection, avg((r = 1)::int) as level_accuracy, count(*) as matched from m")
def baseline_metrics(spark, sf):
    """GEN8, GEN9, AGG3, AGG21: metrics of the rule baseline."""
    cases = _effects(spark, sf).withColumn("trial_has_results", F.lit(None).cast("boolean"))
    m = evidence.evaluate_human_effect(cases, builders.baseline(cases, "human_effect"))
    return m.select(F.col("unsupported_claim_detection_rate").alias("detection"), F.col("evidence_level_ordinal_accuracy").alias("level_accuracy"), F.col("n_matched").alias("matched"))


@query("select c_custkey::varchar as benchmark_id, (c_custkey % 3)::bigint as contacts, least(c_custkey % 3, 1)::bigint as baseline, 0::bigint as fallback, 0.01::double as confidence from customer")
def pose_baselines(spark, sf):
    """GEN3, GEN7: the first contact as a baseline, nothing as a fallback."""
    k = F.col("c_custkey")
    contact = F.struct(F.lit("A:1").alias("target_residue"), F.lit("B:1").alias("peptide_residue"))
    cases = table(spark, sf, "customer").select(k.cast("string").alias("benchmark_id"), F.lit("pose").alias("track"), F.array_repeat(contact, (k % 3).cast("int")).alias("native_contacts"), F.array(F.lit("A:1")).alias("binding_site_residues"), F.lit("o").alias("orientation_label"), F.array().cast("array<string>").alias("gold_coordinates"))
    first = builders.baseline(cases, "pose").select("benchmark_id", F.size("predicted_contacts").alias("b"))
    none = builders.fallback(cases, "pose", "m").select("benchmark_id", F.size("predicted_contacts").alias("f"))
    low = builders.fallback(cases.withColumn("track", F.lit("structure")), "structure", "m").select("benchmark_id", "confidence")
    return cases.join(first, "benchmark_id").join(none, "benchmark_id").join(low, "benchmark_id").select("benchmark_id", big(F.size("native_contacts")).alias("contacts"), big(F.col("b")).alias("baseline"), big(F.col("f")).alias("fallback"), F.col("confidence").cast("double").alias("confidence"))


def seeded_stream_sql(seed: int, numbers: str) -> str:
    """Common tables of DuckDB SQL that end with ``stream`` (nth, score): the first numbers of the seeded stream, from its definition word by word; ``numbers`` is a query of how many."""
    import random

    state = ", ".join(map(str, random.Random(seed).getstate()[1][:-1]))
    twist = lambda high, low: f"xor(((({high}) & 2147483648) | (({low}) & 2147483647)) >> 1, (({low}) & 1) * 2567483615)"
    part = lambda first, last, known: f"list_transform(range({first}, {last}), lambda k: xor({twist('x[k + 1]', 'x[k + 2]')}, {known}))"
    return f"""recursive states as (select 0 as step, [{state}]::bigint[] as x union all
select step + 1, list_concat(a, b, c, [xor({twist("x[624]", "a[1]")}, b[170])]) from (select *, {part(454, 623, "b[k - 453]")} as c from (select *, {part(227, 454, "a[k - 226]")} as b from (select *, {part(0, 227, "x[k + 398]")} as a from states))) where step <= ({numbers}) // 312),
raw as (select (step - 1) * 624 + i - 1 as nth, x[i] as y from states, range(1, 625) r(i) where step > 0),
t1 as (select nth, xor(y, y >> 11) as y from raw), t2 as (select nth, xor(y, (y << 7) & 2636928640) as y from t1), t3 as (select nth, xor(y, (y << 15) & 4022730752) as y from t2), t4 as (select nth, xor(y, y >> 18) as y from t3),
stream as (select nth // 2 as nth, (max(y >> 5) filter (nth % 2 = 0) * 67108864 + max(y >> 6) filter (nth % 2 = 1)) / 9007199254740992 as score from t4 group by nth // 2)"""


@query(f"""with {seeded_stream_sql(builders.SEED, "select count(*) from lineitem")}, items as (select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber) - 1 as nth from lineitem)
select l_orderkey::varchar as benchmark_id, 'i' || l_linenumber as item_id, score, (nth - min(nth) over (partition by l_orderkey) + 1)::integer as rank from items join stream using (nth)""")
def seeded_scores(spark, sf):
    """GEN4: one seeded stream of scores through all orders as panels, by key, a number a line."""
    items = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.struct(F.concat(F.lit("i"), n.cast("string")).alias("item_id")))
    cases = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(items.alias("items")).select(text("l_orderkey").alias("benchmark_id"), F.lit("binding_rank").alias("track"), "items", F.col("l_orderkey").alias("ord"))
    return builders.baseline(cases, "binding_rank").select("benchmark_id", F.explode("scores").alias("s")).select("benchmark_id", "s.*")


@query("""with e as (select p_partkey as k, 'E' || p_partkey % 40 as pdb, (p_partkey % 3)::varchar as entity, 'C' as chain, 2 + p_partkey % 60 as n from part), f as (select pdb, entity, chain, min(k) as k from e where n between 2 and 50 group by all) select 'CASE-STRUCT-' || lpad(row_number() over (order by k)::varchar, 5, '0') as benchmark_id, pdb as pdb_id, entity as entity_id from f""")
def structure_cases(spark, sf):
    """GEN10, WIN4, ARR3, PRJ37: short peptides of entries, one a chain, with running ids."""
    k = F.col("p_partkey")
    e = table(spark, sf, "part").select(F.concat(F.lit("E"), (k % 40).cast("string")).alias("pdb_id"), (k % 3).cast("string").alias("entity_id"), F.array(F.lit("C")).alias("chains"), F.array(F.lit("Z")).alias("asym_chains"), F.lit("Polypeptide(L)").alias("kind"), F.repeat(F.lit("a"), (2 + k % 60).cast("int")).alias("sequence"), k.alias("ord"))
    return builders.structure_cases(e).select("benchmark_id", "pdb_id", "entity_id")


@query("""with e as (select p_partkey as k, p_partkey % 20 as pdb, 1 + p_partkey % 90 as n from part), p as (select pdb, k, n, row_number() over (partition by pdb order by k) as r from e where n between 5 and 50), t as (select pdb, min(k) as k from e where n >= 60 group by 1) select p.pdb::varchar as pdb_id, p.k::varchar as peptide_entity, t.k::varchar as target_entity, p.n::bigint as peptide_length from p join t using (pdb) where r <= 2""")
def pose_pairs(spark, sf):
    """JN19, GEN11: the first two peptides of an entry with its first target."""
    k = F.col("p_partkey")
    e = table(spark, sf, "part").select((k % 20).cast("string").alias("pdb_id"), k.cast("string").alias("entity_id"), F.repeat(F.lit("A"), (1 + k % 90).cast("int")).alias("sequence"), k.alias("ord"))
    return builders.pose_pairs(e).select("pdb_id", "peptide_entity", "target_entity", big(F.col("peptide_length")).alias("peptide_length"))


_MODELS = """m as (select case p_partkey % 50 when 0 then 'openai/gpt-' when 1 then 'anthropic/claude-' when 2 then 'qwen/qwen-' when 3 then 'acme/embedding-' else 'acme/part-' end || p_partkey as id, p_partkey % 50 as f, p_size as created, p_partkey * 10 as context, p_retailprice as price from part),
b as (select case f when 0 then 'openai' when 1 then 'anthropic' when 2 then 'qwen' end as family, max_by(id, (created, context, id)) as id from m where f < 3 group by 1)"""


@query(f"with {_MODELS} select family, id from b union all select 'small_fast', (select id from m where f <> 3 and id not in (select id from b) order by price, context desc, created desc, id limit 1)")
def selected_models(spark, sf):
    """WIN7, WIN8, SRT2, SRT3, PRJ39, PRJ40, PRJ41, NUM5, ARR4: the best model of each family and the cheapest of the rest."""
    k = F.col("p_partkey")
    prefix = F.when(k % 50 == 0, "openai/gpt-").when(k % 50 == 1, "anthropic/claude-").when(k % 50 == 2, "qwen/qwen-").when(k % 50 == 3, "acme/embedding-").otherwise("acme/part-")
    none = lambda kind: F.lit(None).cast(kind)
    models = table(spark, sf, "part").select(F.concat(prefix, k.cast("string")).alias("id"), F.lit("").alias("name"), none("string").alias("description"), big(F.col("p_size")).alias("created"), (k * 10).alias("context_length"), text("p_retailprice").alias("prompt_price"), F.lit("0").alias("completion_price"), none("array<string>").alias("output_modalities"), none("array<string>").alias("supported_parameters"))
    return builders.select_models(models).select("family", "id")


@query("""with g as (select l_orderkey as b, l_linenumber as i, max_by(-l_quantity, l_partkey * 1000000 + l_suppkey) as gold, max_by(l_extendedprice, l_partkey * 1000000 + l_suppkey) as pred from lineitem where l_orderkey % 2 = 0 group by 1, 2), t as (select b, row_number() over (partition by b order by gold desc, i) as gi, row_number() over (partition by b order by pred desc, i) as pi from g)
select count(distinct b) as panels, round(avg(e), 9) as top_1 from (select b, max((gi = 1 and pi = 1)::int) as e from t group by 1)""")
def panel_evaluation(spark, sf):
    """JN2, AGG9, AGG10, AGG11, GEN12: panels against predicted scores, lower values stronger, incomparable panels left out."""
    order = F.col("l_partkey") * 1000000 + F.col("l_suppkey")
    item = F.struct(F.col("l_linenumber").cast("string").alias("item_id"), F.lit(None).cast("string").alias("peptide"), F.col("q").alias("measured_value"))
    score = F.struct(F.col("l_linenumber").cast("string").alias("item_id"), F.col("p").alias("score"), F.lit(1).alias("rank"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_quantity", order).alias("q"), F.max_by("l_extendedprice", order).alias("p"))
    packed = rows.groupBy(text("l_orderkey").alias("benchmark_id"), "l_orderkey").agg(F.collect_list(item).alias("items"), F.collect_list(score).alias("scores"))
    cases = packed.select("benchmark_id", "items", F.lit("lower_is_stronger").alias("measurement_direction"), (F.col("l_orderkey") % 2 == 0).alias("comparable_panel"))
    m = ranking.evaluate_binding_rank(cases, packed.select("benchmark_id", "scores"))
    return m.select(F.col("assay_aware_subgroup_count").alias("panels"), F.round("top_1_enrichment", 9).alias("top_1"))


# Scalar functions


@query("""select p_partkey, case p_partkey % 3 when 0 then 'train' when 1 then 'dev' else 'test' end as split, 2::bigint as options, lower(p_name || ' ' || p_brand) as lowered, case p_partkey % 4 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence, case p_partkey % 4 when 0 then 0.8 when 1 then 0.5 when 2 then 0.2 else 0.0 end::double as value, [p_name] = ['x'] as same from part""")
def word_functions(spark, sf):
    """STR5, STR8, STR17, STR18, STR20, STR21, NUM1: splits, options, joined texts, cleaned lists and confidence words."""
    k = F.col("p_partkey")
    word = pick(("High", "medium ", "LOW", "none"), k)
    return table(spark, sf, "part").select(
        "p_partkey", texts.split_name(pick((" Train", "DEV", "test"), k)).alias("split"), big(F.size(texts.options(F.concat_ws(",", F.lit(" a"), F.lit(""), F.lit("b ")))) ).alias("options"),
        texts.joined_lower(F.col("p_name"), F.col("p_brand")).alias("lowered"), texts.confidence_word(word).alias("confidence"), texts.confidence_value(word).cast("double").alias("value"),
        F.array_contains(texts.clean_strings(F.array(F.col("p_name"), F.lit(" "))), "x").alias("same"),
    )


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 0 else o_custkey end as counted, least(1.0, o_totalprice / 200000) as clamped, least(o_orderkey, case o_orderstatus when 'O' then 100 else 1024 end)::bigint as tokens, round(case when o_orderkey % 4 = 0 then 1.5 when o_orderkey % 4 = 1 then 2.5 else o_custkey * 0.001 + 2 * 0.01 end::double, 9) as cost, case when o_orderkey % 5 > 0 then o_totalprice end as number from orders""")
def number_functions(spark, sf):
    """NUM6, NUM7, NUM10, AGG51: counts, numbers, clamped values, token limits by track, and the cost of usage."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    cost = numbers.usage_cost(F.when(k % 4 == 0, "1.5"), F.when(k % 4 == 1, "2.5").when(k % 4 == 0, "9"), text("o_custkey"), F.lit("2"), F.lit("0.001"), F.lit("0.01"))
    return o.select("o_orderkey", numbers.count_of(F.when(k % 3 == 0, "none").otherwise(text("o_custkey"))).alias("counted"), numbers.clamp(F.col("o_totalprice") / 200000).alias("clamped"), big(numbers.track_tokens(F.col("o_orderstatus"), k, {"O": 100})).alias("tokens"), F.round(cost, 9).alias("cost"), F.when(k % 5 > 0, text("o_totalprice")).otherwise("x").try_cast("double").alias("number"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, json_extract_string(props, '$.k')::bigint as k, case when event_id % 3 = 0 then null else 'OBJECT' end as kind from events")
def instants_and_objects(spark, sf):
    """DAT1, JSN1: instants in UTC, and the object of a text, whole or from its first to its last brace."""
    t = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("so: "), "props", F.lit(" done")))
    v = object_in(t)
    return table(spark, sf, "events").select("event_id", hashes.utc_now(F.col("ts")).alias("at"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.when(v.isNotNull(), "OBJECT").alias("kind"))


@query("select track, count(*) as n, '' as lacks from (values ('structure'), ('pose'), ('binding_rank'), ('human_effect')) v(track) group by 1 union all select 'claim_status', 6, 'unsafe_to_claim'")
def formats_and_domains(spark, sf):
    """ARR5, MAP2, SNK10, SNK11: templates of every format, schemas as JSON, and a closed domain."""
    where = scratch(spark, "templates")
    paths = sinks.write_templates(spark, where)
    heads = [spark.read.text(p).where(F.col("value") == ",".join(f.name for f in case_schema(t).fields)).select(F.lit(t).alias("track")) for t, p in zip(TRACKS, paths, strict=True)]
    found = keys.union_all(*heads).where(F.lit(set(sinks.json_schemas()) == {f"{t}_{k}" for t in TRACKS for k in ("case", "prediction")})).groupBy("track").agg(F.count(F.lit(1)).alias("n")).withColumn("lacks", F.lit(""))
    domain = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in DOMAINS["claim_status"]])).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("v").startswith("unsafe"), F.col("v"))).alias("lacks"))
    return found.unionByName(domain.withColumn("track", F.lit("claim_status")).select("track", "n", "lacks"))


@query("""select 'datasheet' as report, 25::bigint as lines union all select 'card', 4 union all select 'violations', 1 union all select 'sources', 2 union all select 'board', count(*) from supplier""")
def reports(spark, sf):
    """SNK3, SNK8, SNK16, SNK17, SNK18, SNK19, SNK20, GEN20: Markdown and the page, counted by the rows they show."""
    nation = table(spark, sf, "nation")
    cases = nation.select(F.col("n_name").alias("source_database"), pick(TRACKS, F.col("n_nationkey")).alias("track"))
    lines = lambda t, mark: sum(mark in line for line in t.splitlines())
    public = leaderboard.public_rows(_rows(spark, sf)).persist()
    page = sinks.leaderboard_page(public)
    found = {
        "datasheet": lines(sinks.datasheet(cases), "NATION"),
        "card": lines(sinks.benchmark_card(cases, "draft"), "| ") - 2,
        "violations": lines(sinks.release_report(spark.createDataFrame([("s", "bad thing")], "scope string, message string")), "bad thing"),
        "sources": lines(sinks.source_card(nation.where("n_nationkey = 1").select(F.col("n_name").alias("name"), "n_regionkey")), "- "),
        "board": lines(sinks.leaderboard_report(public), "Supplier#") if page.count("<tr>") == public.count() + 1 else -1,
    }
    public.unpersist()
    return spark.createDataFrame([(k, int(v)) for k, v in found.items()], "report string, lines bigint")


@query(f"with {_ROWS} select model_id, k % 19 = 0 as sanity, k % 3 = 0 as anew from v")
def preserved_rows(spark, sf):
    """PRJ58: the rows of other models stay when some models' rows are written anew."""
    rows = leaderboard.strict(_rows(spark, sf))
    new = rows.where("cast(substr(model_id, 10) as bigint) % 3 = 0").withColumn("anew", F.lit(True))
    return keys.upsert(rows.withColumn("anew", F.lit(False)), new, ["model_id", "mode"]).select("model_id", leaderboard.is_sanity().alias("sanity"), "anew")


@query(f"""select 'panel' as what, count(distinct l_orderkey) as n from lineitem union all select 'scale', {len(qc.SCALES)} union all select 'shown', {sum(map(len, projections.SHOWN.values()))}""")
def inventory(spark, sf):
    """SRC8: results of a folder as rows; sizes of the fixed tables."""
    where = scratch(spark, "results") + ".json"
    _items(spark, sf).agg(F.countDistinct("panel").alias("n")).select(F.to_json(F.struct("n")).alias("value")).write.text(where)
    read = files.read_results(spark, where).where("result like '%n%'").select(F.lit("panel").alias("what"), F.get_json_object("result", "$.n").try_cast("bigint").alias("n"))
    return read.union(spark.createDataFrame([("scale", len(qc.SCALES)), ("shown", sum(map(len, projections.SHOWN.values())))], "what string, n bigint"))


@query("""with e as (select row_number() over (order by p_partkey) - 1 as ord, p_partkey, p_size from part), ok as (select *, row_number() over (order by ord) as nth from e where p_size between 2 and 11),
ends as (select least(100 * (2 ** r - 1), (select count(*) from e))::bigint as stop, r from range(1, 40) t(r)), got as (select stop, r, (select count(*) from ok where ord < stop) as n from ends), fin as (select min(stop) as rows_read, min(r) as rounds from got where n >= 150 or stop = (select count(*) from e))
select ord, p_partkey, p_size, rows_read, rounds from ok, fin where nth <= 150 and ord < rows_read""")
def early_stop(spark, sf):
    """SRT7, SET8: parts in order are read in growing rounds until 150 are accepted; how many were read is part of the result."""
    where = scratch(spark, "in-order")
    positions(table(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey"], "ord").write.parquet(where)
    parts = spark.read.parquet(where)
    got = rounds.until(rounds.of_table(parts), lambda df: df.where("p_size between 2 and 11"), 150, 100, length=parts.count())
    return got.rows.select("ord", "p_partkey", "p_size", F.lit(got.read).cast("long").alias("rows_read"), F.lit(got.rounds).cast("long").alias("rounds"))


@query("""with c as (select distinct c_custkey // 100 as chunk from customer), m as (select 'm' || r_regionkey as model_id from region where r_regionkey < 3)
select model_id, case when model_id = 'm0' then case when chunk = 0 then 'failed' else 'fallback' end when model_id = 'm1' and chunk >= 7 then case when chunk = 7 then 'failed' else 'fallback' end else 'completed' end as status, case when model_id = 'm0' and chunk = 0 then 'credits_exhausted' when model_id = 'm1' and chunk = 7 then 'invalid_json' end as error_type,
sum(case when model_id = 'm0' then (chunk = 0)::int when model_id = 'm1' and chunk >= 7 then case when chunk = 7 then 3 else 0 end else 1 end)::bigint as attempts, count(*) as n from c, m group by 1, 2, 3""")
def stateful_runs(spark, sf):
    """EXT1, EXT2, EXT3, EXT4, EXT7, EXT15: the chunks of three models as a stream of requests, the queue of each model, mode and track as keyed state with timers for pauses."""
    prompts = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).alias("chunk")).distinct().select(F.lit("base").alias("mode"), F.lit("human_effect").alias("track"), "chunk", F.array(text("chunk")).alias("benchmark_ids"), text("chunk").alias("messages"), F.concat(F.lit("short "), text("chunk")).alias("compact"))
    models = table(spark, sf, "region").where("r_regionkey < 3").select(F.concat(F.lit("m"), text("r_regionkey")).alias("model_id"), F.lit("base").alias("mode"), F.lit("human_effect").alias("track"))
    requests = model_runs.requests_for(models, prompts).select("model_id", "mode", "track", "chunk", "benchmark_ids", "messages", "compact")
    source = scratch(spark, "requests")
    requests.write.parquet(source)
    stream = runs.ready(spark).readStream.schema(requests.schema).parquet(source)
    results = runs.run_stream(stream, _answer, json.loads, model_runs.run_ladder(2), first_wait=0.01, seconds=5)
    out = runs.drain(results, scratch(spark, "results"), scratch(spark, "progress"), spark.read.parquet(source).count())
    return out.groupBy("model_id", "status", "error_type").agg(big(F.sum("attempts")).alias("attempts"), F.count(F.lit(1)).alias("n"))
