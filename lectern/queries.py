"""Queries over the driver's tables, an operator each, with the same in DuckDB SQL.

Records that the tables lack (cases, predictions, leaderboard rows) are derived
from their keys by fixed arithmetic, the same in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import numbers, text
from lectern.functions.json import extraction, message_content
from lectern.operators import builders, evidence, keys, leaderboard, ordering, projections, qc, ranking, release, retries, splits, structure
from lectern.runtime import ship
from lectern.schemas import DOMAINS, missing, quote_too_long

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SCALE = evidence.EVIDENCE_ORDER
CLAIMS, SAFETY, DIRECTIONS = DOMAINS["claim_status"], DOMAINS["safety_status"], DOMAINS["evidence_direction"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Narrow rows dealt over the session's partitions before they become wide: a small file is one task, however much is made of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], at: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[(({at}) % {len(values)}) + 1]"


# Sources and projections


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where event_type = 'purchase' and json_extract_string(props, '$.k')::bigint > 50")
def scan_json_filter(spark, sf):
    """JSN6: the text of a chat answer, and a filter that reaches the scan."""
    rows = table(spark, sf, "events").where("event_type = 'purchase'")
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("props").alias("content")).alias("message"))).alias("choices")))
    return rows.select("event_id", F.get_json_object(message_content(answer), "$.k").try_cast("bigint").alias("k")).where("k > 50")


@query("select doc_id, case when text is null or text = '' then 'text' when coalesce(source, '') = '' then 'source' end as lacks, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) > 35 as too_long from documents")
def validation_columns(spark, sf):
    """PRJ1, CHK37: constraint columns."""
    return table(spark, sf, "documents").select("doc_id", F.when(missing(F.col("text")), "text").when(missing(F.col("source")), "source").alias("lacks"), quote_too_long(F.col("text")).alias("too_long"))


@query("""with f as (select conv_id, min(turn) as t from conversations where role = 'assistant' group by 1)
select c.conv_id, count(*) as turns, sum(length(c.text))::bigint as chars from conversations c left join f using (conv_id) where f.t is null or c.turn < f.t group by 1""")
def prompt_prefix(spark, sf):
    """PRJ54: the turns before the first answer."""
    return projections.prompt_prefix(table(spark, sf, "conversations")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("select o_orderstatus, count(*) as n from orders where lower(coalesce(nullif(trim(case o_orderstatus when 'O' then 'Dev' when 'F' then 'train' else '' end), ''), 'test')) in ('test','dev','validation','valid','eval','holdout') group by 1")
def eval_rows(spark, sf):
    """PRJ33: a row without a split is an evaluation row."""
    split = F.when(F.col("o_orderstatus") == "O", "Dev").when(F.col("o_orderstatus") == "F", "train").otherwise("")
    return table(spark, sf, "orders").where(splits.is_eval(split)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# Keyed operators and joins


@query("select o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def dedupe_first(spark, sf):
    """AGG12: the first row of each key."""
    return keys.first_by(table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("ord")), ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("select user_id, event_type, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value from events group by 1, 2")
def latest_by_key(spark, sf):
    """AGG13, AGG14: the last row of each key."""
    return keys.last_by(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("ord")), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@query("select c_custkey from customer where c_custkey not in (select user_id from events)")
def missing_predictions(spark, sf):
    """JN11: cases that no prediction answers."""
    return keys.without(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "events").select(F.col("user_id").alias("c_custkey")), ["c_custkey"])





@query("select sha256(text) as sha256, count(*) as n, min(doc_id) as first_key from documents group by 1 having count(*) > 1")
def duplicate_texts(spark, sf):
    """HSH1: repeated texts by digest."""
    return keys.duplicates_by_hash(table(spark, sf, "documents"), "text", "doc_id")


@query("""with a as (select s_suppkey::varchar as residue, s_acctbal / 40 as x, s_nationkey * 3.0 as y, (s_suppkey % 40)::double as z from supplier),
b as (select c_custkey::varchar as other_residue, c_acctbal / 40 as x, c_nationkey * 3.0 as y, (c_custkey % 40)::double as z from customer)
select residue, other_residue, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 3) as distance from a, b
where sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 5 group by 1, 2""")
def contact_join(spark, sf):
    """JN8: pairs closer than the cutoff by a grid of cells."""
    atoms = lambda name, p: table(spark, sf, name).select(F.col(f"{p}key").cast("string").alias("residue"), (F.col(f"{p[:2]}acctbal") / 40).alias("x"), (F.col(f"{p[:2]}nationkey") * 3.0).alias("y"), (F.col(f"{p}key") % 40).cast("double").alias("z"))
    return structure.contacts(atoms("supplier", "s_supp"), atoms("customer", "c_cust"))


_ATOM = "select {k}::varchar as r, {k} * 37 % 11 / 3.0 as x, {k} * 91 % 13 / 3.0 as y, {k} % 7 / 2.0 as z"


@query(f"""with a as ({_ATOM.format(k="p_partkey")} from part), b as ({_ATOM.format(k="s_suppkey")} from supplier)
select a.r as residue, count(*) as n, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 3) as nearest from a, b where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 25 group by a.r""")
def crowded_contacts(spark, sf):
    """JN8, JN9, SRT8: contacts where all atoms lie in a few cells, which are dealt into parts; residues with the same atoms are met once, with their number."""
    atoms = lambda name, key: table(spark, sf, name).select(F.col(key).cast("string").alias("residue"), (F.col(key) * 37 % 11 / 3.0).alias("x"), (F.col(key) * 91 % 13 / 3.0).alias("y"), (F.col(key) % 7 / 2.0).alias("z"))
    return structure.contact_counts(atoms("part", "p_partkey"), atoms("supplier", "s_suppkey"), part=64)


# Ranking


@query("select c_custkey, rank() over (partition by c_nationkey order by c_mktsegment) + (count(*) over (partition by c_nationkey, c_mktsegment) - 1) / 2.0 as place from customer")
def average_rank(spark, sf):
    """AGG4, WIN1: ranks with ties sharing their mean."""
    return table(spark, sf, "customer").select("c_custkey", ranking.average_rank("c_mktsegment", ["c_nationkey"]).alias("place"))


_ITEMS = "items as (select l_orderkey as panel, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as item, -l_quantity as gold, l_extendedprice as pred from lineitem)"
_PAIRS = "pairs as (select a.panel, sum(case when (a.gold - b.gold) * (a.pred - b.pred) > 0 then 1 else 0 end)::bigint as c, sum(case when (a.gold - b.gold) * (a.pred - b.pred) < 0 then 1 else 0 end)::bigint as d from items a join items b on a.panel = b.panel and a.item < b.item group by 1)"
_RANKS = "ranks as (select panel, rank() over (partition by panel order by gold) + (count(*) over (partition by panel, gold) - 1) / 2.0 as g, rank() over (partition by panel order by pred) + (count(*) over (partition by panel, pred) - 1) / 2.0 as p from items)"
_RHO = "rho as (select panel, count(*) as n, coalesce(covar_pop(g, p) / nullif(sqrt(var_pop(g) * var_pop(p)), 0), 0) as spearman from ranks group by 1)"
_TOP = "top as (select panel, sum(case when gi = 1 and pi = 1 then 1 else 0 end) / 1.0 as e from (select panel, row_number() over (partition by panel order by gold desc, item) as gi, row_number() over (partition by panel order by pred desc, item) as pi from items) group by 1)"


def _items(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("panel"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("item"), ranking.strength(F.col("l_quantity"), F.lit("lower_is_stronger")).alias("gold"), F.col("l_extendedprice").alias("pred"))


@query(f"with {_ITEMS}, {_RANKS}, {_RHO} select panel, n, round(spearman, 6) + 0.0 as spearman from rho")
def spearman(spark, sf):
    """AGG5: rank correlation of each panel."""
    return ranking.spearman(_items(spark, sf), ["panel"]).select("panel", "n", (F.round("spearman", 6) + 0.0).alias("spearman"))


@query(f"with {_ITEMS}, {_PAIRS} select i.panel, coalesce(c, 0)::bigint as concordant, coalesce(d, 0)::bigint as discordant, round(coalesce((c - d) / nullif(c + d, 0), 0), 6) + 0.0 as kendall_tau, round(coalesce(c / nullif(c + d, 0), 0), 6) as pairwise_accuracy from (select distinct panel from items) i left join pairs using (panel)")
def pair_metrics(spark, sf):
    """JN6, JN7, AGG6, AGG7: Kendall without ties and pairwise accuracy, pairs counted inside rows."""
    return ranking.pair_metrics(_items(spark, sf), ["panel"]).select("panel", "concordant", "discordant", F.round("kendall_tau", 6).alias("kendall_tau"), F.round("pairwise_accuracy", 6).alias("pairwise_accuracy"))


@query(f"with {_ITEMS}, {_TOP} select panel, e as top_enrichment from top")
def top_enrichment(spark, sf):
    """AGG8: overlap of the best items."""
    return ranking.top_k(_items(spark, sf), ["panel"])


@query(f"with {_ITEMS}, {_PAIRS}, {_RANKS}, {_RHO}, {_TOP} select round(avg(spearman), 6) as spearman, round(avg(coalesce((c - d) / nullif(c + d, 0), 0)), 6) as kendall_tau, round(avg(coalesce(c / nullif(c + d, 0), 0)), 6) as pairwise, round(avg(e), 6) as top_1, count(*) as panels from rho left join pairs using (panel) left join top using (panel)")
def panel_averages(spark, sf):
    """AGG11: means over panels."""
    each = ranking.panel_metrics(_items(spark, sf), ["panel"])
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return each.agg(mean("spearman", "spearman"), mean("kendall_tau", "kendall_tau"), mean("pairwise_accuracy", "pairwise"), mean("top_enrichment", "top_1"), F.count(F.lit(1)).alias("panels"))


_HOT = "h as (select case when l_returnflag = 'R' then 'R' else 'other' end as panel, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as item, -l_quantity as gold, l_extendedprice as pred from lineitem)"


@query(f"""with {_HOT}, n as (select panel, count(*) as n from h group by panel), g as materialized (select distinct panel, gold from h),
c as (select panel, gold, pred, count(*) as n from h group by all), grid as (select p.panel, p.pred, g.gold, coalesce(c.n, 0) as n from (select distinct panel, pred from h) p join g using (panel) left join c on c.panel = p.panel and c.pred = p.pred and c.gold = g.gold),
up as (select *, sum(n) over (partition by panel, gold order by pred rows between unbounded preceding and 1 preceding) as below, sum(n) over (partition by panel, gold) as whole from grid),
seen as (select *, sum(coalesce(below, 0)) over (partition by panel, pred order by gold rows between unbounded preceding and 1 preceding) as less, sum(whole - coalesce(below, 0) - n) over (partition by panel, pred order by gold rows between unbounded preceding and 1 preceding) as more from up),
cd as (select panel, sum(n * coalesce(less, 0))::bigint as concordant, sum(n * coalesce(more, 0))::bigint as discordant from seen group by panel),
r as (select panel, rank() over (partition by panel order by gold) + (count(*) over (partition by panel, gold) - 1) / 2.0 as g, rank() over (partition by panel order by pred) + (count(*) over (partition by panel, pred) - 1) / 2.0 as p from h), rho as (select panel, round(corr(g, p), 9) as spearman from r group by panel),
t as (select panel, count(*) filter (gi <= 100 and pi <= 100) / 100.0 as top from (select panel, row_number() over (partition by panel order by gold desc, item) as gi, row_number() over (partition by panel order by pred desc, item) as pi from h) group by panel)
select panel, n, spearman, concordant, discordant, round((concordant - discordant) / (concordant + discordant), 9) as kendall_tau, round(top, 9) as top_enrichment from n join cd using (panel) join rho using (panel) join t using (panel)""")
def whole_panels(spark, sf):
    """AGG4-8, JN6, JN7, WIN1: two panels that hold every line: ranks, pairs and the best hundred by range partitions."""
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "R").otherwise("other").alias("panel"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"), ranking.strength(F.col("l_quantity"), F.lit("lower_is_stronger")).alias("gold"), F.col("l_extendedprice").alias("pred"))
    out = ranking.panel_metrics(rows, ["panel"], k=100, large=10_000)
    return out.select("panel", "n", F.round("spearman", 9).alias("spearman"), "concordant", "discordant", F.round("kendall_tau", 9).alias("kendall_tau"), F.round("top_enrichment", 9).alias("top_enrichment"))


# Classification and set metrics


@query("""with p as (select o_orderpriority as g, case when o_totalprice > 150000 then '1-URGENT' when o_totalprice > 100000 then '2-HIGH' when o_totalprice > 50000 then '5-LOW' else 'none' end as q from orders),
l as (select label, sum(g) as g, sum(q) as q, sum(tp) as tp from (select g as label, 1 as g, 0 as q, (g = q)::int as tp from p union all select q, 0, 1, 0 from p) group by 1)
select round(avg(2 * tp / (g + q)), 9) as macro_f1 from l""")
def macro_f1(spark, sf):
    """AGG2: mean F1 over all labels of either side."""
    price = F.col("o_totalprice")
    pairs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("gold"), F.when(price > 150000, "1-URGENT").when(price > 100000, "2-HIGH").when(price > 50000, "5-LOW").otherwise("none").alias("pred"))
    return evidence.macro_f1(pairs).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("select lang, round(coalesce(avg(((n_chars > 1000)::int = quality)::int), 0), 9) as accuracy, count(*) as n from documents join labels using (doc_id) group by 1")
def accuracy(spark, sf):
    """AGG1, JN1: accuracy of joined labels."""
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.round(evidence.accuracy((F.col("n_chars") > 1000).cast("int") == F.col("quality")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_LEVELS = "[" + ", ".join(repr(s) for s in SCALE) + "]"


def _effects(spark, sf) -> tuple[DataFrame, DataFrame]:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    c = table(spark, sf, "customer")
    cases = c.select(k.alias("benchmark_id"), F.col("c_mktsegment").alias("category"), pick(SCALE, k).alias("evidence_level"), pick(DIRECTIONS, k).alias("evidence_direction"), pick(CLAIMS, k + n).alias("claim_status"), pick(SAFETY, k).alias("safety_status"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("trial_has_results"))
    pred = c.where(k % 10 < 8).select(k.alias("benchmark_id"), F.when(k % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("category"), pick(SCALE, k * 5 + n).alias("evidence_level"), pick(DIRECTIONS, k + n).alias("evidence_direction"), pick(CLAIMS, k * 3).alias("claim_status"), pick(SAFETY, k + n).alias("safety_status"), (k % 5 == 0).alias("abstained"), F.when(k % 11 == 0, "failed").otherwise("completed").alias("status"))
    return cases, pred


_EFFECTS = f"""m as (select c_custkey as k, c_nationkey as n, c_mktsegment as cat, k % 11 = 0 as f, k % 6 as g, (k * 5 + n) % 6 as p,
 {sql_pick(DIRECTIONS, 'k')} as gd, {sql_pick(DIRECTIONS, 'k + n')} as pd, {sql_pick(CLAIMS, 'k + n')} as gc, {sql_pick(CLAIMS, 'k * 3')} as pc, {sql_pick(SAFETY, 'k')} as gs, {sql_pick(SAFETY, 'k + n')} as ps,
 case when k % 3 = 0 then false when k % 3 = 1 then true end as r, k % 5 = 0 as a, case when f then '__failed_prediction__' when k % 4 = 0 then 'OTHER' else cat end as pcat from customer where c_custkey % 10 < 8),
u as (select *, gc in ('unsupported', 'unsafe_to_claim', 'insufficient_information') as t from m),
l as (select label, sum(g) as g, sum(q) as q, sum(tp) as tp from (select cat as label, 1 as g, 0 as q, (cat = pcat)::int as tp from m union all select pcat, 0, 1, 0 from m) group by 1)"""


@query(f"""with {_EFFECTS} select round(avg((not f and g = p)::int), 9) as level_accuracy, round(avg((not f and gd = pd)::int), 9) as direction_accuracy, round(avg((not f and gc = pc)::int), 9) as claim_accuracy,
round(avg(case when f then 5 else abs(g - p) end), 9) as distance, count(*) filter (not f and p > g) as overclaims, count(*) filter (not f and t and pc = 'supported') as hallucinated,
count(*) filter (not f and gs in ('known_risk', 'serious_known_risk', 'not_for_human_use') and ps = 'known_acceptable_under_approved_use') as unsafe, count(*) filter (not f and r is not distinct from false and p = 5) as trial,
count(*) filter (not f and g = 1 and p > 1) as pathway, count(*) filter (not f and t and a) as abstained, count(*) filter (f) as failed,
round(count(*) filter (not f and t and pc in ('unsupported', 'unsafe_to_claim', 'insufficient_information')) / nullif(count(*) filter (t), 0), 9) as detection, (select round(avg(2 * tp / (g + q)), 9) from l) as category_f1, count(*) as matched from u""")
def effect_metrics(spark, sf):
    """AGG21: all metrics of claims, failed predictions as wrong."""
    r = lambda c, n: F.round(c, 9).alias(n)
    out = evidence.evaluate_human_effect(*_effects(spark, sf))
    return out.select(r("evidence_level_ordinal_accuracy", "level_accuracy"), r("evidence_direction_accuracy", "direction_accuracy"), r("claim_status_accuracy", "claim_accuracy"), r("evidence_level_distance_penalty", "distance"), F.col("overclaim_penalty").alias("overclaims"), F.col("hallucinated_support_penalty").alias("hallucinated"), F.col("safety_overclaim_penalty").alias("unsafe"), F.col("trial_without_results_penalty").alias("trial"), F.col("pathway_only_overclaim_penalty").alias("pathway"), F.col("correct_abstention_credit").alias("abstained"), F.col("failed_prediction_count").alias("failed"), r("unsupported_claim_detection_rate", "detection"), r("category_macro_f1", "category_f1"), F.col("n_matched").alias("matched"))



@query("""with a as (select vec_id // 2 as pair, vec_id % 2 as side, i, embedding[i*3+1]::double as x, embedding[i*3+2]::double as y, embedding[i*3+3]::double as z from embeddings, range(0, 21) t(i))
select g.pair, count(*) as n_atoms, round(sqrt(sum((g.x-p.x)**2 + (g.y-p.y)**2 + (g.z-p.z)**2) / count(*)), 6) as rmsd from a g join a p on g.pair = p.pair and g.i = p.i and g.side = 0 and p.side = 1 group by 1""")
def rmsd(spark, sf):
    """JN5, AGG19: deviation over shared atoms: all whole triples of a vector."""
    atoms = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda i: F.struct(i.alias("atom_id"), *[F.element_at("embedding", i * 3 + j + 1).cast("double").alias(c) for j, c in enumerate("xyz")]))
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.explode(atoms).alias("a")).select("pair", "side", "a.*", F.lit(0).alias("ord"))
    return structure.rmsd(e.where("side = 0").drop("side"), e.where("side = 1").drop("side"), ["pair"]).select("pair", "n_atoms", F.round("rmsd", 6).alias("rmsd"))


# Leaderboard and retries

_ROWS = """r as (select s_name as model_id, s_suppkey as k, 0.5 + (s_suppkey % 97) / 1000 as mean_score, case when k % 7 = 0 then 9 else 10 end as completed, case when k % 5 = 0 then 0.9 end as valid,
 case when k % 13 = 0 then 2 else 0 end as api, case when k % 5 = 0 then 1 else 0 end as bad_json, case when k % 10 = 0 then 1 else 0 end as failed, k % 17 = 0 as baseline, case when k % 19 = 0 then 'sanity_check' else 'base' end as mode from supplier),
s as (select *, least(1.0, completed / 10) as cov, case when mode = 'sanity_check' then 'noncompetitive_oracle' when baseline then 'noncompetitive_baseline' when api > 0 then 'excluded_provider_error'
 when bad_json > 0 then case when failed >= bad_json and valid is not null and completed >= 10 then 'completed_with_failures' else 'excluded_invalid_json' end when completed < 10 then 'excluded_incomplete' else 'clean_completed' end as row_status from r),
t as (select *, row_status in ('clean_completed', 'completed_with_failures') as ok from s),
v as (select *, case when ok then mean_score * cov * coalesce(valid, 1) end as adjusted from t)"""


def _rows(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_name").alias("model_id"), F.when(k % 19 == 0, "sanity_check").otherwise("base").alias("mode"), (0.5 + (k % 97) / 1000).alias("mean_score"), F.lit(10).alias("total_cases_attempted"), F.when(k % 7 == 0, 9).otherwise(10).alias("total_cases_completed"), F.when(k % 5 == 0, 0.9).alias("valid_prediction_rate"), F.when(k % 13 == 0, 2).otherwise(0).alias("api_error_count"), F.when(k % 5 == 0, 1).otherwise(0).alias("invalid_json_count"), F.when(k % 10 == 0, 1).otherwise(0).alias("failed_prediction_count"), (k % 17 == 0).alias("is_baseline"))


@query(f"with {_ROWS} select model_id, mode, row_status, ok as competitive, round(adjusted, 6) as adjusted, case when ok then row_number() over (partition by ok order by adjusted desc, mean_score desc, model_id, mode) end as rank from v")
def leaderboard_ranks(spark, sf):
    """AGG24-27, WIN3, SRT1, PRJ36, CHK22-23: strict status, adjusted score and rank."""
    return leaderboard.public_rows(_rows(spark, sf)).select("model_id", "mode", "row_status", "competitive", F.round("coverage_adjusted_score", 6).alias("adjusted"), F.col("rank").cast("bigint").alias("rank"))


@query(f"with {_ROWS} select row_status, count(*) as n from v where row_status like 'excluded%' group by 1")
def excluded_models(spark, sf):
    """AGG33: what is not ranked, by status."""
    return leaderboard.excluded(_rows(spark, sf)).groupBy("row_status").agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select l_suppkey as k, avg(l_discount) * 10 as a, avg(l_tax) * 12 as b, avg(l_quantity) / 50 as c, count(*) as n from lineitem group by 1)
select k, round(case k % 3 when 0 then greatest(0, (a + b + c + a + b) / 5 - 1.0 / greatest(n, 1)) when 1 then ((a + 1) / 2 + (b + 1) / 2 + c) / 3 else coalesce(2 * a * c / nullif(a + c, 0), 0) end, 6) as score from x""")
def track_scores(spark, sf):
    """AGG22: score formulas of the tracks."""
    x = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((F.avg("l_discount") * 10).alias("a"), (F.avg("l_tax") * 12).alias("b"), (F.avg("l_quantity") / 50).alias("c"), F.count(F.lit(1)).alias("n_cases"))
    t = x.select("k", "n_cases", F.when(F.col("k") % 3 == 0, "human_effect").when(F.col("k") % 3 == 1, "binding_rank").otherwise("pose").alias("track"), *[F.col(v).alias(n) for n, v in (("category_macro_f1", "a"), ("evidence_level_ordinal_accuracy", "b"), ("evidence_direction_accuracy", "c"), ("claim_status_accuracy", "a"), ("unsupported_claim_detection_rate", "b"), ("spearman", "a"), ("kendall_tau", "b"), ("pairwise_ranking_accuracy", "c"), ("interface_contact_precision", "a"), ("interface_contact_recall", "c"))], F.lit(1.0).alias("overclaim_penalty"))
    return leaderboard.with_track_scores(t).select("k", F.round("score", 6).alias("score"))


def _log(spark, sf) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("model_id"), F.lit("base").alias("mode"), F.lit("human_effect").alias("track"), (F.col("user_id") % 997).cast("string").alias("benchmark_id"), F.when(e.isin("error", "view"), "still_failed").otherwise("recovered").alias("retry_status"), F.when(e == "error", "invalid_json").when(e == "view", "api_error").alias("error_type"), F.col("event_id").alias("ord"))


@query("""with l as (select user_id % 20 as m, user_id % 997 as b, max_by(event_type, event_id) as e from events group by 1, 2)
select m::varchar as model_id, count(*) as retry_queue_size, count(*) filter (e not in ('error', 'view')) as retry_recovered_count, count(*) filter (e = 'error') as invalid, count(*) filter (e = 'view') as api from l group by 1""")
def retry_summary(spark, sf):
    """AGG14, AGG30, AGG31: last result of each item, counted."""
    return retries.summary(_log(spark, sf)).select("model_id", "retry_queue_size", "retry_recovered_count", F.col("post_retry_invalid_json_count").alias("invalid"), F.col("post_retry_api_error_count").alias("api"))


@query("""with m as (select distinct (user_id % 20)::varchar as model_id from events), w as (select model_id, o_orderkey as b, case o_orderstatus when 'P' then null when 'F' then 'x' else o_orderpriority end as p from m cross join (select * from orders where o_orderstatus in ('P', 'F')) o),
done as (select distinct m, b from (select (user_id % 20)::varchar as m, user_id % 997 as b, max_by(event_type, event_id) as e from events group by 1, 2) where e not in ('error', 'view'))
select model_id, case when p is null then 'missing_prediction' else 'fallback_prediction' end as reason, count(*) as n, sum(w.b)::bigint as ids from w left join done d on d.m = w.model_id and d.b = w.b where d.b is null group by 1, 2""")
def retry_queue(spark, sf):
    """JN13: what to retry for every model: no prediction or the fallback's, unless recovered since."""
    o = table(spark, sf, "orders")
    case, track = F.col("o_orderkey").cast("string").alias("benchmark_id"), F.lit("human_effect").alias("track")
    log = _log(spark, sf)
    models = log.select("model_id", "mode", "track").distinct()
    pred = models.drop("track").join(o.where("o_orderstatus <> 'P'").select(track, case, F.when(F.col("o_orderstatus") == "F", "x").otherwise(F.col("o_orderpriority")).alias("record_key")))
    found = retries.queue(o.select(track, case), models, pred, o.select(track, case, F.lit("x").alias("record_key")), log)
    return found.groupBy("model_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("benchmark_id").cast("bigint")).alias("ids"))


# Counts



@query("select v as value, count(o_orderstatus) as n from (values ('bundled'), ('derived'), ('source_reference_only'), ('excluded')) t(v) left join orders on case o_orderstatus when 'O' then 'bundled' when 'F' then 'derived' else 'excluded' end = v group by 1")
def mode_histogram(spark, sf):
    """AGG35: counts over a whole domain, zeros included."""
    mode = F.when(F.col("o_orderstatus") == "O", "bundled").when(F.col("o_orderstatus") == "F", "derived").otherwise("excluded")
    return release.histogram(table(spark, sf, "orders").select(mode.alias("release_mode")), "release_mode")



@query("select role, count(*) as n, count(*) filter (length(text) > 80) as valid, round(count(*) filter (length(text) > 80) / count(*), 9) as valid_rate from conversations group by 1")
def validity_by_task(spark, sf):
    """AGG41: valid share by task."""
    from lectern.operators.predictions import stats_by_task

    rows = table(spark, sf, "conversations").select(F.col("role").alias("task_type"), (F.length("text") > 80).alias("schema_valid"))
    return stats_by_task(rows).select(F.col("task_type").alias("role"), "n", "valid", F.round("valid_rate", 9).alias("valid_rate"))


@query("select sum(greatest(1, length(text) // 4))::bigint as tokens, round(sum(greatest(1, length(text) // 4)) * 1.1 * 3 / 1e6 * 0.4, 6) as cost from documents")
def token_cost(spark, sf):
    """AGG48-50: token and cost estimate."""
    return splits.cost_estimate(table(spark, sf, "documents"), "text", 3, 0.4, 1.1).select("tokens", F.round("cost", 6).alias("cost"))


# Windows, splits and chunks


@query("select o_orderkey, case when (rn - 1) % 10 < 7 then 'train' when (rn - 1) % 10 < 9 then 'dev' else 'test' end as split from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn from orders)")
def index_split(spark, sf):
    """WIN5: split by position, positions from range partitions."""
    at = ordering.positions(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return at.select("o_orderkey", splits.split_by_position(F.col("position")).alias("split"))


@query("select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as position from orders")
def order_positions(spark, sf):
    """WIN4, WIN5: positions in a total order with every column kept, from bounds that are drawn once."""
    return ordering.positions(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"])


@query("select l_orderkey, l_linenumber, l_returnflag, l_shipdate, row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber) - 1 as position from lineitem")
def group_positions(spark, sf):
    """WIN4, WIN5: positions within groups of any size, a third of all rows and more in one."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return ordering.positions_within(rows, "l_returnflag", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("select doc_id, case when rn <= floor(n * 0.1) then 'dev' when rn <= 2 * floor(n * 0.1) then 'holdout' else 'train' end as split from (select doc_id, row_number() over (order by sha256('7:' || doc_id), doc_id) as rn, count(*) over () as n from documents)")
def seeded_split(spark, sf):
    """WIN6: exact shares of a seeded order."""
    return splits.seeded_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("select c_nationkey, chunk, count(*) as n, min(c_custkey) as first_key from (select c_nationkey, c_custkey, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 25 as chunk from customer) group by 1, 2")
def fixed_chunks(spark, sf):
    """SRT4: chunks of a fixed size."""
    return keys.chunks(table(spark, sf, "customer"), "c_custkey", 25, "c_nationkey").groupBy("c_nationkey", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


@query("""with a as (select l_returnflag as allele, l_shipdate::date::varchar as assay, 'P' || l_partkey as s, min_by(l_quantity, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) as v, min(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) as ord from lineitem group by 1, 2, 3),
b as (select *, count(*) over (partition by allele, assay) as n, row_number() over (partition by allele, assay order by ord) as place from a),
c as (select *, count(*) over (partition by allele, assay) as size, rank() over (partition by allele, assay order by v) as rank from b where n >= 5 and place <= 10)
select allele, assay, place, v as measured_value, rank, round(1 - (rank - 1) / greatest(size - 1, 1), 9) as normalized_rank from c""")
def panel_builder(spark, sf):
    """AGG53, WIN2: grouped, deduplicated, ranked panels."""
    letters = F.translate(F.concat(F.lit("P"), F.col("l_partkey").cast("string")), "0123456789", "ABCDEFGHIJ")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("allele"), F.col("l_shipdate").cast("date").cast("string").alias("assay"), letters.alias("sequence"), F.col("l_quantity").alias("measure"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("ord"))
    return builders.panels(rows).select("allele", "assay", F.col("place").cast("bigint").alias("place"), "measured_value", F.col("rank").cast("bigint").alias("rank"), F.round("normalized_rank", 9).alias("normalized_rank"))


# Scalar functions


@query(r"""select p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') as sequence, coalesce(nullif(regexp_replace(regexp_replace(p_type || '/' || p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model') as slug,
translate(lower(trim(p_type || ' /' || p_brand)), ' /', '__') as source_name, split_part(p_brand || '/' || p_type, '/', 1) as provider, concat_ws('::', nullif(p_brand, ''), nullif(p_type, '')) as group_id from part""")
def name_functions(spark, sf):
    """STR1, STR3, STR4, STR6, STR7: names and ids."""
    p = table(spark, sf, "part")
    slash = lambda a, b, s="/": F.concat(F.col(a), F.lit(s), F.col(b))
    return p.select("p_partkey", text.clean_sequence(F.col("p_name")).alias("sequence"), text.slug(slash("p_type", "p_name")).alias("slug"), text.source_name(slash("p_type", "p_brand", " /")).alias("source_name"), text.provider(slash("p_brand", "p_type")).alias("provider"), text.group_id(F.col("p_brand"), F.col("p_type")).alias("group_id"))


@query(r"select p_partkey, p_size + 1000 + 0.5 as n from part")
def markup_numbers(spark, sf):
    """STR2: numbers out of markup."""
    markup = F.concat(F.lit("<td>&lt; "), F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5</td> nM"))
    return table(spark, sf, "part").select("p_partkey", text.number_in_markup(markup).cast("decimal(12,1)").alias("n"))


@query(r"""select p_partkey, length(p_name) as length, round(length(regexp_replace(upper(p_name), '[^AILMFWYV]', '', 'g')) / greatest(length(p_name), 1), 9) as hydrophobic, round(length(regexp_replace(upper(p_name), '[^DEKRH]', '', 'g')) / greatest(length(p_name), 1), 9) as charged from part""")
def sequence_features(spark, sf):
    """NUM2: features of sequences."""
    f = numbers.sequence_features(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", f["length"].cast("bigint").alias("length"), F.round(f["hydrophobic_fraction"], 9).alias("hydrophobic"), F.round(f["charged_fraction"], 9).alias("charged"))


@query("select doc_id, regexp_matches(lower(text), 'normalized_rank|measured_value|evidence_level|claim_status|safety_status|native_contacts|gold_coordinates') as marked from (select doc_id, text || case doc_id % 9 when 0 then ' Normalized_Rank' when 1 then ' claim_status' when 2 then ' gold_coordinates' when 3 then ' measured value' else '' end as text from documents)")
def answer_markers(spark, sf):
    """STR13, CHK26: texts that name gold fields."""
    more = F.expr("case doc_id % 9 when 0 then ' Normalized_Rank' when 1 then ' claim_status' when 2 then ' gold_coordinates' when 3 then ' measured value' else '' end")
    return table(spark, sf, "documents").select("doc_id", text.answer_like(F.concat("text", more)).alias("marked"))


_KEYS = "coalesce(text, '') || ' tml-' || doc_id || '_a hf_' || repeat('k', (doc_id % 40)::int) || ' TINKER_API_KEY = \"v' || doc_id || '\" HF_TOKEN=''x'' OPENROUTER_API_KEY=\"\" sk-or-v1-' || doc_id"
_REDACTED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_KEYS}, 'tml-[A-Za-z0-9_-]+', '[REDACTED]', 'g'), 'sk-or-v1-[A-Za-z0-9_-]+', '[REDACTED]', 'g'), 'hf_[A-Za-z0-9_-]{{20,}}', '[REDACTED]', 'g'),
'OPENROUTER_API_KEY\s*=\s*[''"][^''"]+[''"]', '[REDACTED]', 'g'), 'TINKER_API_KEY\s*=\s*[''"][^''"]+[''"]', '[REDACTED]', 'g'), 'HF_TOKEN\s*=\s*[''"][^''"]+[''"]', '[REDACTED]', 'g')"""


@query(f"select doc_id, len(string_split({_REDACTED}, '[REDACTED]')) - 1 as n, sha256({_REDACTED}) as redacted_sha256 from documents")
def redaction(spark, sf):
    """STR9-12, CHK27: secrets out of texts, keys of every kind behind each."""
    keyed = F.expr("coalesce(text, '') || ' tml-' || doc_id || '_a hf_' || repeat('k', int(doc_id % 40)) || ' TINKER_API_KEY = \"v' || doc_id || '\" HF_TOKEN=' || chr(39) || 'x' || chr(39) || ' OPENROUTER_API_KEY=\"\" sk-or-v1-' || doc_id")
    r = text.redact(keyed)
    return table(spark, sf, "documents").select("doc_id", (F.size(F.split(r, r"\[REDACTED\]")) - 1).cast("bigint").alias("n"), F.sha2(r, 256).alias("redacted_sha256"))


_CLAIM = "case doc_id % 8 when 0 then ' Clinically validated and release-ready.' when 1 then ' Not externally checked.' when 2 then ' externally checked' when 3 then ' Safe for human use; QUALITY CHECK REQUIRED' when 4 then ' direct human-effect prediction, fully complete' else '' end"


@query(f"""select doc_id, len(list_filter(['release candidate with issueers', 'issueer', 'issueed', 'quality check required', 'curation required', 'license qc required', 'required before release', 'needs chain-role gates', 'needs assay compatibility gates', 'needs conservative classification', 'scientifically complete', 'fully complete', 'release-ready',
'clinically validated', 'safe for human use', 'predicts human effects', 'provides medical advice', 'is medical advice', 'validates human use'], lambda p: contains(t, p))) + (contains(t, 'externally checked') and not contains(t, 'not externally checked'))::int + (contains(t, 'direct human-effect prediction') and not contains(t, 'not direct human-effect prediction'))::int as n from (select doc_id, lower(text || {_CLAIM}) as t from documents)""")
def claim_phrases(spark, sf):
    """STR16: prohibited phrases."""
    return table(spark, sf, "documents").select("doc_id", F.size(text.claim_errors(F.concat("text", F.expr(_CLAIM)))).cast("bigint").alias("n"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 'infinity'::double) + 1.5 as price from events")
def prices(spark, sf):
    """NUM3, NUM4: numbers or infinity."""
    return table(spark, sf, "events").select("event_id", numbers.model_price(F.get_json_object("props", "$.k"), F.lit("1.5")).alias("price"))


@query("""select c_custkey, c_custkey % 6 as left_rank, (c_custkey * 7 + c_nationkey) % 6 as right_rank, """ + sql_pick(qc.SCALES["evidence_level"], "greatest(c_custkey % 6, (c_custkey * 7 + c_nationkey) % 6)") + """ as merged from customer""")
def conservative_merge(spark, sf):
    """MAP1, SET4: the more conservative of two labels."""
    a, b = F.col("c_custkey") % 6, (F.col("c_custkey") * 7 + F.col("c_nationkey")) % 6
    scale = qc.SCALES["evidence_level"]
    return table(spark, sf, "customer").select("c_custkey", a.alias("left_rank"), b.alias("right_rank"), qc.more_conservative(F.lit("evidence_level"), pick(scale, a), pick(scale, b)).alias("merged"))


@query("select distinct unnest(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus])) as note from orders")
def distinct_notes(spark, sf):
    """SET3, SET7: ordered distinct notes."""
    return table(spark, sf, "orders").select(F.explode(keys.unique_notes(F.array("o_orderstatus"), F.array("o_orderpriority", "o_orderstatus"))).alias("note")).distinct()


# Quality control


def _qc_cases(spark, sf) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    sources = ("dailymed", "clinicaltrials", "reactome", "sider", "other")
    full = F.lit("x")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k).alias("benchmark_id"), F.lit("human_effect").alias("track"), pick(sources, k).alias("source_database"), F.when(k % 31 != 0, full).alias("source_id"), full.alias("source_url"), full.alias("source_version"), full.alias("retrieval_date"), full.alias("license_or_usage_note"), F.lit("bundled").alias("release_mode"),
        F.when(k % 29 == 0, "external_qc").otherwise("source_checked").alias("qc_status"), F.struct(full.alias("panel_id")).alias("leakage_group"), F.lit("test").alias("split"), F.when(k % 37 != 0, full).alias("processed_record_hash"), full.alias("citation"), F.lit("label text").alias("source_evidence_type"),
        pick(qc.SCALES["evidence_level"], k + n).alias("evidence_level"), pick(("positive", "mixed"), k).alias("evidence_direction"), pick(("supported", "unsupported"), n).alias("claim_status"), pick(("known_acceptable_under_approved_use", "known_risk"), k + n).alias("safety_status"), F.lit("neuro_cns").alias("category"), (k % 3 == 0).alias("trial_has_results"),
    )


@query(f"""with c as (select c_custkey as k, c_nationkey as n, {sql_pick(("dailymed", "clinicaltrials", "reactome", "sider", "other"), "k")} as s, (k + n) % 6 as e, k % 2 = 0 as pos, n % 2 = 0 as sup, (k + n) % 2 = 0 as safe, k % 3 = 0 as res from customer),
r as (select *, case when k % 31 = 0 then 3 when (e = 0 and s <> 'dailymed') or (s = 'clinicaltrials' and not res and pos) or (s = 'sider' and sup) or (safe and e <> 0) then 2 when k % 29 = 0 or k % 37 = 0 then 1 else 0 end as a,
 case when k % 31 = 0 then 3 when (e = 0 and s <> 'dailymed') or (s = 'reactome' and e <> 0 and e <> 4) or (s = 'clinicaltrials' and not res and pos) then 2 when k % 29 = 0 then 1 else 0 end as b from c)
select case greatest(a, b) when 3 then 'excluded' when 2 then 'downgraded' else 'kept' end as action, (['pass', 'warn', 'downgrade', 'exclude'])[a + 1] as pass_a, (['pass', 'warn', 'downgrade', 'exclude'])[b + 1] as pass_b, count(*) as n from r group by 1, 2, 3""")
def quality_control(spark, sf):
    """CHK4-18, JN14, JN15: two rule passes, merged and resolved."""
    checked = qc.check_records(_qc_cases(spark, sf))
    return checked.groupBy(F.col("qc.action").alias("action"), F.col("qc.pass_a.result").alias("pass_a"), F.col("qc.pass_b.result").alias("pass_b")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with c as (select c_custkey as k, c_nationkey as n, {sql_pick(("dailymed", "clinicaltrials", "reactome", "sider", "other"), "k")} as s, (k + n) % 6 as e, k % 2 = 0 as pos, n % 2 = 0 as sup, k % 3 = 0 as res from customer)
select m as message, count(*) as n from (select unnest([case when k % 31 = 0 then 'missing provenance' end, case when e = 0 and s <> 'dailymed' then 'approved indication needs a label source' end, case when not res and pos then 'trial without results is no positive evidence' end, case when sup and e = 4 then 'pathway evidence alone supports no claim' end]) as m from c) where m is not null group by 1""")
def audit_findings(spark, sf):
    """CHK2: audit rules as violation rows."""
    return release.audit(_qc_cases(spark, sf)).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


# Operators without a SQL form


@query("""with t as (select conv_id, turn, trim(coalesce(text, ''), ' \t\n\r') as s from conversations), f as (select *, regexp_extract_all(s, '(?i)(?:[a-z]+-)?(?:struct|pose)-[0-9]{3,}') as a, regexp_extract_all(s, '[A-Za-z]+-[0-9]+[A-Za-z0-9_:-]*|[A-Z]{3,}[A-Z0-9_:-]*') as b from t),
g as (select *, case when len(a) >= 12 and len(list_distinct(a)) / len(a) <= 0.6 then 'repeated_struct_pose_identifier_loop' when len(b) >= 40 and len(list_distinct(b)) / len(b) <= 0.35 then 'mostly_repeated_tokens' when length(s) >= 12 and length(s) - length(replace(s, left(s, 12), '')) >= 48 then 'repeated_substring_loop' end as loop from f)
select conv_id, turn, case when s = '' then 'empty_output' when contains(s, '{') then null else coalesce(loop, 'no_json_object_marker') end as reason from g where not contains(s, '{')""")
def degenerate_outputs(spark, sf):
    """STR14, STR15: why a text can't be an answer."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.degenerate_reason("text").alias("reason"))


@query("select event_id, props as payload, case when event_id % 2 = 0 then 'tagged_json:full_json' when event_id % 3 = 0 then 'raw:first_balanced_object' else 'tagged_json:first_balanced_object' end as method from events")
def json_extraction(spark, sf):
    """JSN2, JSN3, JSN4, JSN5: objects out of free text."""
    e = F.col("event_id")
    noisy = F.when(e % 2 == 0, F.concat(F.lit("final <json>"), F.col("props"), F.lit("</json> trailing"))).when(e % 3 == 0, F.concat(F.lit("so { : "), F.col("props"), F.lit(" is it"))).otherwise(F.concat(F.lit("final <json>"), F.col("props"), F.lit(",}")))
    return table(spark, sf, "events").select("event_id", extraction("k")(noisy).alias("x")).select("event_id", "x.*")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, sf):
    """Tumbling windows, as the streaming form counts them (an extension)."""
    from lectern.streaming.logs import event_counts

    return event_counts(table(spark, sf, "events"), "ts", "1 hour", "1 day", "event_type").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All panel metrics of every order."""
    return ranking.panel_metrics(_items(spark, sf_dir), ["panel"])


