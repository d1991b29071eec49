"""Queries of files, records, checks and releases, an operator or a few each, with the same in DuckDB SQL.

Those that write do so below the shared folder and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import hashes, variants
from lectern.functions.json import record_key
from lectern.operators import effects, evidence, keys, ordering, predictions, projections, qc, release, reports, splits, structure
from lectern.plans import builds
from lectern.queries import pick, query, spread, table
from lectern.runtime import scratch
from lectern.schemas import TRACKS, validate, validation_report, without_nulls
from lectern.sinks import files as sinks
from lectern.sinks import snapshots
from lectern.sources import adapters, files, paged

big = lambda c: c.cast("bigint")
text = lambda c: F.col(c).cast("string")

# Files


@query("select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus, o_orderpriority, o_totalprice from orders")
def jsonl_round_trip(spark, sf):
    """SRC1, SRC2, SNK1, SNK2: JSON lines written (nulls left out) and read by a stated schema."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_orderpriority", "o_totalprice")
    where = scratch(spark, "jsonl")
    sinks.write_jsonl(rows, where)
    return files.read_jsonl(spark, where, rows.schema)


@query("""select c_custkey::varchar as benchmark_id, 'human_effect' as track, case when c_custkey % 4 = 0 then 'source_reference_only' else 'bundled' end as release_mode, 'unknown' as source_version, '2024-01-01' as retrieval_date,
case c_custkey % 4 when 0 then true when 1 then true when 2 then false end as trial_has_results, case when c_custkey % 5 > 0 then c_nationkey end::bigint as source_result_count, c_mktsegment as sequence from customer""")
def csv_cases(spark, sf):
    """SRC4, PRJ6, PRJ7: curated CSV rows with defaults for empty cells, booleans and numbers parsed."""
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, "").otherwise("bundled")
    rows = table(spark, sf, "customer").select(k.cast("string").alias("benchmark_id"), mode.alias("release_mode"), pick(("true", "Yes", "no", ""), k).alias("trial_has_results"), F.when(k % 5 > 0, text("c_nationkey")).otherwise("none").alias("source_result_count"), F.col("c_mktsegment").alias("sequence"))
    where = scratch(spark, "csv")
    rows.write.option("header", True).option("emptyValue", "").csv(where)
    out = projections.prepare(files.read_csv(spark, where), "human_effect", "2024-01-01")
    return out.select("benchmark_id", "track", "release_mode", "source_version", "retrieval_date", "trial_has_results", big(F.col("source_result_count")).alias("source_result_count"), F.col("peptide.sequence").alias("sequence"))


def _case_release(spark, sf) -> str:
    """A release with structure and pose cases, predictions beside them, and no other track."""
    root = scratch(spark, "release")
    k = F.col("c_custkey")
    contact = F.array(F.struct(F.lit("A:1").alias("target_residue"), F.lit("B:2").alias("peptide_residue"), F.lit(3.0).alias("distance_angstrom")))
    pose = table(spark, sf, "customer").select(k.cast("string").alias("benchmark_id"), F.lit("pose").alias("track"), F.when(k % 3 == 0, "computed_contacts").otherwise("coordinate_reference_only").alias("contact_label_status"), F.when(k % 6 == 0, contact).otherwise(F.slice(contact, 1, 0)).alias("native_contacts"))
    sinks.write_jsonl(pose, f"{root}/pose/cases.jsonl")
    sinks.write_jsonl(table(spark, sf, "supplier").select(text("s_suppkey").alias("benchmark_id"), F.lit("structure").alias("track")), f"{root}/structure/cases.jsonl")
    sinks.write_jsonl(table(spark, sf, "nation").select(text("n_nationkey").alias("benchmark_id")), f"{root}/predictions/x.jsonl")
    return root


@query("""select 'pose' as what, count(*) as n from customer union all select 'structure', count(*) from supplier union all select 'binding_rank', 0 union all select 'human_effect', 0 union all select 'scored poses', count(*) from customer where c_custkey % 6 = 0 union all select 'all cases', (select count(*) from customer) + (select count(*) from supplier)""")
def release_scans(spark, sf):
    """SRC12, SRC13, SRC14, SET1, AGG37, AGG59: cases of each track of a release (none where a file is missing), the filter of poses at the scan, the union of tracks."""
    root = _case_release(spark, sf)
    cases = {t: files.read_cases(spark, root, t) for t in TRACKS}
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return keys.union_all(*[count(df, t) for t, df in cases.items()], count(files.cases_for_track(spark, root, "pose"), "scored poses"), count(keys.union_all(*[df.select("benchmark_id", "track", "split") for df in cases.values()]), "all cases"))


@query("""with a as (select s_suppkey % 10000 as r, s_suppkey * 37 % 60 as x, s_suppkey * 91 % 60 as y, s_suppkey % 50 as z from supplier), b as (select c_custkey % 10000 as r, c_custkey * 37 % 60 as x, c_custkey * 91 % 60 as y, c_custkey % 50 as z from customer)
select 'A:' || a.r as residue, 'B:' || b.r as other_residue, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 3) as distance from a, b where abs(a.x-b.x) <= 5 and abs(a.y-b.y) <= 5 and abs(a.z-b.z) <= 5 and (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 25 group by 1, 2""")
def pdb_contacts(spark, sf):
    """SRC15, JN8, JN9: fixed-width atom lines, and the residues of two chains at most 5 apart with their least distance."""

    def line(name: str, key: str, chain: str) -> DataFrame:
        k = F.col(key)
        return table(spark, sf, name).select(F.format_string("ATOM  %5d  CA  ALA " + chain + "%4d    %8.3f%8.3f%8.3f  1.00", big(k % 100000), big(k % 10000), (k * 37 % 60).cast("double"), (k * 91 % 60).cast("double"), (k % 50).cast("double")).alias("value"))

    where = scratch(spark, "pdb")
    line("supplier", "s_suppkey", "A").union(line("customer", "c_custkey", "B")).union(spark.createDataFrame([("HEADER no atom",), ("ATOM      1  CA  ALA A   1         bad     bad     bad",)], "value string")).write.text(where)
    atoms = files.read_pdb_atoms(spark, where)
    side = lambda c: atoms.where(F.col("chain") == c).select("residue", "x", "y", "z")
    return structure.contacts(side("A"), side("B"))


@query("""with c as (select l_suppkey as k, 'A:' || lpad(l_partkey::varchar, 6, '0') as t, 'B:' || lpad(l_orderkey::varchar, 8, '0') as p, l_discount as d from lineitem)
select k, least(count(distinct (t, p, d)), 200)::bigint as n, min(t) as first_residue from c group by 1""")
def contact_lists(spark, sf):
    """SRT8, AGG18, SET6: contacts of each case as one array, the first 200, and its sites."""
    pair = lambda a, n, p: F.concat(F.lit(p), F.lpad(text(a), n, "0"))
    found = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), pair("l_partkey", 6, "A:").alias("residue"), pair("l_orderkey", 8, "B:").alias("other_residue"), F.col("l_discount").alias("distance")).distinct()
    lists = structure.contact_list(found, ("k",))
    return lists.select("k", big(F.size("native_contacts")).alias("n"), F.get(structure.sites(F.array().cast("array<string>"), F.col("native_contacts")), F.lit(0)).alias("first_residue"))


@query("select 'lines' as what, o_orderpriority || ' ' || o_orderkey as record, 'derived' as release_mode from orders union all select 'list', '{\"n\":' || n_nationkey || '}', 'source_reference_only' from nation")
def export_rows(spark, sf):
    """SRC36, SRC3, SNK4: exports as text lines or as a JSON list, a row a record."""
    lines, listed = scratch(spark, "export"), scratch(spark, "export") + ".json"
    table(spark, sf, "orders").select(F.concat_ws(" ", "o_orderpriority", text("o_orderkey")).alias("value")).write.text(lines)
    table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("n")))).alias("value")).write.text(listed)
    rows = [files.read_export(spark, lines, "orders", "derived").withColumn("what", F.lit("lines")), files.read_export(spark, listed, "nations").withColumn("what", F.lit("list"))]
    return rows[0].union(rows[1]).select("what", "record", "release_mode")


@query("select n_name as id, n_nationkey::bigint as created, n_regionkey::bigint as context from nation")
def model_lists(spark, sf):
    """SRC33, SRC32, NUM8, NUM9, JSN6: models of a list file, their numbers parsed."""
    where = scratch(spark, "models")
    one = F.struct(F.col("n_name").alias("id"), text("n_nationkey").alias("created"), F.col("n_regionkey").alias("context_length"))
    table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(one).alias("models"))).alias("value")).write.text(where)
    get = lambda path, kind: F.try_variant_get("model", path, kind)
    return files.model_list(spark, where).select(get("$.id", "string").alias("id"), get("$.created", "string").try_cast("bigint").alias("created"), get("$.context_length", "bigint").alias("context"))


@query("select case when (rn - 1) % 10 < 7 then 'train' when (rn - 1) % 10 < 9 then 'dev' else 'test' end as split, count(*) as n from (select row_number() over (order by c_custkey) as rn from customer) group by 1")
def written_splits(spark, sf):
    """SNK5, WIN5: a folder a split, read back."""
    where = scratch(spark, "splits")
    at = ordering.positions(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])
    sinks.write_splits(at.select("c_custkey", splits.split_by_position(F.col("position")).alias("split")), where)
    return spark.read.schema("c_custkey bigint, split string").json(where).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case when c_custkey % 7 = 0 or c_custkey >= 1000000 then 'new' else c_mktsegment end as v, copies.n::bigint as copies from (select c_custkey, c_mktsegment from customer union all select c_custkey + 1000000, '' from customer where c_custkey % 50 = 0) t, (values (2)) copies(n)")
def upserted_records(spark, sf):
    """SNK12, SNK14, PRJ58: records replaced by key and appended, mirrored to two folders."""
    base, out, a, b = (scratch(spark, "upsert") for _ in range(4))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    sinks.write_jsonl(rows, base)
    new = rows.where("c_custkey % 7 = 0").union(rows.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)).withColumn("v", F.lit("new"))
    sinks.replace_record(new, base, "c_custkey", out)
    sinks.mirror(files.read_jsonl(spark, out, rows.schema), [a, b])
    return files.read_jsonl(spark, [a, b], rows.schema).groupBy("c_custkey", "v").agg(F.count(F.lit(1)).alias("copies"))


@query("""select n_name as name, (['A', 'B', 'C', 'Z'])[n_nationkey % 4 + 1] = 'Z' as bad_bucket, n_nationkey % 5 = 0 as bad_url, case when n_nationkey % 4 in (1, 2) and n_nationkey % 3 > 0 then 'bucket ' || (['A', 'B', 'C', 'Z'])[n_nationkey % 4 + 1] || ': raw data may not be redistributed' end as policy, false as fetches from nation
union all select 'RCSB', false, false, null, true""")
def manifest_checks(spark, sf):
    """SRC5, SRC6, SRC7, SRC38, PRJ42: a manifest read, checked row by row, and looked up."""
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select("n_name", pick(("A", "B", "C", "Z"), k).alias("bucket"), F.when(k % 5 == 0, "nowhere").otherwise("https://x.org/a").alias("url"), F.when(k % 3 == 0, "allowed").otherwise("restricted").alias("raw"))
    rows = rows.union(spark.createDataFrame([("RCSB", "A", "https://x.org", "allowed")], rows.schema))
    where = scratch(spark, "manifest")
    entry = F.concat(F.lit("  - {name: "), "n_name", F.lit(", bucket: "), "bucket", F.lit(", url: '"), "url", F.lit("', raw_redistribution: "), "raw", F.lit("}"))
    rows.agg(F.concat(F.lit("sources:\n"), F.array_join(F.collect_list(entry), "\n")).alias("value")).write.text(where)
    manifest = files.read_manifest(spark, where)
    names = files.source_by_name(manifest, "rcsb").select("name")  # fails if it isn't there
    errors = files.manifest_errors(manifest)
    return manifest.join(adapters.registry(manifest).drop("url"), "name").join(names.withColumn("found", F.lit(True)), "name", "left").select("name", F.array_contains(errors, "bucket: not in domain").alias("bad_bucket"), F.array_contains(errors, "url: not an HTTP url").alias("bad_url"), release.bucket_policy(F.col("bucket"), F.col("raw_redistribution")).alias("policy"), "fetches")


@query("select name, case when name like '%/0' then null else 'x' || n_nationkey end as text, name like '%/0' as failed from (select 'http://h/' || n_nationkey % 5 as name, n_nationkey from nation where n_nationkey < 5) t")
def fetched_texts(spark, sf):
    """SRC16, SRC17, SRC26, SRC28: urls fetched where the rows are, from a cache where it has them; a failure is a row."""

    def fetch(url: str, body: bytes | None, timeout: int) -> str:
        if url.endswith("/0"):
            raise OSError("down")
        return "x" + url[-1]

    urls = table(spark, sf, "nation").select(F.concat(F.lit("http://h/"), big(F.col("n_nationkey") % 5).cast("string")).alias("url"))
    store = scratch(spark, "cache")
    adapters.save_texts(adapters.fetch_column(urls.where("url like '%/1'").distinct(), "url", fetch), store)
    out = adapters.cached(urls, spark.read.parquet(store), fetch)
    return out.select(F.col("url").alias("name"), "text", F.col("text").isNull().alias("failed"))


@query("select p_partkey::varchar as pdb_id, 'E' || e as entity_id, (length(p_name) + e)::bigint as length, case when e = 1 then 'P' else 'Q' end as chain from part, (values (1), (2)) v(e)")
def service_entries(spark, sf):
    """SRC18, SRC19, SRC30, SRC31, ARR1, ARR2: entities of batched answers, first chain by author or else assigned, length stated or of the sequence."""
    e = lambda i: F.struct(F.concat(text("p_partkey"), F.lit(f"_E{i}")).alias("rcsb_id"), F.struct(F.lit("polypeptide(L)").alias("type"), F.lit("").alias("pdbx_seq_one_letter_code_can"), (F.length("p_name") + i).alias("rcsb_sample_sequence_length")).alias("entity_poly"), F.struct(F.array(F.lit("P")).alias("auth_asym_ids") if i == 1 else F.array().cast("array<string>").alias("auth_asym_ids"), F.array(F.lit("Q")).alias("asym_ids")).alias("rcsb_polymer_entity_container_identifiers"))
    entry = F.struct(text("p_partkey").alias("rcsb_id"), F.array(e(1), e(2)).alias("polymer_entities"))
    answers = table(spark, sf, "part").groupBy((F.col("p_partkey") % 100).alias("batch")).agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entries")).alias("data"))).alias("text"))
    chain = F.coalesce(F.try_element_at("chains", F.lit(1)), F.try_element_at("asym_chains", F.lit(1)))
    return adapters.entities(answers).select("pdb_id", "entity_id", big(F.col("length")).alias("length"), chain.alias("chain"))


# Records


@query("""with p as (select c_custkey as k from customer), e as (select k, unnest([case when k % 11 = 0 then 'model_name: required' end, case when k % 7 = 0 then 'track: another track' end, case when k % 13 > 10 then 'confidence: outside 0..1' end]) as error from p)
select k::varchar as benchmark_id, error from e where error is not null""")
def prediction_errors(spark, sf):
    """PRJ2, PRJ4, PRJ5: violated constraints of predictions, a row each."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("p"), k).alias("prediction_id"), k.cast("string").alias("benchmark_id"), F.when(k % 7 == 0, "pose").otherwise("structure").alias("track"), F.when(k % 11 != 0, "m").alias("model_name"), (k % 13 / 10.0).cast("double").alias("confidence"))
    return validation_report(validate(rows, "structure"))


_BASE = ("benchmark_id", "track", "release_mode", "source_database", "source_id", "source_url", "retrieval_date", "license_or_usage_note", "qc_status", "split")


def _poses(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    own = {"benchmark_id": k.cast("string"), "track": F.lit("pose"), "release_mode": pick(("bundled", "source_reference_only", "lost"), k), "source_database": F.concat(F.lit("db"), text("c_nationkey")), "qc_status": F.lit("source_checked"), "split": F.lit("test"), "source_id": F.when(k % 17 == 0, "").otherwise(k.cast("string"))}
    contact = F.struct(F.when(k % 19 == 0, "A10").otherwise("A:10").alias("target_residue"), F.lit("B:1").alias("peptide_residue"), F.lit(1.0).alias("distance_angstrom"))
    return table(spark, sf, "customer").select(*[own.get(c, F.lit("x")).alias(c) for c in _BASE], F.struct(F.when(k % 23 == 0, "A C").otherwise("AC").alias("sequence")).alias("peptide"), F.when(k % 29 == 0, F.repeat(F.lit("w "), F.lit(36))).otherwise("w").alias("evidence_quote_or_label"), F.array(contact).alias("native_contacts"), F.lit("coordinate_reference_only").alias("contact_label_status"))


@query("""select c_custkey::varchar as benchmark_id, error from (select c_custkey, unnest([case when c_custkey % 17 = 0 then 'source_id: required' end, case when c_custkey % 3 = 2 then 'release_mode: not in domain' end, case when c_custkey % 29 = 0 then 'evidence_quote_or_label: too many words' end, case when c_custkey % 23 = 0 then 'peptide.sequence: empty or with white space' end, case when c_custkey % 19 = 0 then 'native_contacts: residue without chain or negative distance' end]) as error from customer) where error is not null""")
def case_errors(spark, sf):
    """PRJ1, CHK35, CHK36, CHK37: violated constraints of cases: required fields, domains, sequences, residue labels, quotes."""
    return validation_report(validate(_poses(spark, sf), "pose"))


@query("""with r as (select c_custkey, '{' || case when c_custkey % 3 > 0 then '"a":"' || c_mktsegment || '",' else '' end || '"b":' || c_custkey || '}' as j from customer) select c_custkey, j as record, sha256(j) as sha256 from r""")
def canonical_records(spark, sf):
    """PRJ3, JSN7, HSH3, HSH4: a record as JSON without nulls or its own id, fields by name, and its digest."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.concat(F.lit("id"), k).alias("prediction_id"), k.alias("b"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("a"))
    return rows.select("c_custkey", record_key("prediction_id", "b", "a").alias("record"), hashes.record_hash(["b", "a", "prediction_id"], ("prediction_id",)).alias("sha256")).join(rows.select("c_custkey", without_nulls(rows.select("a", "b")).alias("again")), "c_custkey").where("record = again").drop("again")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'kept' else sha256('db' || c_nationkey || ':' || c_name || ':' || case when c_custkey % 5 = 0 then '' else 'u' end) end as source_record_hash, true as renewed from customer")
def reproducible_hashes(spark, sf):
    """HSH5: a missing source hash is filled, the record's own is always renewed."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.concat(F.lit("db"), text("c_nationkey")).alias("source_database"), F.col("c_name").alias("source_id"), F.when(k % 5 > 0, "u").alias("source_url"), F.when(k % 4 == 0, "kept").when(k % 4 == 1, "").alias("source_record_hash"), F.lit("old").alias("processed_record_hash"))
    return hashes.with_hashes(rows).select("c_custkey", "source_record_hash", (F.length("processed_record_hash") == 64).alias("renewed"))


@query("select sum(length)::bigint as bytes, count(distinct sha256) as digests from (select length(n_name) + 1 as length, sha256(n_name) as sha256 from nation)")
def file_digests(spark, sf):
    """HSH2: length and SHA-256 of files."""
    where = scratch(spark, "digests")
    table(spark, sf, "nation").select("n_name", F.col("n_name").alias("value")).write.partitionBy("n_name").text(where)
    found = hashes.file_hashes(spark, where).where("path like '%.txt'")
    return found.agg(big(F.sum("length")).alias("bytes"), F.countDistinct("sha256").alias("digests"))


# Checks of a release


def _release(spark, sf) -> DataFrame:
    """Cases of all tracks from the customers."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    full = F.lit("x")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k).alias("benchmark_id"), pick(TRACKS, k).alias("track"), F.concat(F.lit("db"), n.cast("string")).alias("source_database"), F.concat(F.lit("s"), k).alias("source_id"), full.alias("source_url"), full.alias("source_version"), full.alias("retrieval_date"), full.alias("license_or_usage_note"),
        F.when(k % 6 == 0, "excluded").when(k % 2 == 0, "source_reference_only").otherwise("bundled").alias("release_mode"), F.lit("source_checked").alias("qc_status"), F.lit("test").alias("split"), F.when(k % 4 > 0, F.concat(F.lit("cite "), n.cast("string"))).alias("citation"), F.struct(F.when(k % 7 == 0, "restricted").otherwise("allowed").alias("raw_data_redistribution")).alias("redistribution_policy_snapshot"),
        F.when(k % 4 == 1, "coordinate_reference_only").alias("contact_label_status"), F.lit("primary").alias("scoring_subset"), F.lit("A").alias("target_chain_id"), F.when(k % 9 > 0, "B").alias("peptide_chain_id"), F.lit("rank").alias("normalization_method"), F.lit("lower_is_stronger").alias("measurement_direction"),
        F.array().cast("array<struct<target_residue:string,peptide_residue:string,distance_angstrom:double>>").alias("native_contacts"), k.alias("ord"),
    )


_RELEASE = """r as (select c_custkey as k, 'c' || c_custkey as benchmark_id, (['structure', 'pose', 'binding_rank', 'human_effect'])[c_custkey % 4 + 1] as track, 'db' || c_nationkey as source_database, c_nationkey as n, case when c_custkey % 6 = 0 then 'excluded' when c_custkey % 2 = 0 then 'source_reference_only' else 'bundled' end as release_mode from customer)"""


@query(f"""with {_RELEASE}, c as (select source_database, track, count(*) as cases, max(n) as n from r group by 1, 2), m as (select source_database, track, min_by(release_mode, (-n, seen)) as release_mode from (select source_database, track, release_mode, count(*) as n, min(k) as seen from r group by 1, 2, 3) group by 1, 2),
e as (select 'db' || s_nationkey as source_database, (['structure', 'pose', 'binding_rank', 'human_effect'])[s_suppkey % 4 + 1] as track, count(*) as excluded from supplier group by 1, 2), names as (select 'db' || n_nationkey as source_database, true as known from nation union select distinct source_database, null from r where source_database not in (select 'db' || n_nationkey from nation))
select source_database, track, coalesce(cases, 0) as cases, coalesce(excluded, 0) as excluded, release_mode, case when known then 'stub' end as adapter_status from names cross join (values ('structure'), ('pose'), ('binding_rank'), ('human_effect')) t(track) left join c using (source_database, track) left join m using (source_database, track) left join e using (source_database, track)""")
def status_grid(spark, sf):
    """JN16, JN17, AGG39, AGG40, PRJ31: every source with every track: cases, exclusions and the most frequent mode, the first seen on ties."""
    manifest = table(spark, sf, "nation").select(F.concat(F.lit("db"), text("n_nationkey")).alias("name"), F.lit("stub").alias("adapter_status"))
    gone = table(spark, sf, "supplier").select(F.concat(F.lit("db"), text("s_nationkey")).alias("source_database"), pick(TRACKS, F.col("s_suppkey")).alias("track"))
    return release.status_grid(manifest, _release(spark, sf), gone).select("source_database", "track", "cases", "excluded", "release_mode", "adapter_status")


@query(f"with {_RELEASE} select source_database, count(*) filter (track = 'structure') as structure, count(*) filter (track = 'pose') as pose, count(*) filter (track = 'binding_rank') as binding_rank, count(*) filter (track = 'human_effect') as human_effect from r group by 1")
def counts_by_source(spark, sf):
    """AGG34: cases of each source, a column a track."""
    return release.counts_by_source(_release(spark, sf)).select("source_database", *TRACKS)


@query(f"""with {_RELEASE} select 'track' as kind, track as key, count(*) as n from r group by 2 union all select 'release_mode', release_mode, count(*) from r group by 2 union all select 'scoring_subset', 'primary', count(*) from r
union all select 'action', case when k % 6 = 0 then 'excluded' else 'kept' end, count(*) from r group by 2 union all select 'qc_resolution', case when k % 5 = 0 then 'downgraded' end, count(*) from r group by 2""")
def release_metadata(spark, sf):
    """AGG36, AGG38, PRJ28: counts of a release and of its cards."""
    cases = _release(spark, sf)
    cards = cases.select("benchmark_id", F.when(F.col("ord") % 6 == 0, "excluded").otherwise("kept").alias("action"), F.when(F.col("ord") % 5 == 0, "downgraded").alias("qc_resolution"))
    return release.metadata(cases, cards)


@query(f"""with {_RELEASE} select 'source_ids' as list, benchmark_id, 's' || k as value from r union all select 'citations', benchmark_id, 'cite ' || n from r where k % 4 > 0 union all select 'nonredistributable', benchmark_id, release_mode from r where release_mode = 'source_reference_only' or k % 7 = 0""")
def reference_lists(spark, sf):
    """PRJ23, PRJ24, PRJ25, PRJ30: source ids, citations, and the index of what may not be redistributed."""
    lists = release.references(_release(spark, sf))
    value = {"source_ids": "source_id", "citations": "citation", "nonredistributable": "release_mode"}
    return keys.union_all(*[df.select(F.lit(n).alias("list"), "benchmark_id", F.col(value[n]).alias("value")) for n, df in lists.items()])


@query(f"with {_RELEASE} select benchmark_id from r where release_mode = 'source_reference_only' and k % 10 = 4")
def unreferenced_cases(spark, sf):
    """JN10: source-reference cases that the index lacks."""
    cases = _release(spark, sf)
    return release.unreferenced(cases, release.references(cases)["nonredistributable"].where("cast(substr(benchmark_id, 2) as bigint) % 10 <> 4")).select("benchmark_id")


@query(f"""with {_RELEASE}, need as (select * from (values ('structure', 200), ('pose', 100), ('binding_rank', 25), ('human_effect', 200)) v(track, least)), c as (select track, count(*) as n from r group by 1)
select track as scope, coalesce(n, 0) || ' cases, ' || least || ' needed' as message from need left join c using (track) where coalesce(n, 0) < least union all select 'pose', '0 contact maps, 25 needed' union all select benchmark_id, 'pose without chains' from r where track = 'pose' and k % 9 = 0
union all select unnest(['quality_check_summary.json', 'references/citations.jsonl']), 'file missing' union all select 'notes.md', 'file not allowed'""")
def release_violations(spark, sf):
    """CHK1, CHK3, CHK33, PRJ32: too few cases or contact maps, audit errors, files that are missing or not allowed."""
    lacking = ("quality_check_summary.json", "references/citations.jsonl")
    there = [f for f in release.REQUIRED_FILES if f not in lacking] + ["notes.md"]
    return release.release_check(_release(spark, sf), files=spark.createDataFrame([(f"file:/r/{f}",) for f in there], "path string")).select("scope", "message")


@query(f"""with {_RELEASE}, need as (select * from (values ('structure', 1), ('pose', 1), ('binding_rank', 1), ('human_effect', 1)) v(track, least)), c as (select track, count(*) as n from r group by 1)
select track as scope, coalesce(n, 0) || ' cases, ' || least || ' needed' as message from need left join c using (track) where coalesce(n, 0) < least union all select 'pose', '0 contact maps, 25 needed' union all select benchmark_id, 'pose without chains' from r where track = 'pose' and k % 9 = 0
union all select benchmark_id, 'not in the reference index' from r where release_mode = 'source_reference_only' and k % 10 = 4 union all select benchmark_id, 'disagreement not resolved' from r where k % 8 = 0 and k % 16 > 0 and k % 6 > 0 union all select 'card', 'clinically validated'""")
def publish_violations(spark, sf):
    """CHK19, STR16: what keeps a release from being published."""
    cases = _release(spark, sf)
    index = release.references(cases)["nonredistributable"].where("cast(substr(benchmark_id, 2) as bigint) % 10 <> 4")
    cards = cases.select("benchmark_id", F.when(F.col("ord") % 8 == 0, F.array(F.lit("result"))).otherwise(F.array().cast("array<string>")).alias("disagreements"), F.when(F.col("ord") % 16 == 0, "downgraded").alias("qc_resolution"), F.when(F.col("ord") % 6 == 0, "excluded").otherwise("kept").alias("action"))
    words = spark.createDataFrame([("card", "It is Clinically Validated."), ("note", "not externally checked")], "name string, text string")
    return release.publish_check(cases, index, cards, words, dict.fromkeys(TRACKS, 1))


@query(f"""with {_RELEASE} select benchmark_id, (1 + (release_mode = 'source_reference_only')::int + (track = 'pose')::int + (track = 'human_effect')::int)::bigint as caveats, case when k % 3 = 0 then 'License terms limit what is redistributed.' when k % 2 = 0 then 'No case of the current release comes from this source.' else 'plain' end as note from r""")
def caveats_and_notes(spark, sf):
    """PRJ27, PRJ29: caveats of a case, and the public wording of notes."""
    cases = _release(spark, sf)
    note = F.when(F.col("ord") % 3 == 0, "License unclear").otherwise("plain")
    return cases.select("benchmark_id", big(F.size(release.caveats(cases))).alias("caveats"), release.governance_note(note, F.col("ord") % 2 == 1).alias("note"))


@query("""select c_custkey, case c_custkey % 4 when 3 then '{"category":"' || c_mktsegment || '","claim_status":"supported"}' when 2 then '{"panel_id":"p' || c_nationkey || '","measurement_direction":"unknown","items":1}' when 1 then '{"pose_subset":"s","contacts":0}' else '{"structure_id":"x","resolution_angstrom":1.5}' end as label from customer""")
def final_labels(spark, sf):
    """PRJ26: the label that a case ends with, by track."""
    k = F.col("c_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    own = {"category": F.col("c_mktsegment"), "claim_status": F.lit("supported"), "panel_id": F.concat(F.lit("p"), text("c_nationkey")), "measurement_direction": F.lit("unknown"), "items": F.array(F.lit(1)), "pose_subset": F.lit("s"), "native_contacts": F.array().cast("array<string>"), "structure_id": F.lit("x"), "resolution_angstrom": F.lit(1.5)}
    rows = table(spark, sf, "customer").select(k, pick(TRACKS, k).alias("track"), *[c.alias(n) for n, c in own.items()], *[none("string").alias(n) for n in ("evidence_level", "evidence_direction", "safety_status", "contact_label_status", "experimental_method")])
    return rows.select("c_custkey", release.final_label(F.col("track")).alias("label"))


@query("""with o as (select c_custkey as k, c_custkey % 6 = 0 as ex, c_custkey % 3 = 0 as dn, c_custkey % 2 = 0 as wn from customer)
select k, case when ex then 'exclude' when dn then 'downgrade' when wn then 'warn' else 'pass' end as result, (ex::int + dn::int + wn::int)::bigint as notes, case when ex then 'last' end as reason, case when dn then 'b' when wn then 'a' end as value from o""")
def rule_outcomes(spark, sf):
    """CHK4, CHK5, CHK28, CHK29, CHK30, CHK32: the outcome of rules: worst severity, notes, the last update and the last reason."""
    k = F.col("c_custkey")
    rules = [qc.Rule(k % 2 == 0, "warn", "w", {"v": "a"}), qc.Rule(k % 3 == 0, "downgrade", "d", {"v": "b"}), qc.exclude(k % 6 == 0, "last")]
    o = qc.outcome(rules)
    return table(spark, sf, "customer").select(k.alias("k"), o["result"].alias("result"), big(F.size(o["notes"])).alias("notes"), o["exclude_reason"].alias("reason"), F.try_element_at(o["updates"], F.lit("v")).alias("value"))


@query("""with r as (select c_custkey as k, c_custkey % 5 > 0 as a, c_custkey % 3 > 0 as b from customer) select 'c' || k as benchmark_id, case when a and b then null when not a and not b then null else 'downgraded' end as resolution, case when a <> b then 1 else 0 end::bigint as disagreements from r""")
def stored_outcomes(spark, sf):
    """CHK18, CHK31, JN14: stored outcomes of two passes resolved again, with defaults where a pass has none."""
    k = F.col("c_custkey")
    cases = table(spark, sf, "customer").select(F.concat(F.lit("c"), k).alias("benchmark_id"), k)
    one = lambda df: df.select("benchmark_id", F.lit("downgrade").alias("result"), F.array().cast("array<string>").alias("notes"), F.create_map(F.lit("claim_status"), F.lit("unsupported")).alias("updates"))
    out = qc.resolve_stored(cases, one(cases.where(k % 5 > 0)), one(cases.where(k % 3 > 0)))
    return out.select("benchmark_id", "resolution", big(F.size("disagreements")).alias("disagreements"))


# Model input


@query("""select track, benchmark_id, len(columns)::bigint as n, case when track = 'binding_rank' then 1 end::bigint as items from (select c_custkey::varchar as benchmark_id, unnest(['human_effect', 'binding_rank', 'pose', 'structure']) as track from customer) t
join (values ('human_effect', range(0, 18)), ('binding_rank', range(0, 18)), ('pose', range(0, 20)), ('structure', range(0, 18))) v(track, columns) using (track)""")
def sanitized_inputs(spark, sf):
    """PRJ12, PRJ13, PRJ14, PRJ15, PRJ16, PRJ17, PRJ18, PRJ19, PRJ20, EXT29: what a model may see of a case, by track, with provenance for tools; gold fields are gone at any depth."""
    from lectern.operators.leaderboard import MODES
    from lectern.schemas import case_schema

    parts = []
    for track in MODES[projections.TOOLS]:
        fields = [f.name for f in case_schema(track).fields]
        wide = table(spark, sf, "customer").select(F.from_json(F.concat(F.lit('{"benchmark_id":"'), "c_custkey", F.lit('","items":[{"item_id":"i","measured_value":1.0,"normalized_rank":0.5}]}')), case_schema(track)).alias("r")).select(*[F.col(f"r.{f}") for f in fields])
        seen = projections.sanitize(wide, track, projections.TOOLS)
        parts.append(seen.select(F.lit(track).alias("track"), "benchmark_id", F.lit(len(seen.columns)).cast("bigint").alias("n"), big(F.size("candidate_peptides") if track == "binding_rank" else F.lit(None)).alias("items")))
    return keys.union_all(*parts)


@query("""with r as (select c_custkey as k, '{"benchmark_id":"' || c_custkey || '","claim_text":"' || c_mktsegment || '"}' as j, (row_number() over (order by c_custkey::varchar) - 1) // 25 as chunk from customer)
select chunk::bigint as chunk, count(*) as n, (length('Track: human_effect. Cases: [') + sum(length(j)) + count(*) - 1 + 1)::bigint as chars, 'Do it.' as system from r group by 1""")
def chunked_prompts(spark, sf):
    """EXT11, EXT12, EXT13, SRT6: messages of chunks of 25 cases by id."""
    rows = table(spark, sf, "customer").select(text("c_custkey").alias("benchmark_id"), F.col("c_mktsegment").alias("claim_text"))
    out = projections.prompts(rows, "human_effect", "Do it.", 25)
    return out.select(big(F.col("chunk")).alias("chunk"), big(F.size("benchmark_ids")).alias("n"), big(F.length(F.col("messages")[1]["content"])).alias("chars"), F.col("messages")[0]["content"].alias("system"))


@query("select conv_id, count(*) filter (role = 'assistant') as n, 'Return only the JSON object for these ids: ' || conv_id || ', x. Previous answer: ' || left(any_value(text) filter (turn = 0), 4000) as repair from conversations where conv_id in (select conv_id from conversations where turn = 0) group by conv_id")
def repair_prompts(spark, sf):
    """EXT26, PRJ38: the prompt after an answer that couldn't be parsed, and rows that can train."""
    packed = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.col("text"))).alias("messages"), F.min_by("text", "turn").alias("first"), F.min("turn").alias("t"), F.count_if(F.col("role") == "assistant").alias("n")).where("t = 0")
    kept = projections.trainable(packed).select("conv_id", F.size("messages").alias("m"))
    return packed.join(kept, "conv_id", "left").select("conv_id", F.coalesce("m", F.lit(0)).cast("bigint").alias("n"), projections.repair_prompt(F.col("first"), F.array(text("conv_id"), F.lit("x"))).alias("repair"))


# Answers


@query("""select c_custkey::varchar as benchmark_id, case when c_custkey % 4 = 0 then 'failed' else 'completed' end as status, case when c_custkey % 4 = 1 then 'cardiovascular' else 'no_known_human_effect_evidence' end as category, case c_custkey % 4 when 1 then 'supported' else 'insufficient_information' end as claim_status, c_custkey % 4 = 2 as abstained from customer""")
def effect_predictions(spark, sf):
    """PRJ43, PRJ44, PRJ51, EXT18, EXT21: answers to predictions: words put into their domains, defaults for what is missing, failures kept."""
    k = F.col("c_custkey")
    answer = F.when(k % 4 == 0, "no answer").when(k % 4 == 1, 'so: {"category": "Cardiovascular", "claim_status": "SUPPORTED"}').when(k % 4 == 2, '<json>{"abstained": true, "claim_status": "certain"}</json>').otherwise('{"category": 5,}')
    parsed = predictions.parsed(spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(k.cast("string").alias("benchmark_id"), answer.alias("text")))
    return predictions.predictions(parsed, "human_effect", "m").select("benchmark_id", "status", "category", "claim_status", "abstained")


@query("""select c_custkey::varchar as benchmark_id, least(c_custkey % 60, 50)::bigint as contacts, case when c_custkey % 3 = 0 then 0.0 else (c_custkey % 3)::double end as clash from customer""")
def pose_predictions(spark, sf):
    """PRJ47, PRJ48, PRJ50: contacts cleaned and capped at 50, clashes not below 0."""
    k = F.col("c_custkey")
    good = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.struct(F.when(i < k % 60, "A:1").otherwise("A1").alias("target_residue"), F.lit("B:1").alias("peptide_residue"), F.lit(1.0).alias("distance_angstrom")))
    payload = F.to_json(F.struct(good.alias("contacts"), F.when(k % 3 == 0, -1.0).otherwise((k % 3).cast("double")).alias("clash_score")))
    rows = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(k.cast("string").alias("benchmark_id"), F.try_parse_json(payload).alias("payload"))
    return predictions.predictions(rows, "pose", "m").select("benchmark_id", big(F.size("predicted_contacts")).alias("contacts"), F.col("clash_score").alias("clash"))


@query("select c_custkey::varchar as benchmark_id, case when c_custkey % 3 = 0 then 0.01 when c_custkey % 3 = 1 then 1.0 else 0.5 end::double as confidence from customer")
def structure_predictions(spark, sf):
    """PRJ50, AGG55: confidence clamped, and no coordinates without confidence given the least."""
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(F.when(k % 3 == 1, 7.0).when(k % 3 == 2, 0.5).alias("confidence")))
    rows = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(k.cast("string").alias("benchmark_id"), F.try_parse_json(payload).alias("payload"))
    return predictions.predictions(rows, "structure", "m").select("benchmark_id", F.col("confidence").cast("double").alias("confidence"))


@query("select c_nationkey::varchar as benchmark_id, count(*) as n, round(sum(c_acctbal), 2) as total, min(c_custkey)::varchar as first_item from customer group by 1")
def regrouped_scores(spark, sf):
    """AGG52, JN20, AGG10: flat scores as one prediction a benchmark, set against the items in order."""
    flat = table(spark, sf, "customer").select(text("c_nationkey").alias("benchmark_id"), F.col("c_custkey").alias("ord"), text("c_custkey").alias("item_id"), F.col("c_acctbal").alias("score"))
    both = predictions.regrouped(flat).withColumn("z", predictions.zipped_scores(F.transform("scores", lambda s: s["score"]), F.col("scores")))
    return both.select("benchmark_id", big(F.size("z")).alias("n"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x["score"]), 2).alias("total"), F.col("z")[0]["item_id"].alias("first_item"))


@query("""select c.k::varchar as benchmark_id, case when e.k is null then 'missing prediction' else 'unknown benchmark_id' end as error from (select c_custkey as k from customer) c full join (select distinct user_id as k from events) e using (k) where c.k is null or e.k is null""".replace("c.k::varchar", "coalesce(c.k, e.k)::varchar").replace("case when e.k is null", "case when e.k is null"))
def match_errors(spark, sf):
    """JN21, SET5: answers to unknown cases and cases without an answer."""
    return predictions.matching_errors(table(spark, sf, "events").select(text("user_id").alias("benchmark_id")), table(spark, sf, "customer").select(text("c_custkey").alias("benchmark_id")))


@query("""select o_custkey::varchar as benchmark_id, min(c_custkey) as place, count(*) as n from orders join customer on c_custkey = o_custkey where o_custkey % 2 = 0 group by 1""")
def ordered_predictions(spark, sf):
    """JN12, AGG47: predictions of known cases in the cases' order."""
    cases = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(text("c_custkey").alias("benchmark_id"), F.col("c_custkey").alias("ord"))
    found = table(spark, sf, "orders").select(text("o_custkey").alias("benchmark_id"), F.lit(-1).alias("ord"))
    return keys.ordered_like(found, cases).groupBy("benchmark_id").agg(F.min("ord").alias("place"), F.count(F.lit(1)).alias("n"))


@query("""select c_custkey::varchar as benchmark_id, 'failed' as status, false as json_valid, true as counts_as_failed, 'own' as source from customer where c_custkey % 3 = 0 union all select c_custkey::varchar, 'completed', true, false, 'found' from customer where c_custkey % 3 > 0""")
def completed_predictions(spark, sf):
    """PRJ52, PRJ53, AGG43, GEN7: failed rows for the cases without an answer, counted as failures."""
    cases = table(spark, sf, "customer").select(text("c_custkey").alias("benchmark_id"), F.col("c_custkey").alias("k"))
    found = cases.where("k % 3 > 0").select("benchmark_id", F.lit("completed").alias("status"), F.lit(True).alias("json_valid"), F.lit("found").alias("source"))
    out = predictions.complete_with_fallback(found, cases, predictions.failed(cases, "m").withColumn("source", F.lit("own")))
    return out.select("benchmark_id", "status", "json_valid", evidence.failed(out).alias("counts_as_failed"), "source")


@query("select 'identifier' as kind, user_id::varchar as value from (select distinct user_id from events) where user_id in (select c_custkey from customer where c_custkey % 3 > 0) union all select 'hash', 'h' || c_nationkey from (select distinct c_nationkey from customer where c_custkey % 3 > 0 and c_nationkey < 5)")
def leaked_ids(spark, sf):
    """JN18, SET2, AGG46: identifiers and hashes that training and evaluation rows share, wherever the records have them; training rows of the benchmark don't count."""
    train = table(spark, sf, "events").select(F.struct(text("user_id").alias("case_id")).alias("meta"), F.concat(F.lit("h"), big(F.col("user_id") % 5).cast("string")).alias("record_hash"))
    bench = table(spark, sf, "customer").select(F.array(text("c_custkey")).alias("source_ids"), F.concat(F.lit("h"), text("c_nationkey")).alias("case_hash"), F.when(F.col("c_custkey") % 3 == 0, "train").otherwise("").alias("split"))
    return splits.leakage(train, bench)


@query("""with s as (select l_suppkey as k, list(distinct l_partkey) filter (l_returnflag = 'R') as g, list(distinct l_partkey) filter (l_returnflag = 'A') as p from lineitem group by 1), m as (select coalesce(len(list_intersect(g, p)) / nullif(len(p), 0), 0) as pr, len(list_intersect(g, p)) / len(g) as rc from s where len(g) > 0)
select round(avg(pr), 9) as precision, round(avg(rc), 9) as recall, round(avg(rc), 9) as site, count(*) as labelled, (select count(*) from s where coalesce(len(g), 0) = 0) as others from m""")
def contact_overlap(spark, sf):
    """AGG16, AGG17, JN3: contact precision and recall, site recovery, over the labelled cases."""
    contact = F.struct(F.concat(F.lit("A:"), text("l_partkey")).alias("target_residue"), F.lit("B:1").alias("peptide_residue"))
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("benchmark_id")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", contact)).alias("native_contacts"), F.collect_set(F.when(F.col("l_returnflag") == "A", contact)).alias("predicted_contacts"))
    empty = F.array().cast("array<string>").alias("binding_site_residues")
    m = structure.evaluate_pose(sets.select("benchmark_id", "native_contacts", empty, F.lit("").alias("orientation_label")), sets.select("benchmark_id", "predicted_contacts", empty, F.lit("").alias("orientation_label")))
    r = lambda c, n: F.round(c, 9).alias(n)
    return m.select(r("interface_contact_precision", "precision"), r("interface_contact_recall", "recall"), r("binding_site_recovery", "site"), F.col("contact_metric_denominator").alias("labelled"), F.col("pose_coordinate_reference_subset_count").alias("others"))


@query("""with a as (select vec_id // 2 as pair, vec_id % 2 as side, i, embedding[i*3+1]::double as x, embedding[i*3+2]::double as y, embedding[i*3+3]::double as z from embeddings, range(0, 21) t(i)),
r as (select g.pair, sqrt(sum((g.x-p.x)**2 + (g.y-p.y)**2 + (g.z-p.z)**2) / count(*)) as rmsd from a g join a p on g.pair = p.pair and g.i = p.i and g.side = 0 and p.side = 1 group by 1) select round(avg(rmsd), 6) as rmsd, count(*) as evaluated, 0::bigint as skipped from r""")
def structure_metrics(spark, sf):
    """AGG20, JN4, AGG55: mean deviation over the cases with shared atoms."""
    xyz = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.cast("string").alias("atom_id"), F.lit("r").alias("residue_id"), *[F.try_element_at("embedding", i * 3 + j + 1).cast("double").alias(c) for j, c in enumerate("xyz")]))
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("string").alias("benchmark_id"), (F.col("vec_id") % 2).alias("side"), xyz.alias("a"))
    m = structure.evaluate_structure(rows.where("side = 0").select("benchmark_id", F.col("a").alias("gold_coordinates")), rows.where("side = 1").select("benchmark_id", F.col("a").alias("coordinates")))
    return m.select(F.round("all_atom_rmsd", 6).alias("rmsd"), F.col("rmsd_evaluated_cases").alias("evaluated"), F.col("rmsd_skipped_count").alias("skipped"))


# Builders


@query("""select source_id, evidence_level, evidence_direction, trial_phase from (select 'S' || n_nationkey as source_id, 'approved_human_indication' as evidence_level, 'positive' as evidence_direction, null as trial_phase from nation
union all select 'N' || n_nationkey, 'human_clinical_evidence', case when n_nationkey % 2 = 0 then 'inconclusive' else 'not_reported' end, 'P1;P2' from nation union all select 'G' || n_nationkey, 'mechanistic_pathway_or_similarity_hypothesis', 'not_applicable', null from nation union all select 'R' || n_nationkey, 'mechanistic_pathway_or_similarity_hypothesis', 'not_applicable', null from nation
union all select 'negative_query_' || lpad(i::varchar, 3, '0'), 'unsupported_contradicted_or_unsafe_claim', 'not_applicable', null from range(0, 20) t(i))""")
def effect_cases(spark, sf):
    """GEN13, GEN14, GEN15, GEN16, GEN17, SET8, PRJ11, SRC22, SRC23, SRC24, SRC25: cases built from the answers of public services, made up to 120 by negative queries."""
    k = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    one = lambda body, query: nation.groupBy(query.alias("query")).agg(F.to_json(body).alias("text"))
    ident = lambda p: F.concat(F.lit(p), k.cast("string"))
    labels = nation.select(F.col("n_name").alias("query"), F.to_json(F.struct(F.array(F.struct(ident("S").alias("setid"))).alias("data"))).alias("text"))
    study = F.struct(F.struct(F.struct(ident("N").alias("nctId")).alias("identificationModule"), F.struct(F.array(F.lit("P1"), F.lit("P2")).alias("phases")).alias("designModule")).alias("protocolSection"), (k % 2 == 0).alias("hasResults"))
    trials = one(F.struct(F.collect_list(study).alias("studies")), F.lit("peptide"))
    terms = one(F.struct(F.collect_list(F.struct(ident("G").alias("id"))).alias("results")), F.lit("peptide"))
    paths = one(F.struct(F.array(F.struct(F.collect_list(F.struct(ident("R").alias("stId"))).alias("entries"))).alias("results")), F.lit("peptide"))
    built = effects.effect_cases(120, effects.negative_cases(spark, 50), effects.label_cases(labels, nation.select(F.col("n_name").alias("query"), F.lit("cardiovascular").alias("category"))), effects.trial_cases(trials), effects.term_cases(terms), effects.pathway_cases(paths))
    return built.select("source_id", "evidence_level", "evidence_direction", "trial_phase")


# Reports, curated tables and builds


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'high' else 'low' end as confidence, case when c_custkey % 4 = 1 then 'severe' when c_custkey % 4 = 2 then 'mild' else 'unknown' end as stability, case c_custkey % 4 when 0 then 10 when 1 then 11 when 2 then 10 else 11 end + (c_custkey % 4 = 3)::int as notes, case when c_custkey % 4 = 0 then 2 else 0 end::bigint as facts from customer""".replace("case c_custkey % 4 when 0 then 10 when 1 then 11 when 2 then 10 else 11 end + (c_custkey % 4 = 3)::int", "case c_custkey % 4 when 0 then 9 when 1 then 11 when 2 then 10 else 12 end::bigint"))
def normalised_reports(spark, sf):
    """PRJ45, PRJ46, PRJ47: reports in the template's shape, with notes on what was moved or defaulted."""
    k = F.col("c_custkey")
    payload = F.when(k % 4 == 0, '{"overall_confidence": " HIGH ", "known_source_backed_facts": ["a", 2]}').when(k % 4 == 1, '{"stability_risk": "severe"}').when(k % 4 == 2, '{"developability": {"stability_risk": "mild"}}').otherwise("[1]")
    out = table(spark, sf, "customer").select("c_custkey", F.parse_json(payload).alias("payload")).select("c_custkey", reports.normalised().alias("x"))
    r = "x.report"
    return out.select("c_custkey", F.col(f"{r}.overall_confidence").alias("confidence"), F.col(f"{r}.developability.stability_risk").alias("stability"), big(F.size("x.notes")).alias("notes"), big(F.size(f"{r}.known_source_backed_facts")).alias("facts"))


@query("""select c_custkey, unnest(case c_custkey % 3 when 0 then ['missing:' || t] else [] end) as error from customer, (values ('developability'), ('functional_assay_estimate'), ('human_effect_estimate'), ('known_source_backed_facts'), ('missing_evidence'), ('overall_confidence'), ('pose_contact_assessment'), ('recommended_next_assays'), ('structure_source_reference'), ('target_binding'), ('unsupported_claims')) v(t)
union all select c_custkey, unnest(['type:overall_confidence:str', 'missing:pose_contact_assessment.notes', 'pose_contact_assessment.predicted_contacts.0:extra_fields:colour', 'missing:pose_contact_assessment.predicted_contacts.0.target_residue', 'type:pose_contact_assessment.predicted_contacts.1:dict']) from customer where c_custkey % 3 = 1""")
def report_errors(spark, sf):
    """PRJ49: what a report lacks of its template or has of another kind."""
    import json

    whole = {k: v if isinstance(v, (str, list)) else dict(v) for k, v in reports.TEMPLATE.items()}
    bad = {**whole, "overall_confidence": 3, reports.POSE: {**{k: v for k, v in whole[reports.POSE].items() if k != "notes"}, "predicted_contacts": [{"peptide_residue": "B:1", "colour": "red"}, 4]}}
    k = F.col("c_custkey")
    payload = F.when(k % 3 == 0, "{}").when(k % 3 == 1, json.dumps(bad)).otherwise(json.dumps(whole))
    return table(spark, sf, "customer").select("c_custkey", F.parse_json(payload).alias("payload")).select("c_custkey", F.explode(reports.report_errors()).alias("error"))


@query("select 'human_effect' as track, 34::bigint as words, true as contract union all select 'binding_rank', 0, true union all select 'pose', 0, true union all select 'structure', 0, true")
def output_contracts(spark, sf):
    """EXT27, EXT30: what is asked of a model for each track, with the words of the closed domains, behind the last message."""
    message = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("u").alias("content")))
    parts = []
    for track in ASKED_ORDER:
        text = F.element_at(reports.with_contract(message, track), -1)["content"]
        words = [w for name in reports.LISTED.get(track, ()) for w in reports.DOMAINS[name]]
        found = sum((text.contains(w).cast("bigint") for w in words), F.lit(0).cast("bigint"))
        parts.append(spark.range(1).select(F.lit(track).alias("track"), found.alias("words"), text.endswith(reports.ONLY_JSON).alias("contract")))
    return keys.union_all(*parts)


ASKED_ORDER = tuple(reports.ASKED)


@query("""select 's' || c_custkey as benchmark_id, 'structure' as track, c_acctbal as number, null::bigint as items, null as second from customer where c_custkey % 3 = 0 union all select 's' || c_custkey, 'pose', 2.5, 1, 'B:2' from customer where c_custkey % 3 = 1 union all select 's' || c_custkey, 'binding_rank', 1.5, 2, 'i1' from customer where c_custkey % 3 = 2""")
def curated_cases(spark, sf):
    """PRJ8, PRJ9, PRJ10: curated CSV rows of structures, poses and panels: numbers, contacts and items parsed."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.concat(F.lit("s"), k).alias("benchmark_id"), text("c_acctbal").alias("resolution_angstrom"))
    contacts = '[{"target_residue": "A:1", "peptide_residue": "B:1", "distance_angstrom": 2.5}]'
    items = '[{"item_id": "i0", "measured_value": 1.5, "normalized_rank": 1}, {"item_id": "i1", "measured_value": 2, "normalized_rank": 0}]'
    structure_rows = projections.prepare(rows.where(k % 3 == 0).drop("c_custkey"), "structure", "2024-01-01").select("benchmark_id", "track", F.col("resolution_angstrom").alias("number"), F.lit(None).cast("bigint").alias("items"), F.lit(None).cast("string").alias("second"))
    pose_rows = projections.prepare(rows.where(k % 3 == 1).select("benchmark_id", F.lit(contacts).alias("native_contacts_json"), F.lit("B:1;B:2;").alias("binding_site_residues")), "pose", "2024-01-01").select("benchmark_id", "track", F.col("native_contacts")[0]["distance_angstrom"].alias("number"), big(F.size("native_contacts")).alias("items"), F.col("binding_site_residues")[1].alias("second"))
    panel_rows = projections.prepare(rows.where(k % 3 == 2).select("benchmark_id", F.lit(items).alias("items_json")), "binding_rank", "2024-01-01").select("benchmark_id", "track", F.col("items")[0]["measured_value"].alias("number"), big(F.size("items")).alias("items"), F.col("items")[1]["item_id"].alias("second"))
    return keys.union_all(structure_rows, pose_rows, panel_rows)


@query("""with s as (select user_id::varchar as v from events intersect select c_custkey::varchar from customer) select count(*) as overlap_count, (select count(*) from events) as train_record_count, least(count(*), 200)::bigint as overlaps, least(count(*), 20)::bigint as examples, min(v) as first_value, count(*) = 0 as passed from s""")
def leakage_reports(spark, sf):
    """SRT9, CHK26: the report of a leakage check with its first overlaps."""
    train = table(spark, sf, "events").select(text("user_id").alias("case_id"), F.lit("plain").alias("messages"))
    bench = table(spark, sf, "customer").select(text("c_custkey").alias("benchmark_id"))
    r = splits.leakage_report(train, bench)
    return r.select("overlap_count", "train_record_count", big(F.size("overlaps")).alias("overlaps"), big(F.size("examples")).alias("examples"), F.col("overlaps")[0].alias("first_value"), "passed")


@query("""select 'structure' as track, 0::bigint as n, 0::bigint as scanned union all select 'pose', (select count(*) from customer), (select count(*) from customer) union all select 'binding_rank', 0, 0 union all select 'human_effect', (select count(*) from supplier), (select count(*) from supplier)""")
def built_release(spark, sf):
    """GEN18, GEN19, SRC11, SNK15: a release written from cases, with its references, status and counts, and scanned again."""
    root = scratch(spark, "build")
    effect = table(spark, sf, "supplier").select(text("s_suppkey").alias("benchmark_id"), F.lit("human_effect").alias("track"), F.lit("dailymed").alias("source_database"), F.lit("bundled").alias("release_mode"))
    counts = builds.write_release({"pose": _poses(spark, sf).drop("evidence_quote_or_label"), "human_effect": effect}, root)
    scanned = files.read_release(spark, root).groupBy("track").agg(F.count(F.lit(1)).alias("scanned"))
    return counts.join(scanned, "track", "left").na.fill(0, ["scanned"]).select("track", "n", "scanned")


@query("select 25::bigint as members, true as sealed, 1::bigint as refused")
def packaged_release(spark, sf):
    """SNK9: an archive with its digest, refused while there are violations (a small folder of the driver's)."""
    import hashlib
    import tarfile
    import tempfile
    from pathlib import Path

    none = spark.createDataFrame([], "scope string, message string")
    with tempfile.TemporaryDirectory() as d:
        for r in table(spark, sf, "nation").select("n_name").collect():  # 25 rows
            sinks.write_text(f"{d}/release/{r.n_name}.jsonl", r.n_name)
        digest = sinks.package(f"{d}/release", f"{d}/out.tar.gz", none)
        with tarfile.open(f"{d}/out.tar.gz") as tar:
            members = len(tar.getnames())
        sealed = digest == hashlib.sha256(Path(d, "out.tar.gz").read_bytes()).hexdigest() and Path(d, "out.tar.gz.sha256").read_text().startswith(digest)
        try:
            sinks.package(f"{d}/release", f"{d}/no.tar.gz", spark.createDataFrame([("a", "b")], none.schema))
            refused = 0
        except ValueError:
            refused = 1
    return spark.createDataFrame([(members, sealed, refused)], "members bigint, sealed boolean, refused bigint")


@query("select 'search' as what, n_name as id, n_nationkey::bigint as at from nation union all select 'entry', n_name, (n_nationkey % 3)::bigint from nation")
def service_searches(spark, sf):
    """SRC19, SRC30: ids that a search found, in its order, and the metadata of entries."""
    nation = table(spark, sf, "nation")
    one = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    answer = nation.agg(F.to_json(F.struct(F.transform(one, lambda x: F.struct(x["n_name"].alias("identifier"))).alias("result_set"))).alias("text"))
    entity_ids = F.transform(F.slice(F.array(F.lit("1"), F.lit("2")), 1, F.col("n_nationkey") % 3), lambda x: x)
    entries = nation.select(F.to_json(F.struct(F.col("n_name").alias("rcsb_id"), F.struct(entity_ids.alias("polymer_entity_ids")).alias("rcsb_entry_container_identifiers"))).alias("text"))
    found = adapters.found_ids(answer).select(F.lit("search").alias("what"), F.col("pdb_id").alias("id"), big(F.col("ord")).alias("at"))
    return found.union(adapters.entry_metadata(entries).select(F.lit("entry"), "pdb_id", big(F.size("entity_ids"))))


_PAGED = "n as (select count(*)::bigint as n from part), p as (select row_number() over (order by p_partkey) - 1 as ord, p_partkey, p_brand from part)"


@query(f"""with {_PAGED}
select term, (ord // 40)::integer as page, ord, p_partkey, p_brand from p, (values ('peptide'), ('protein')) t(term) where ord < 250
union all select 'trial', (ord // 40)::integer, ord, p_partkey, p_brand from p where ord < 100
union all select 'all', (ord // 500)::integer, ord, p_partkey, p_brand from p""")
def paged_hits(spark, sf):
    """SRC21, SRC22, SRC30, SRC32: searches by offset and by token with their limits pushed into the pages that are read, and one without a limit; a hit is the place of a part."""
    parts = ordering.positions(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_partkey"], "place")
    total = parts.count()

    def fetch(url: str, body: bytes | None, timeout: int) -> str:
        import json
        from urllib import parse

        if body:
            page = json.loads(body)["request_options"]["paginate"]
            return json.dumps({"total_count": total, "result_set": [{"identifier": str(i)} for i in range(page["start"], min(page["start"] + page["rows"], total))]})
        asked = parse.parse_qs(parse.urlsplit(url).query)
        start, rows = int(asked.get("pageToken", ["0"])[0]), int(asked["pageSize"][0])
        return json.dumps({"studies": [{"identifier": str(i)} for i in range(start, min(start + rows, total))], **({"nextPageToken": str(start + rows)} if start + rows < total else {})})

    found = [paged.search(spark, "rcsb_text", ["peptide", "protein"], 250, 40, fetch), paged.search(spark, "clinicaltrials", ["trial"], 100, 40, fetch), paged.search(spark, "rcsb_polymer", ["all"], None, 500, fetch)]
    hits = keys.union_all(*found).withColumn("place", F.get_json_object("record", "$.identifier").cast("long"))
    return hits.join(parts, "place").select("term", "page", "ord", "p_partkey", "p_brand")


@query("""select v, o_orderkey, case when v > 1 and o_orderkey % 3 = 0 then 'changed' else o_orderstatus end as status, o_totalprice from orders, (values (1), (2), (3)) t(v)
union all select v, -c_custkey, 'added', 0.0 from customer, (values (2), (3)) t(v) union all select 3, -1000000000 - s_suppkey, 'mirrored', 1.0 from supplier""")
def committed_upserts(spark, sf):
    """SNK12, SNK13, SNK14: three versions of a table: as written, after an upsert that a failing one followed, and after a mirrored write whose copy is read."""
    from pyspark.errors import PySparkException

    path, copy = scratch(spark, "versions"), scratch(spark, "versions-copy")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    snapshots.commit(orders, path)
    changes = orders.where("o_orderkey % 3 = 0").withColumn("status", F.lit("changed"))
    added = table(spark, sf, "customer").select((-F.col("c_custkey")).alias("o_orderkey"), F.lit("added").alias("status"), F.lit(0.0).alias("o_totalprice"))
    snapshots.upsert(changes.union(added), path, ["o_orderkey"])
    try:
        snapshots.upsert(orders.withColumn("status", F.when(F.col("o_orderkey") % 1000 == 0, F.raise_error(F.lit("a task fails"))).otherwise("half").cast("string")), path, ["o_orderkey"])
    except PySparkException:
        pass  # the failing one, which leaves no trace
    more = table(spark, sf, "supplier").select((-1000000000 - F.col("s_suppkey")).alias("o_orderkey"), F.lit("mirrored").alias("status"), F.lit(1.0).alias("o_totalprice"))
    snapshots.mirror(snapshots.read(spark, path).union(more), path, copy)
    versions = [snapshots.read(spark, path, 1), snapshots.read(spark, path, 2), snapshots.read(spark, copy)]
    return keys.union_all(*[v.select(F.lit(i + 1).alias("v"), "o_orderkey", "status", "o_totalprice") for i, v in enumerate(versions)])


@query("""select c_custkey, case c_custkey % 5 when 0 then '{"id":' || c_custkey || '}' when 1 then '{"a":{"n":[{"m":' || c_custkey || '},{},2.5]},"z":"labels"}' when 2 then '[{},{"keep":' || c_custkey || '}]' when 3 then '{"s":"' || c_mktsegment || '"}' else '{"deep":{"deeper":{"deepest":[[{"ok":true}]]}}}' end as stripped,
case c_custkey % 5 when 0 then '$.labels' when 1 then '$.a.claim_status, $.a.n[0].category, $.a.n[1].qc_notes' when 2 then '$[0].prediction' when 3 then '' else '$.deep.deeper.deepest[0][0].native_contacts, $.deep.deeper.gold_labels' end as paths from customer""")
def stripped_variants(spark, sf):
    """PRJ18, PRJ19: fields out of records of unequal nesting at any depth, and where they were; nothing is left to find."""
    number = F.col("c_custkey")
    k = number.cast("string")
    record = F.when(number % 5 == 0, F.concat(F.lit('{"labels":[1,2],"none":null,"id":'), k, F.lit("}"))).when(number % 5 == 1, F.concat(F.lit('{"z":"labels","a":{"claim_status":"x","n":[{"category":1,"m":'), k, F.lit('},{"qc_notes":{"labels":1}},2.5]}}')))
    record = record.when(number % 5 == 2, F.concat(F.lit('[{"prediction":{"deep":1}},{"x":null,"keep":'), k, F.lit("}]"))).when(number % 5 == 3, F.concat(F.lit('{"s":"'), "c_mktsegment", F.lit('"}'))).otherwise(F.lit('{"deep":{"deeper":{"gold_labels":[{"a":1}],"deepest":[[{"ok":true,"native_contacts":[]}]]}}}'))
    rows = table(spark, sf, "customer").select("c_custkey", F.parse_json(record).alias("v"))
    clean = rows.select("c_custkey", variants.without_fields(F.col("v"), projections.FORBIDDEN, drop_nulls=True).alias("clean"), F.array_join(variants.field_paths(F.col("v"), projections.FORBIDDEN), ", ").alias("paths"))
    return clean.select("c_custkey", F.to_json(variants.asserted(F.col("clean"), projections.FORBIDDEN)).alias("stripped"), "paths")


@query("""with held as (select c_custkey::varchar as v from customer where c_custkey % 4 < 2), t as (select o_orderkey, o_custkey::varchar as v, case o_orderkey % 3 when 0 then 'train' when 1 then 'dev' else 'other' end as file from orders)
select distinct 'identifier' as kind, v as value from t where file <> 'other' and v in (select v from held)""")
def release_leaks(spark, sf):
    """SRC9, SRC10, JN18: a release's records but those of predictions and leaderboards, against the train and dev files of a folder, whose other files don't count."""
    root, folder = scratch(spark, "release"), scratch(spark, "training")
    k = F.col("c_custkey")
    cases = table(spark, sf, "customer").select(k.cast("string").alias("benchmark_id"), F.lit("test").alias("split"), (k % 4).alias("at"))
    for at, name in enumerate(("pose/cases.jsonl", "deep/er/cases.jsonl", "predictions/a.jsonl", "leaderboard/b.jsonl")):
        sinks.write_jsonl(cases.where(F.col("at") == at).drop("at"), f"{root}/{name}")
    rows = table(spark, sf, "orders").select(F.struct(text("o_custkey").alias("source_id")).alias("meta"), (F.col("o_orderkey") % 3).alias("at"))
    for at, name in enumerate(("train", "dev", "other")):
        sinks.write_jsonl(rows.where(F.col("at") == at).drop("at"), f"{folder}/{name}.jsonl")
    held = files.benchmark_records(spark, root).select(F.from_json("record", "benchmark_id string, split string").alias("r")).select("r.*")
    return splits.leakage(files.read_training(spark, folder, "meta struct<source_id:string>"), held)


@query("select 'http://h/' || s_suppkey || '.pdb' as url, case when s_suppkey % 4 > 1 then 'ATOM  ' || s_suppkey end as text from supplier")
def coordinate_files(spark, sf):
    """SRC20, SRC29: coordinate files from a cache or fetched; a failure, and a text without atoms, is null."""

    def fetch(url: str, body: bytes | None, timeout: int) -> str:
        k = int(url.split("/")[-1][:-4])
        if k % 4 == 0:
            raise OSError("down")
        return ("HEADER " if k % 4 == 1 else "ATOM  ") + str(k)

    urls = table(spark, sf, "supplier").select(F.concat(F.lit("http://h/"), text("s_suppkey"), F.lit(".pdb")).alias("url"))
    store = urls.where("url like '%3.pdb'").select("url", F.concat(F.lit("ATOM  "), F.regexp_extract("url", "([0-9]+)", 1)).alias("text")).where(F.regexp_extract("url", "([0-9]+)", 1).cast("int") % 4 > 1)
    return adapters.cached(urls, store, fetch, adapters.has_atoms())
