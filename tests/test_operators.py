from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import builders, effects, evidence, keys, leaderboard, ordering, predictions, projections, qc, ranking, release, retries, splits, structure
from lectern.plans import model_runs, workflows
from lectern.schemas import case_schema, prediction_schema
from lectern.sources import adapters
from lectern.sources.adapters import OutOfCredits


def items(spark, gold, pred):
    return spark.createDataFrame([(1, i, float(g), float(p)) for i, (g, p) in enumerate(zip(gold, pred, strict=True))], "panel int, item int, gold double, pred double")


@pytest.mark.parametrize(("gold", "pred", "want"), [([1, 2, 3], [1, 2, 3], (1, 1, 1, 1)), ([3, 2, 1], [1, 2, 3], (-1, -1, 0, 0)), ([1, 1, 1], [1, 2, 3], (0, 0, 0, 0)), ([1], [5], (0, 0, 0, 1))])
def test_panel_metrics(spark, gold, pred, want):
    r = ranking.panel_metrics(items(spark, gold, pred), ["panel"]).first()
    assert (round(r.spearman, 9), round(r.kendall_tau, 9), round(r.pairwise_accuracy, 9), r.top_enrichment) == want


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_merged_pairs_equal_all_pairs(pairs):
    g, p = np.array([x for x, _ in pairs], float), np.array([y for _, y in pairs], float)
    product = [(g[i] - g[j]) * (p[i] - p[j]) for i in range(len(g)) for j in range(i)]
    assert ranking._sorted_agreement(g, p) == (sum(x > 0 for x in product), sum(x < 0 for x in product))


def test_large_panels_take_the_merging_path(spark, monkeypatch):
    frame = items(spark, range(60), [(i * 37) % 60 for i in range(60)])
    small = ranking.pair_metrics(frame, ["panel"]).first()
    monkeypatch.setattr(ranking, "SMALL", 10)
    assert ranking.pair_metrics(frame, ["panel"]).first() == small


def test_spearman_is_invariant_under_monotone_maps(spark):
    a = ranking.spearman(items(spark, [1, 5, 2, 4], [2, 9, 3, 1]), ["panel"]).first().spearman
    b = ranking.spearman(items(spark, [1, 125, 8, 64], [4, 81, 9, 1]), ["panel"]).first().spearman
    assert a == pytest.approx(b)


def test_binding_rank_evaluation(spark):
    case = {"benchmark_id": "b", "measurement_direction": "higher_is_stronger", "comparable_panel": True, "items": [{"item_id": i, "measured_value": v} for i, v in (("a", 0.9), ("b", 0.5), ("c", 0.1))]}
    cases = spark.createDataFrame([case, {**case, "benchmark_id": "x", "comparable_panel": False}], case_schema("binding_rank"))
    pred = spark.createDataFrame([{"benchmark_id": i, "scores": [{"item_id": k, "score": s} for k, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))]} for i in ("b", "x")], prediction_schema("binding_rank"))
    r = workflows.evaluate("binding_rank", cases, pred).first()
    assert r.pairwise_ranking_accuracy == 1 and r.assay_aware_subgroup_count == 1 and r.n_cases == 2
    m = {x.metric: x for x in workflows.long_metrics(workflows.evaluate("binding_rank", cases, pred)).collect()}
    assert m["spearman"].value == 1 and m["spearman"].status == "computed"


def effect(spark, **change):
    base = {"benchmark_id": "h", "category": "neuro_cns", "evidence_level": "human_clinical_evidence", "evidence_direction": "mixed", "claim_status": "supported", "safety_status": "known_risk"}
    return {**base, **change}


def test_human_effect_evaluation(spark):
    cases = spark.createDataFrame([effect(spark), effect(spark, benchmark_id="u", claim_status="unsupported", trial_has_results=False)], case_schema("human_effect"))
    gold = builders.baseline(cases, "human_effect", "oracle_copy")
    r = evidence.evaluate_human_effect(cases, gold).first()
    assert r.category_macro_f1 < 1 and r.correct_abstention_credit == 1 and r.unsupported_claim_detection_rate == 1 and r.failed_prediction_count == 0
    failed = predictions.failed(cases, "m").withColumns({c: F.lit(None).cast("string") for c in ("category", "evidence_level", "evidence_direction", "claim_status", "safety_status")}).withColumn("abstained", F.lit(None).cast("boolean"))
    f = evidence.evaluate_human_effect(cases, failed).first()
    assert (f.failed_prediction_count, f.valid_prediction_rate, f.category_macro_f1, f.claim_status_accuracy, f.evidence_level_distance_penalty) == (2, 0, 0, 0, 5)
    none = evidence.evaluate_human_effect(cases, gold.limit(0)).first()
    assert none.n_matched == 0 and none.category_macro_f1 == 0


def test_pose_and_structure(spark):
    contacts = [{"target_residue": "A:10", "peptide_residue": "B:1", "distance_angstrom": 4.1}, {"target_residue": "A:12", "peptide_residue": "B:2", "distance_angstrom": 4.8}]
    cases = spark.createDataFrame([{"benchmark_id": "p", "native_contacts": contacts, "orientation_label": "up"}, {"benchmark_id": "q", "native_contacts": []}], case_schema("pose"))
    pred = spark.createDataFrame([{"benchmark_id": i, "predicted_contacts": contacts[:1], "orientation_label": "up"} for i in "pq"], prediction_schema("pose"))
    r = structure.evaluate_pose(cases, pred).first()
    assert (r.interface_contact_precision, r.interface_contact_recall, r.binding_site_recovery, r.contact_metric_denominator, r.pose_coordinate_reference_subset_count, r.peptide_orientation_accuracy) == (1, 0.5, 0.5, 1, 1, 1)
    atoms = lambda x: [{"atom_id": "N", "x": x, "y": 0.0, "z": 0.0}]
    s = spark.createDataFrame([{"benchmark_id": "s", "gold_coordinates": atoms(0.0)}, {"benchmark_id": "t", "gold_coordinates": []}], case_schema("structure"))
    sp = spark.createDataFrame([{"benchmark_id": i, "coordinates": atoms(1.0)} for i in "st"], prediction_schema("structure"))
    e = structure.evaluate_structure(s, sp).first()
    assert (e.backbone_rmsd, e.rmsd_evaluated_cases, e.rmsd_skipped_count) == (1, 1, 1)


def test_contact_grid_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 8, (60, 3)), rng.normal(0, 8, (50, 3))
    frame = lambda m: spark.createDataFrame([(f"r{i % 20}", *map(float, v)) for i, v in enumerate(m)], "residue string, x double, y double, z double")
    want = {}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            d = float(np.sqrt(((p - q) ** 2).sum()))
            if d <= 5:
                k = (f"r{i % 20}", f"r{j % 20}")
                want[k] = min(d, want.get(k, 9))
    got = {(r.residue, r.other_residue): r.distance for r in structure.contacts(frame(a), frame(b)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)


def test_keys(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "k int, v string, ord int")
    assert {(r.k, r.v) for r in keys.first_by(df, ["k"]).collect()} == {(1, "a"), (2, "c")}
    assert {(r.k, r.v, r.ord) for r in keys.last_by(df, ["k"], keep_place=True).collect()} == {(1, "b", 0), (2, "c", 2)}
    assert {(r.k, r.v) for r in keys.upsert(df.select("k", "v"), spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (1, "b"), (2, "z"), (3, "n")}
    records = spark.createDataFrame([("x", None, 0), ("", "y", 1), (None, "y", 2), (None, None, 3), (None, None, 4)], "benchmark_id string, source_id string, ord int")
    assert sorted(r.ord for r in keys.deduplicate_records(records).collect()) == [0, 1, 3, 4]


def test_leaderboard(spark):
    rows = [("m/a", "base", 0.5, 10, 10, 0.9, 1, 1, False), ("m/b", "base", 0.9, 10, 9, None, 0, 0, False), ("m/c", "base", 0.4, 10, 10, None, 0, 0, False), ("base", "baseline", 0.3, 10, 10, None, 0, 0, True), ("my_oracle", "base", 1.0, 10, 10, None, 0, 0, False), ("non_oracle", "base", 0.2, 10, 10, None, 0, 0, False)]
    df = spark.createDataFrame(rows, "model_id string, mode string, mean_score double, total_cases_attempted int, total_cases_completed int, valid_prediction_rate double, invalid_json_count int, failed_prediction_count int, is_baseline boolean")
    got = {r.model_id: (r.row_status, r["rank"], r.coverage_adjusted_score) for r in leaderboard.public_rows(df).collect()}
    assert got == {"m/a": ("completed_with_failures", 1, 0.45), "m/c": ("clean_completed", 2, 0.4), "non_oracle": ("clean_completed", 3, 0.2), "m/b": ("excluded_incomplete", None, None), "base": ("noncompetitive_baseline", None, None), "my_oracle": ("noncompetitive_oracle", None, None)}
    assert leaderboard.check(df).count() == 0
    bad = df.where("model_id = 'm/b'")
    assert [r.error for r in leaderboard.check(bad).collect()] == ["no rankable competitive rows"]
    log = spark.createDataFrame([("m", "base", "t", "1", "e", "still_failed", 0), ("m", "base", "t", "1", "e", "recovered", 1), ("m", "base", "t", "2", None, "still_failed", 2)], "model_id string, mode string, track string, benchmark_id string, error_type string, retry_status string, ord int")
    found = {(r.kind, r.key): r.n for r in leaderboard.diagnosis(df, log).collect()}
    assert found == {("row_status", "completed_with_failures"): 1, ("row_status", "clean_completed"): 2, ("row_status", "excluded_incomplete"): 1, ("row_status", "noncompetitive_baseline"): 1, ("row_status", "noncompetitive_oracle"): 1, ("root_cause", "incomplete coverage"): 1, ("root_cause", "noncompetitive_oracle"): 1, ("retry_status", "recovered"): 1, ("retry_status", "still_failed"): 1, ("model_id", "m"): 1, ("mode", "base"): 1, ("track", "t"): 1, ("error_type", "unknown"): 1}
    assert {r.model_id: r.s for r in leaderboard.complete(df).select("model_id", F.lit(None).cast("string").alias("row_status"), "coverage", "total_cases_attempted", "total_cases_completed", "api_error_count", "invalid_json_count").select("model_id", leaderboard.run_status().alias("s")).collect()} == {"m/a": "excluded_provider_error", "m/b": "excluded_incomplete", "m/c": "clean_completed", "base": "clean_completed", "my_oracle": "clean_completed", "non_oracle": "clean_completed"}
    tracks = spark.createDataFrame([("a", 5, 5, 0, 0, 1), ("a", 5, 4, 0, 0, 0), ("b", 5, 5, 0, 2, 0), ("c", 5, 5, None, None, None)], "run string, attempted int, completed int, unresolved_api_errors int, unresolved_invalid_json int, retry_recovered_count int")
    assert {r.run: (r.status, r.invalid_json, r.recovered) for r in leaderboard.manifest_status(tracks, ["run"]).collect()} == {"a": ("incomplete", 0, 1), "b": ("completed_with_failures", 2, 0), "c": ("completed_clean", 0, 0)}
    wanted = spark.createDataFrame([("p/x",), ("q/y",)], "model_id string")
    assert {r.model_id: (r.provider, r.structured_outputs_supported) for r in leaderboard.models_for(wanted, spark.createDataFrame([("p/x", "own", True)], "model_id string, provider string, structured_outputs_supported boolean")).collect()} == {"p/x": ("own", True), "q/y": ("q", False)}


def test_rows_from_results(spark):
    results = spark.createDataFrame([("m", "base", "binding_rank", 2, 2, 2, 1.0, 1.0, 1.0), ("m", "base", "structure", 2, 2, 1, None, None, None)], "model_id string, mode string, track string, n_cases int, attempted int, completed int, spearman double, kendall_tau double, pairwise_ranking_accuracy double")
    r = leaderboard.rows_from_results(results).first()
    assert r.mean_score == 1.0 and r.coverage["structure"].completed == 1 and r.structure_score is None
    assert workflows.leaderboard_from_results(results).first().row_status == "excluded_incomplete"


def qc_case(**change):
    base = {"benchmark_id": "c", "track": "human_effect", "source_database": "dailymed", "source_id": "i", "source_url": "u", "source_version": "v", "retrieval_date": "d", "license_or_usage_note": "l", "release_mode": "bundled", "qc_status": "source_checked", "leakage_group": {"panel_id": "p"}, "split": "test", "processed_record_hash": "h", "citation": "c", "source_evidence_type": "label", "evidence_level": "approved_human_indication", "evidence_direction": "positive", "claim_status": "supported", "safety_status": "known_acceptable_under_approved_use", "category": "neuro_cns"}
    return {**base, **change}


def test_quality_control(spark):
    cases = [qc_case(), qc_case(benchmark_id="down", source_database="pubmed"), qc_case(benchmark_id="gone", source_id=None), qc_case(benchmark_id="hash", processed_record_hash=None), qc_case(benchmark_id="trial", source_database="clinicaltrials", evidence_level="human_clinical_evidence", safety_status="known_risk", trial_has_results=False)]
    out = workflows.quality_control(spark.createDataFrame(cases, case_schema("human_effect")))
    card = {r.benchmark_id: r for r in out["cards"].collect()}
    assert {k: v.action for k, v in card.items()} == {"c": "kept", "down": "downgraded", "gone": "excluded", "hash": "kept", "trial": "downgraded"}
    kept = {r.benchmark_id: r for r in out["cases"].collect()}
    assert kept["down"].evidence_level == qc.MECHANISM and kept["down"].qc_result == "downgraded_by_qc" and kept["c"].qc_result == "passed_qc" and kept["hash"].qc_result == "passed_qc" and kept["hash"].processed_record_hash
    assert kept["trial"].evidence_direction == "not_reported" and kept["trial"].evidence_validation_status == "downgraded" and card["trial"].qc_resolution == "downgraded" and kept["trial"].qc_status == "source_checked"
    assert [r.exclusion_reason for r in out["excluded"].collect()] == ["missing provenance: source_id"]
    again = workflows.quality_control(out["cases"].select(*case_schema("human_effect").names))["cards"]
    assert again.where("action = 'excluded'").count() == 0
    out["checked"].unpersist()


def test_poses_with_coordinates_only(spark):
    base = {k: v for k, v in qc_case(track="pose").items() if k in case_schema("pose").names}
    case = {**base, "target_chain_id": "A", "peptide_chain_id": "B", "peptide_length": 10, "target_length": 100, "native_contacts": [], "coordinate_reference": "x"}
    r = qc.check_records(spark.createDataFrame([case], case_schema("pose"))).first().qc
    assert r.updates["pose_subset"] == "pose_coordinate_reference" and r.qc_result == "passed_with_warnings" and r.scoring_subset == "source_reference_only"


def test_release_checks(spark):
    cases = spark.createDataFrame([qc_case(), qc_case(benchmark_id="x", source_database="pubmed", release_mode="source_reference_only")], case_schema("human_effect"))
    found = {(r["scope"], r.message) for r in release.release_check(cases, {"human_effect": 1, "pose": 1}).collect()}
    assert ("x", "approved indication needs a label source") in found and ("pose", "0 cases, 1 needed") in found
    assert [r.benchmark_id for r in release.unreferenced(cases, cases.where("benchmark_id = 'c'")).collect()] == ["x"]
    manifest = spark.createDataFrame([("dailymed", "A"), ("chembl", "B")], "name string, bucket string")
    grid = release.status_grid(manifest, cases, cases.limit(0).select("source_database", "track"))
    assert grid.count() == 12 and grid.where("source_database = 'dailymed' and track = 'human_effect'").first().cases == 1
    assert release.histogram(cases, "release_mode").where("n = 0").count() == 2


def test_leakage(spark):
    train = spark.createDataFrame([("b1", [("i9",)], "normalized_rank: 1.0")], "benchmark_id string, items array<struct<item_id:string>>, messages string")
    bench = spark.createDataFrame([("b1", "test", [("i9",)]), ("b2", "train", [("i8",)])], "benchmark_id string, split string, items array<struct<item_id:string>>")
    r = splits.leakage_report(train, bench).first()
    assert r.overlaps == ["b1", "i9"] and r.answer_like_count == 1 and not r.passed
    clean = splits.leakage_report(train.withColumn("messages", F.lit("hi")), bench.where("split = 'train'")).first()
    assert clean.passed and clean.overlaps == []


def test_splits(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    at = ordering.positions(df, ["k"]).orderBy("k").collect()
    assert [r.position for r in at] == list(range(1000))
    share = {r.split: r.n for r in splits.seeded_split(df, "id").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert share == {"dev": 100, "holdout": 100, "train": 800}
    one = {r.id: r.split for r in splits.seeded_split(df, "id").collect()}
    assert one == {r.id: r.split for r in splits.seeded_split(df.repartition(3), "id").collect()}
    order = sorted(range(1000), key=lambda i: __import__("hashlib").sha256(f"7:{i}".encode()).hexdigest())
    assert [one[i] for i in order] == ["dev"] * 100 + ["holdout"] * 100 + ["train"] * 800


def test_retries(spark):
    log = spark.createDataFrame([("m", "base", "t", "a", "still_failed", "invalid_json", 0), ("m", "base", "t", "a", "recovered", None, 1), ("m", "base", "t", "b", "still_failed", "api", 2)], "model_id string, mode string, track string, benchmark_id string, retry_status string, error_type string, ord int")
    s = retries.summary(log).first()
    assert (s.retry_queue_size, s.retry_recovered_count, s.post_retry_api_error_count) == (2, 1, 1)
    done = retries.reconcile(log, log.where("benchmark_id = 'b'").select(*retries.KEY))
    assert {r.retry_status for r in done.collect()} == {"recovered"}
    assert retries.plan(log.select(*retries.KEY)).first().requests == 1


def test_sanitizing(spark):
    case = spark.createDataFrame([{"benchmark_id": "b", "track": "binding_rank", "source_url": "u", "items": [{"item_id": "i", "measured_value": 1.0, "normalized_rank": 0.5}]}], case_schema("binding_rank"))
    for mode in ("base", projections.TOOLS):
        out = projections.sanitize(case, "binding_rank", mode)
        assert "measured_value" not in out.schema.json() and projections.forbidden_paths(out.schema) == [] and ("source_url" in out.columns) == (mode != "base")
        assert out.first().candidate_peptides[0].item_id == "i"
    assert projections.forbidden_paths(case.schema)
    assert projections.prompts(projections.sanitize(case, "binding_rank", "base"), "binding_rank", "Rank.", 10).first().benchmark_ids == ["b"]


def test_prepare_csv_rows(spark):
    csv = spark.createDataFrame([("s", "ACD", "True", '[{"item_id": "i"}]', "a;;b")], "source_id string, sequence string, comparable_panel string, items_json string, source_ids string")
    r = projections.prepare(csv, "binding_rank", "2024-01-01").first()
    assert r.comparable_panel is True and r["items"][0].item_id == "i" and r.source_ids == ["a", "b"] and r.peptide.sequence == "ACD" and r.split == "test"


def test_answers_to_predictions(spark):
    answers = spark.createDataFrame([("a", 'x {"category": "Neuro CNS", "evidence_level": "odd", "abstained": true}'), ("b", "nothing")], "benchmark_id string, text string")
    got = {r.benchmark_id: r for r in predictions.predictions(predictions.parsed(answers), "human_effect", "m").collect()}
    assert got["a"].category == "neuro_cns" and got["a"].evidence_level == predictions.DEFAULTS["evidence_level"] and got["a"].abstained and got["b"].status == "failed"
    pose = spark.createDataFrame([("p", '{"contacts": [{"target_residue": "A:1", "peptide_residue": "B:2"}, {"target_residue": "A1", "peptide_residue": "B:2"}], "clash_score": -1}')], "benchmark_id string, text string")
    r = predictions.predictions(predictions.parsed(pose), "pose", "m").first()
    assert len(r.predicted_contacts) == 1 and r.clash_score == 0
    flat = spark.createDataFrame([("b", 0, "c1", 0.8), ("b", 1, "c2", 0.2)], "benchmark_id string, ord int, item_id string, score double")
    assert [s.item_id for s in predictions.regrouped(flat).first().scores] == ["c1", "c2"]
    z = spark.createDataFrame([([1.0, 2.0, 3.0], [("x",), ("y",)])], "scores array<double>, items array<struct<item_id:string>>").select(predictions.zipped_scores(F.col("scores"), F.col("items")).alias("s")).first().s
    assert [(e.item_id, e.score) for e in z] == [("x", 1.0), ("y", 2.0)]
    cases = spark.createDataFrame([("a",), ("z",)], "benchmark_id string")
    assert {(r.benchmark_id, r.error) for r in predictions.matching_errors(answers, cases).collect()} == {("b", "unknown benchmark_id"), ("z", "missing prediction")}


def test_seeded_scores_are_one_stream_through_the_cases(spark):
    import random

    sizes = [3, 1, 4, 2, 5, 7]
    data = [{"benchmark_id": str(i), "track": "binding_rank", "items": [{"item_id": f"i{j}"} for j in range(n)]} for i, n in enumerate(sizes)]
    cases = spark.createDataFrame(data, case_schema("binding_rank")).withColumn("ord", F.col("benchmark_id").cast("int"))
    rng = random.Random(13)
    want = {str(i): [(f"i{j}", rng.random(), j + 1) for j in range(n)] for i, n in enumerate(sizes)}
    for df in (cases, cases.repartition(4)):
        got = {r.benchmark_id: [(s.item_id, s.score, s["rank"]) for s in r.scores] for r in builders.baseline(df, "binding_rank").collect()}
        assert got == want


def test_effect_builders(spark):
    answer = lambda q, v: spark.createDataFrame([(q, json.dumps(v))], "query string, text string")
    labels = effects.label_cases(answer("drug", {"data": [{"setid": "s1", "spl_version": "3"}, {"setid": "s2"}]}), spark.createDataFrame([("drug", "cardiovascular")], "query string, category string"))
    study = lambda i, **k: {"protocolSection": {"identificationModule": {"nctId": i}, "statusModule": {"overallStatus": "DONE"}, "designModule": {"phases": ["P1", "P2"]}}, **k}
    trials = effects.trial_cases(answer("peptide", {"studies": [study("N1"), study(None), study("N2", hasResults=True)]}))
    terms = effects.term_cases(answer("peptide", {"numberOfHits": 9, "results": [{"id": "GO:1"}]}))
    paths = effects.pathway_cases(answer("peptide", {"results": [{"entries": [{"stId": "R1"}, {"dbId": 7}]}, {"entries": None}]}))
    assert [(r.source_id, r.category, r.source_result_count) for r in labels.collect()] == [("s1", "cardiovascular", 2)]
    assert {r.source_id: (r.evidence_direction, r.trial_phase, r.trial_has_results) for r in trials.collect()} == {"N1": ("not_reported", "P1;P2", False), "N2": ("inconclusive", "P1;P2", True)}
    assert [r.source_id for r in terms.collect()] == ["GO:1"] and {r.source_id for r in paths.collect()} == {"R1", "7"}
    rows = {r.benchmark_id: (r.source_id, r.split) for r in effects.effect_cases(8, effects.negative_cases(spark, 5), labels, trials, terms, paths).collect()}
    assert [rows[f"CASE-HFX-{i + 1:05d}"] for i in range(8)] == [("s1", "train"), ("N1", "dev"), ("N2", "test"), ("GO:1", "train"), ("R1", "dev"), ("7", "test"), ("negative_query_000", "train"), ("negative_query_001", "dev")]


def test_runs_fail_over_and_resume(spark):
    rows = [("m", "base", "pose", i, [f"b{i}"], f"ask {i}", f"short {i}") for i in range(4)] + [("n", "base", "pose", 0, ["b0"], "ask 0", "short 0")]
    requests = spark.createDataFrame(rows, "model_id string, mode string, track string, chunk long, benchmark_ids array<string>, messages string, compact string")

    def caller(model, messages, options):
        if model == "n":
            raise OutOfCredits("no")
        if messages == "ask 2":
            return "no object"
        return "{}"

    def check(text):
        if "{" not in text:
            raise ValueError("no JSON")

    result = model_runs.run_tracks(requests, caller, check, model_runs.run_ladder(1), wait=lambda s: None)
    found = {(r.model_id, r.chunk): (r.status, r.attempts, r.error_type) for r in result.collect()}
    assert found == {("m", 0): ("completed", 1, None), ("m", 1): ("completed", 1, None), ("m", 2): ("failed", 2, "invalid_json"), ("m", 3): ("fallback", 0, None), ("n", 0): ("failed", 1, "credits_exhausted")}
    done = result.where("status = 'completed'").select("model_id", "mode", "track", "chunk")
    again = model_runs.run_tracks(requests, caller, check, model_runs.retry_ladder(0), done, fail_over=False, wait=lambda s: None)
    assert {(r.model_id, r.chunk): (r.status, r.attempts) for r in again.collect()} == {("m", 2): ("completed", 3), ("m", 3): ("completed", 1), ("n", 0): ("failed", 1)}


def test_order_of_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}.jsonl").write_text("".join(json.dumps({"k": "a", "v": i * 1000 + j}) + "\n" for j in range(200 * (5 - i))))
    df = spark.read.schema("k string, v int").json(str(tmp_path))
    assert keys.last_by(keys.with_order(df), ["k"]).first().v == 4199 and keys.first_by(keys.with_order(df), ["k"]).first().v == 0
    assert [r.v for r in keys.with_order(df).orderBy("ord").collect()] == [i * 1000 + j for i in range(5) for j in range(200 * (5 - i))]


def test_missing_files_and_caveats(spark):
    files = spark.createDataFrame([(f"file:/x/{f}",) for f in release.REQUIRED_FILES if "qc_pass_b" not in f], "path string")
    assert [r.scope for r in release.missing_files(files).collect()] == ["references/qc_pass_b.jsonl"]
    df = spark.createDataFrame([("pose", "source_reference_only", "coordinate_reference_only"), ("human_effect", "bundled", None)], "track string, release_mode string, contact_label_status string")
    assert sorted(len(r.c) for r in df.select(release.caveats(df).alias("c")).collect()) == [2, 3]


def test_entries_of_a_service(spark):
    body = {"data": {"entries": [{"rcsb_id": "1ABC", "polymer_entities": [{"rcsb_id": "1ABC_2", "entity_poly": {"type": "polypeptide(L)", "pdbx_seq_one_letter_code_can": "ACD"}, "rcsb_polymer_entity_container_identifiers": {"auth_asym_ids": ["P"], "asym_ids": ["B"]}}]}]}}
    rows = adapters.entities(spark.createDataFrame([(json.dumps(body),), (None,)], "text string")).collect()
    assert [(r.pdb_id, r.entity_id, r.chains, r.length) for r in rows] == [("1ABC", "2", ["P"], 3)]
    batches = adapters.entry_batches(spark.range(250).select(F.format_string("%04d", F.col("id").cast("int")).alias("pdb_id"))).orderBy("batch").collect()
    assert [len(b.ids) for b in batches] == [100, 100, 50] and "entry_ids" in json.loads(batches[0].body)["query"]
    urls = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    store = spark.createDataFrame([("u1", "ATOM  1")], "url string, text string")
    got = adapters.cached(urls, store, lambda u, body, timeout: "nothing" if u == "u2" else 1 / 0, adapters.has_atoms())
    assert {r.url: r.text for r in got.collect()} == {"u1": "ATOM  1", "u2": None, "u3": None}


def test_panels(spark):
    rows = [("x", "ic50", f"{c}CD", f"<b>{i + 1},000</b>", i) for i, c in enumerate("ACDEFG")] + [("x", "ic50", "acd", "9", 9), ("y", "kd", "AAA", "1", 0)]
    got = builders.panels(spark.createDataFrame(rows, "allele string, assay string, sequence string, measure string, ord int")).collect()
    assert len(got) == 6 and {round(r.normalized_rank, 9) for r in got} == {0.0, 0.2, 0.4, 0.6, 0.8, 1.0}


def test_model_selection(spark):
    m = [("openai/gpt-5-pro", "GPT Pro", 5, 100, "1", "1"), ("openai/gpt-5-mini", "mini", 9, 100, "0.1", "0.1"), ("qwen/qwen-max", "Max", 1, 10, "2", "2"), ("qwen/qwen-vl", "qwen -vl", 1, 10, "0", "0"), ("x/free:free", "f", 1, 1, "0", "0")]
    df = spark.createDataFrame([(*r, None, None, None) for r in m], "id string, name string, created long, context_length long, prompt_price string, completion_price string, description string, output_modalities array<string>, supported_parameters array<string>")
    got = {r.family: r.id for r in builders.select_models(df).collect()}
    assert got == {"openai": "openai/gpt-5-pro", "qwen": "qwen/qwen-max", "small_fast": "openai/gpt-5-mini"}


def test_calls_resume_and_keep_errors(spark):
    prompts = spark.createDataFrame([("m", str(i), [("user", "x")]) for i in range(4)], "model_id string, benchmark_id string, messages array<struct<role:string,content:string>>")

    def caller(model, messages):
        raise ValueError("down")

    out = workflows.call_models(prompts, caller, prompts.limit(1).select("model_id", "benchmark_id"), retries=0).collect()
    assert len(out) == 3 and all(r.error == "ValueError: down" for r in out)


def test_runs_hold_a_batch_of_a_group(spark):
    rows = [(m, "base", "t", c, [f"b{c}"], str(c), None) for c in reversed(range(700)) for m in ("good", "odd", "poor")]
    requests = spark.createDataFrame(rows, "model_id string, mode string, track string, chunk bigint, benchmark_ids array<string>, messages string, compact string")

    def caller(model, messages, options):
        if model == "poor":
            raise OutOfCredits("pay")
        return "nothing" if model == "odd" and messages == "250" else "{}"

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = model_runs.run_tracks(requests, caller, json.loads, model_runs.run_ladder(1), wait=lambda s: None)
        got = {(r.model_id, r.chunk): (r.status, r.attempts) for r in out.collect()}
        assert "InPandas" in (plan := out._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = lambda m, c: ("completed", 1) if m == "good" or (m == "odd" and c < 250) else ("failed", 2) if m == "odd" and c == 250 else ("failed", 1) if m == "poor" and c == 0 else ("fallback", 0)
    assert got == {(m, c): want(m, c) for m in ("good", "odd", "poor") for c in range(700)}
