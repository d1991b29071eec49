from __future__ import annotations

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import braces, hashes, numbers, text
from lectern.functions.json import balanced_objects, extraction, flattened, message_content, object_in, repaired, tagged
from lectern.schemas import case_schema, missing, prediction_schema, quote_too_long, validate, validation_report


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("f", "value", "want"), [
    (text.clean_sequence, " acd-E1 ", "ACDE"), (text.clean_sequence, None, ""),
    (text.number_in_markup, "<b>1,234.5</b> nM", 1234.5), (text.number_in_markup, "&lt;5e-3", 0.005), (text.number_in_markup, "none", None),
    (text.slug, "openai/gpt-5:stable", "openai_gpt-5_stable"), (text.slug, "///", "model"),
    (text.source_name, " Gene Ontology/X ", "gene_ontology_x"), (text.split_name, " Dev ", "dev"),
    (text.provider, "a/b/c", "a"), (text.provider, "solo", "solo"), (text.options, " a, ,b ", ["a", "b"]),
    (text.has_secret, "token: abcdefgh12", False), (text.has_secret, "x tml-a9", True), (text.has_secret, "hf_" + "a" * 19, False), (text.has_secret, "hf_" + "a" * 20, True), (text.has_secret, 'HF_TOKEN = "v"', True), (text.has_secret, "HF_TOKEN=v", False), (lambda c: text.has_secret(c, text.MORE_SECRETS), "token: abcdefgh12", True), (text.has_secret, "nothing here", False),
    (text.answer_like, '{"Normalized_Rank": 1.0}', True), (text.confidence_word, "HIGH ", "high"), (text.confidence_word, "so-so", "low"), (text.confidence_value, "medium", 0.5),
    (text.claim_errors, "It is Safe for human use, not externally checked", ["safe for human use"]), (text.claim_errors, "externally checked", ["externally checked"]),
    (numbers.price, "x", float("inf")), (numbers.count_of, None, 0), (numbers.token_estimate, "abc", 1), (numbers.token_estimate, "a" * 41, 10),
    (tagged, "x <json>{}</json> y", "{}"), (tagged, "x", None), (repaired, 'a {"b": [1,],} c', '{"b": [1]}'),
    (message_content, '{"choices": [{"message": {"content": "hi"}}]}', "hi"),
    (lambda c: F.to_json(object_in(c)), 'text {"a": 1} more', '{"a":1}'), (lambda c: object_in(c).isNull(), "[1]", True),
    (hashes.sha256, "abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
    (text.degenerate_reason, "", "empty_output"), (text.degenerate_reason, "<noinput", "noinput_output"), (text.degenerate_reason, "words", "no_json_object_marker"), (text.degenerate_reason, '{"a": "}"', "no_balanced_json_object"), (text.degenerate_reason, '{"a": "}"}', None),
    (text.repetition_reason, "abcdefghijkl" * 5, "repeated_substring_loop"), (text.repetition_reason, "AB-1 cd XYZ " * 30, "mostly_repeated_tokens"), (text.repetition_reason, "see struct-0012 or pose-004 " * 8, "repeated_struct_pose_identifier_loop"), (text.repetition_reason, "each word here is another one", None), (text.degenerate_reason, "<no- {}", "no_prefixed_non_json_output"),
])
def test_columns(spark, f, value, want):
    assert one(spark, value, f) == want


def test_unknown_split_is_an_error(spark):
    with pytest.raises(Exception, match="unknown split"):
        one(spark, "other", text.split_name)


def test_group_ids_and_redaction(spark):
    df = spark.createDataFrame([("a", "", None)], "x string, y string, z string")
    assert df.select(text.group_id(F.col("x"), F.col("y"), F.col("z")).alias("r")).first().r == "a"
    assert df.select(text.group_id(F.col("y"), F.col("z")).alias("r")).first().r == "unknown"
    assert one(spark, "key sk-or-v1-abc_DEF at /home/me/x", text.error_message) == "key [redacted] at [local-path]"


@pytest.mark.parametrize(("answer", "key", "method"), [
    ('{"a": 1}', None, "raw:full_json"), ('noise {"a": 1} tail', None, "raw:first_balanced_object"), ('<json>{"a": 1}</json> junk', "a", "tagged_json:full_json"),
    ('{"x": {"b": 1}}', "b", "raw:first_balanced_object"), ('final {"a": [1, 2,],}', None, "raw:local_repair"), ("nothing", None, None), ('{"a": ', None, None),
])
def test_extraction(spark, answer, key, method):
    r = spark.createDataFrame([(answer,)], "s string").select(extraction(key)(F.col("s")).alias("x")).first().x
    assert r.method == method and (r.payload is None) == (method is None)
    assert r.payload is None or isinstance(json.loads(r.payload), dict)


def test_objects_inside_texts(spark):
    df = spark.createDataFrame([(1, 'a {"b": {"c": 1}} {"d": 2}'), (2, None), (3, '{"case_id": "x", "n": [{"item_id": 3}]}'), (4, "} { {}")], "i int, s string")
    found = {r.i: [(o.position, o.object) for o in r.o] for r in df.select("i", balanced_objects("s").alias("o")).collect()}
    assert found[1] == [(2, '{"b": {"c": 1}}'), (8, '{"c": 1}'), (18, '{"d": 2}')] and found[2] == [] and found[4] == [(4, "{}")]
    values = df.where("i = 3").select(F.explode(flattened("s", F.array(F.lit("case_id"), F.lit("item_id")))).alias("v")).select("v.*").collect()
    assert {(r.key, r.value) for r in values} == {("case_id", "x"), ("item_id", "3")}


@given(st.lists(st.text(alphabet='{}"ab\\', max_size=14), max_size=6))
@settings(max_examples=200, deadline=None)
def test_balanced_spans_against_a_scan_from_each_brace(texts):
    def scan(t):
        out = []
        for i in [i for i, c in enumerate(t) if c == "{"]:
            depth, quoted, j = 0, False, i
            while j < len(t):
                if t[j] == '"' and (j - len(t[:j].rstrip("\\"))) % 2 == 0:
                    quoted = not quoted
                elif t[j] in "{}" and not quoted:
                    depth += 1 if t[j] == "{" else -1
                    if not depth:
                        out.append((i, t[i : j + 1]))
                        break
                j += 1
        return out

    found = braces.balanced_objects(pa.array(texts, pa.string())).to_pylist()
    assert [[(o["position"], o["object"]) for o in x] for x in found] == [scan(t) for t in texts]


def test_features_and_costs(spark):
    r = spark.createDataFrame([("AILK",)], "s string").select(numbers.sequence_features(F.col("s")).alias("f")).first().f
    assert (r.length, r.hydrophobic_fraction, r.charged_fraction) == (4, 0.75, 0.25)
    cost = numbers.usage_cost(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("10"), F.lit("5"), F.lit("0.1"), F.lit("0.2"))
    assert spark.range(1).select(cost.alias("c")).first().c == pytest.approx(2.0)


def test_truth_and_quotes(spark):
    df = spark.createDataFrame([("", 0, [], None), ("x", 1, [1], True)], "s string, n int, a array<int>, b boolean")
    row = df.select(*[missing(F.col(c), t).alias(c) for c, t in df.dtypes]).collect()
    assert tuple(row[0]) == (True,) * 4 and tuple(row[1]) == (False,) * 4
    assert not one(spark, " ".join(["w"] * 35), quote_too_long) and one(spark, " ".join(["w"] * 36), quote_too_long)


def test_validation(spark):
    good = {"benchmark_id": "1", "track": "pose", "release_mode": "bundled", "source_database": "d", "source_id": "i", "source_url": "u", "retrieval_date": "t", "license_or_usage_note": "l", "qc_status": "unchecked", "split": "dev", "peptide": {"sequence": "ACD"}, "native_contacts": [{"target_residue": "A:1", "peptide_residue": "B:1", "distance_angstrom": 1.0}]}
    bad = {**good, "benchmark_id": "2", "split": "other", "peptide": {"sequence": "A C"}, "native_contacts": [{"target_residue": "A10", "peptide_residue": "B:1", "distance_angstrom": 1.0}]}
    df = spark.createDataFrame([good, bad], case_schema("pose"))
    found = {(r.benchmark_id, r.error) for r in validation_report(validate(df, "pose")).collect()}
    assert {e for b, e in found if b == "1"} == set() and {e.split(":")[0] for b, e in found if b == "2"} == {"split", "peptide.sequence", "native_contacts"}
    pred = spark.createDataFrame([{"prediction_id": "p", "benchmark_id": "1", "track": "structure", "model_name": "m", "confidence": 2.0}], prediction_schema("structure"))
    assert [r.error for r in validation_report(validate(pred, "structure")).collect()] == ["confidence: outside 0..1"]


def test_hashes_follow_the_record(spark):
    df = spark.createDataFrame([("d", "i", "u", None, "old", 1)], "source_database string, source_id string, source_url string, source_record_hash string, processed_record_hash string, x int")
    a, b = hashes.with_hashes(df).first(), hashes.with_hashes(df.withColumn("x", F.lit(2))).first()
    assert a.source_record_hash == b.source_record_hash and a.processed_record_hash != b.processed_record_hash
    assert hashes.with_hashes(hashes.with_hashes(df)).first() == a
