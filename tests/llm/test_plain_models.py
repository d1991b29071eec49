"""Models against plain versions; further columns, ties and repeats."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, fingerprint, licenses, merkle, near, packing, ppm, quality, repeats, reputation, secrets
from tests.llm import plain, plain_models
from tests.llm.conftest import prose


@pytest.mark.parametrize("order", [6, 2])
def test_scores_equal_partial_matching_with_dictionaries(docs, rows, order):
    model = plain_models.PartialMatching([t for d, t in rows if not plain.held(d)], order)
    found = {r.doc_id: r.score for r in ppm.score(docs, order=order, cache=500).collect()}
    assert {d for d, _ in rows if plain.held(d)}
    for d, text in rows:
        assert found[d] == pytest.approx(model.score(text), rel=1e-9, abs=1e-9), d


def test_partial_matching_without_training_text(spark):
    rows = [(d, t) for d, t in zip((d for d in range(200) if plain.held(d)), ["one two", "", None], strict=False)]
    model = plain_models.PartialMatching([], 6)
    found = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == pytest.approx({d: model.score(t) for d, t in rows})


def test_markov_spans_equal_all_stretches(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def part():
        key = "".join(rng.choices(letters, k=rng.randrange(8, 48)))
        name = rng.choice(["_", "-", "/", ""]).join(rng.choices(secrets.WORDS, k=rng.randrange(1, 6)))
        return rng.choice([key, name, f"{name}/{key}", f"{key}_{name}", f"{name}={key}==", f"token={key}", f"/{key}/{name}/", key + "_", "-" + key, "0123456789abcdef" * 2])

    rows = [(i, " ".join(part() + rng.choice(["", ".", " ü", "\n"]) for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    model = secrets.default_model(spark)
    assert model.threshold > 0
    weights = {(chr(43 + a), chr(43 + b)): round(model.ratios[80 * a + b] * 1000) for a in range(80) for b in range(80)}
    found = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = 0
    for d, text in rows:
        mine = plain_models.markov_spans(text, weights, model.threshold, secrets.LEAST_TOKEN)
        spans += len(mine)
        every = sorted([*((a, k, b) for a, k, b in plain.base_spans(text)), *((a, 3, b) for a, b in mine)])
        assert found[d] == ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, k, b in every), text
    assert spans > 100


#: Names that the operators use for columns of their own.
CLASHING = "row key n sig regs rep digest centre component part c0 d m kept rank salt length start sequence_id slot host path grams times code tail found markov position label leaf idx parent hash count bucket before".split()


OPERATORS = {
    "op2": lambda docs, labels, items: decontaminate.leaks(docs, items),
    "op3": lambda docs, labels, items: near.near_duplicates(docs),
    "op3, rows": lambda docs, labels, items: near.without_near_duplicates(docs).select("doc_id", "text"),
    "op4": lambda docs, labels, items: repeats.remove_repeats(docs),
    "op6": lambda docs, labels, items: fingerprint.edited_fingerprints(docs),
    "op7": lambda docs, labels, items: ppm.score(docs, order=2),
    "op8": lambda docs, labels, items: secrets.report(docs),
    "op9": lambda docs, labels, items: quality.classify(docs, labels),
    "op10": lambda docs, labels, items: packing.pack(docs),
    "op11": lambda docs, labels, items: licenses.report(docs),
    "op12": lambda docs, labels, items: merkle.verified(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_change_nothing(spark, name):
    rng = random.Random(2)
    passage = prose(rng, 120)
    texts = [passage, passage + " end", prose(rng, 40), None, "", "under the mit license token=abcdefgh12"]
    docs = spark.createDataFrame([(i, f"s{i % 2}", "en", len(t or ""), t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, n_chars long, text string").repartition(2)
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    more = docs.select("*", *[(F.lit("x") if i % 2 else F.lit(i)).alias(c) for i, c in enumerate(CLASHING)])
    results = [OPERATORS[name](of, labels, items) for of in (docs, more)]
    assert results[0].columns == results[1].columns
    # numbers of sequences are any numbers
    plainer = [sorted(str(r) for r in df.drop("sequence_id", "offset").collect()) for df in results]
    assert plainer[0] == plainer[1]
    assert plainer[0] or name == "op2"


def test_reputation_of_ties_repeats_and_further_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", 1), (1, "http://a.com/x", "h", 1), (2, "http://b.org/", None, 2), (None, "http://a.com/y", "z", 3), (4, None, "z", 4), (5, "no scheme", "z", 5)], "page_id long, url string, host string, n int").selectExpr("*", "n as k", "host as path", "host as suffix", "host as domain", "n as bound", "host as rule", "host as verdict")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "doc_id as page_id", "toxic as bad")
    found = [tuple(r) for r in reputation.judge_urls(pages, labels, rules={}).select("page_id", "host", "path").collect()]
    assert sorted(found, key=str) == sorted([(1, "a.com", "/x"), (1, "a.com", "/x"), (2, "b.org", "/"), (None, "a.com", "/y"), (4, "", ""), (5, "", "")], key=str)
    bounds = {r.host: r.bound for r in reputation.host_reputation(pages.select("page_id", *[c.alias(n) for c, n in zip(reputation.host_and_path(F.col("url")), ("host", "path"), strict=True)]), labels).collect()}
    at = bounds["a.com"]
    verdicts = lambda tolerated: {r.host: r.verdict for r in reputation.judge_urls(pages, labels, rules={}, tolerated=tolerated).collect()}
    assert verdicts(at)["a.com"] == "allow" and verdicts(at - 1e-9)["a.com"] == "block"
    assert {r.verdict for r in reputation.judge_urls(pages, labels.limit(0)).collect()} == {"allow"}
    assert reputation.judge_urls(pages.limit(0), labels.limit(0)).count() == 0
