"""Runs of a million key characters cost op8 and the pipeline's secrets stage time that grows with their length."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def plain_part(token, ratios):
    """The stretch of greatest sum, by all stretches; the first to begin among equal ones that end first."""
    code = [ord(c) - 43 for c in token]
    weight = [ratios[a * 80 + b] for a, b in zip(code, code[1:], strict=False)]
    best = max([sum(weight[i:j]) for i in range(len(weight)) for j in range(i + 1, len(weight) + 1)], default=0.0)
    return max(best, 0.0)


def test_best_parts_equal_all_stretches(spark):
    rng = random.Random(3)
    ratios = [round(rng.uniform(-1, 1), 3) for _ in range(6400)]
    tokens = ["".join(rng.choice(ALPHABET + "+/_=-") for _ in range(rng.randrange(2, 40))) for _ in range(150)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.best_part(F.col("t"), ratios).alias("p")).collect()
    assert all(math.isclose(r.p.ratio, plain_part(r.t, ratios), abs_tol=1e-9) and r.t[r.p.start : r.p.start + len(r.p.value)] == r.p.value for r in got)


@pytest.mark.parametrize("mark", ["", "/", "_"])
def test_a_run_of_a_million(spark, mark):
    rng = random.Random(4)
    half = "".join(rng.choices(ALPHABET, k=500_000))
    docs = spark.createDataFrame([(1, f"see {half}{mark}{half} end", "en", "s", 1_000_009), (2, "plain words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    secrets.default_model(spark)
    began = time.perf_counter()
    found = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    clean = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, "").collect()}
    assert time.perf_counter() - began < 40
    assert found[1].startswith("markov:4:") and found[2] == "" and clean == {1: "see [SECRET] end", 2: "plain words"}
