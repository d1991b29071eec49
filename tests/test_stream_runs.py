"""Runs as keyed state: pauses, the ladder, failing over, and a restart that asks nothing again."""

from __future__ import annotations

import collections
import json
import time

from lectern.plans.model_runs import Attempt, retry_ladder, run_ladder
from lectern.sources.adapters import OutOfCredits
from lectern.streaming import runs

REQUEST = "model_id string, mode string, track string, chunk bigint, benchmark_ids array<string>, messages string, compact string"


def caller(log):
    def call(model, messages, options):
        with open(log, "a") as f:
            f.write(f"{model} {messages}\n")
        if model == "poor":
            raise OutOfCredits("pay")
        if model == "odd" and messages in ("2", "3"):
            return "nothing"
        if model == "slow":
            with open(log) as f:
                if sum(line == f"slow {messages}\n" for line in f) < 3:
                    raise OSError("busy")
        return '{"a": 1}'

    return call


def rows(models, n):
    return [(m, "base", "t", c, [f"b{c}"], str(c), f"short{c}") for m in models for c in range(n)]


def test_ladders_and_fail_over(spark, tmp_path):
    runs.ready(spark)
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    spark.createDataFrame(rows(["good", "poor", "odd", "slow"], 5), REQUEST).write.parquet(source)
    stream = spark.readStream.schema(REQUEST).parquet(source)
    out = runs.drain(runs.run_stream(stream, caller(log), json.loads, run_ladder(2), most=3, first_wait=0.05), str(tmp_path / "out"), str(tmp_path / "cp"), 20)
    got = {(r.model_id, r.chunk): (r.status, r.attempts, r.error_type) for r in out.collect()}
    assert all(got["good", c] == ("completed", 1, None) and got["slow", c] == ("completed", 3, None) for c in range(5))
    assert [got["poor", c][0] for c in range(5)] == ["failed"] + ["fallback"] * 4 and got["poor", 0][2] == "credits_exhausted"
    assert [got["odd", c] for c in range(5)] == [("completed", 1, None)] * 2 + [("failed", 3, "invalid_json")] + [("fallback", 0, None)] * 2


def test_a_restart_asks_each_chunk_once(spark, tmp_path):
    runs.ready(spark)
    log, source, where = str(tmp_path / "log"), str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame(rows(["a", "b"], 12), REQUEST).repartition(3).write.parquet(source)
    made = lambda: runs.run_stream(spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(source), caller(log), json.loads, (Attempt("messages", {}), *retry_ladder(0)), most=2)
    first = runs.drain(made(), *where, 24, stop_at=4, every="6 seconds", idle=30).count()
    assert 4 <= first < 24
    spark.createDataFrame(rows(["a"], 14), REQUEST).write.mode("append").parquet(source)  # two more chunks, twelve again
    out = runs.drain(made(), *where, 26)
    assert collections.Counter((r.model_id, r.chunk) for r in out.collect()) == collections.Counter([("a", c) for c in range(14)] + [("b", c) for c in range(12)])
    assert set(collections.Counter(open(log)).values()) == {1}


def test_many_chunks_a_batch_and_no_limit_while_results_come(spark, tmp_path):
    runs.ready(spark)
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    spark.createDataFrame(rows(["good", "poor"], 1500), REQUEST).coalesce(1).write.parquet(source)
    made = lambda name, **how: (runs.run_stream(spark.readStream.schema(REQUEST).parquet(source), caller(log), json.loads, run_ladder(2), **how), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))
    out = runs.drain(*made("quick", seconds=30), 3000)
    assert collections.Counter((r.model_id, r.status) for r in out.collect()) == {("good", "completed"): 1500, ("poor", "failed"): 1, ("poor", "fallback"): 1499}
    assert len(set(out.select("_metadata.file_name").collect())) <= 4  # in batches of 16 there were 94
    began = time.monotonic()
    assert runs.drain(*made("slow", most=250), 3000, seconds=8, every="3 seconds").count() == 3000 and time.monotonic() - began > 8
