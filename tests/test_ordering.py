"""Positions, running sums and the seeded stream against plain ones, with payload columns and other partition counts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import mersenne
from lectern.operators import builders, large_panels, ordering, ranking


@pytest.fixture(params=[4, 200])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(spark, n=15000):
    k = (F.col("id") * 7919) % n
    return spark.range(0, n, 1, 7).select(k.alias("k"), F.when(k % 3 == 0, "hot").otherwise((k % 40).cast("string")).alias("g"), F.repeat(F.lit("x"), (k % 5).cast("int")).alias("payload"), (k % 9).alias("w"))


def test_positions_with_payload(spark, parts):
    got = ordering.positions(rows(spark), ["k"]).toPandas().sort_values("k")
    assert got.position.tolist() == list(range(15000)) and got.payload.str.len().tolist() == [k % 5 for k in range(15000)]


def test_running_sums(spark, parts):
    got = ordering.running(rows(spark), ["k"], "before", F.col("w")).toPandas().sort_values("k")
    assert got.before.tolist() == (np.cumsum(got.w) - got.w).tolist()


def test_positions_within_groups_of_any_size(spark, parts):
    got = ordering.positions_within(rows(spark), "g", ["k"]).toPandas().sort_values(["g", "k"])
    assert got.position.tolist() == got.groupby("g").cumcount().tolist()
    one = ordering.positions_within(rows(spark).withColumn("g", F.lit(1)), "g", ["k"]).toPandas().sort_values("k")
    assert one.position.tolist() == list(range(15000))


def test_nulls_ties_nested_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1.5), ("b", 2.5), (None, 0.5), ("b", 2.5), ("a", float("nan"))], "s string, x double").withColumn("both", F.struct("s", F.struct("x").alias("in")))
    got = ordering.positions(df, ["both"], parts=3).orderBy("position").collect()
    assert [r.position for r in got] == [0, 1, 2, 3, 4] and [r.s for r in got] == [None, None, "a", "b", "b"] and got[0].x == 0.5
    assert ordering.positions(df.limit(0), ["both"]).collect() == [] == ordering.positions_within(df.na.fill("", ["s"]).limit(0), "s", ["x"]).collect()
    times = spark.range(500).select((F.timestamp_micros(F.col("id") * 7 + 1600000000000000)).alias("t"))
    assert [r.position for r in ordering.positions(times, ["t"], parts=60).orderBy("t").collect()] == list(range(500))


def test_jumps_land_in_the_stream():
    rng = random.Random(21)
    want = [rng.random() for _ in range(120000)]
    stream = mersenne.Stream(21)
    for at in (0, 3, 623, 39000, 40000, 99999):
        assert stream.draw(at, 5).tolist() == want[at : at + 5] and stream.draw(at + 5, 2).tolist() == want[at + 5 : at + 7]
    far = mersenne.jump(stream.first, 10**13)
    assert (mersenne.sequence(far, 700)[700:][1:] == mersenne.jump(stream.first, 10**13 + 700)[1:]).all()


def test_scores_of_many_cases(spark, parts):
    cases = rows(spark, 6000).select(F.col("k").cast("string").alias("benchmark_id"), F.col("k").alias("ord"), F.lit("binding_rank").alias("track"), F.when(F.col("k") % 7 > 0, F.transform(F.sequence(F.lit(0), (F.col("k") % 4).cast("int")), lambda i: F.struct(i.cast("string").alias("item_id")))).alias("items"))
    rng = random.Random(13)
    want = {str(k): [rng.random() for _ in range(k % 4 + 1)] if k % 7 else [] for k in range(6000)}
    assert {r.benchmark_id: [s.score for s in r.scores] for r in builders.baseline(cases, "binding_rank").collect()} == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 1000])
def test_inversions(n):
    x = np.random.default_rng(n).integers(0, 50, n)
    assert large_panels.inversions(x) == int((x[:, None] > x[None, :])[np.triu_indices(n, 1)].sum())


def test_large_panels_equal_small_ones(spark):
    rng = np.random.default_rng(3)
    data = [("a", int(i), float(rng.integers(0, 40)), float(rng.normal())) for i in range(900)] + [("b", int(i), float(i % 3), float(i % 7)) for i in range(700)] + [(None, int(i), float(i), float(-i)) for i in range(300)]
    data += [("c", 1, 1.0, 2.0), ("c", 2, 1.0, 2.0), ("d", 1, 5.0, 5.0), ("same", 1, 1.0, 1.0)] + [("same", i, 1.0, float(i)) for i in range(2, 60)]
    df = spark.createDataFrame(data, "panel string, item int, gold double, pred double").repartition(5)
    rounded = lambda out: sorted((str(r.panel), r.n, round(r.spearman, 9), r.concordant or 0, r.discordant or 0, round(r.kendall_tau, 9), r.top_enrichment) for r in out.collect())
    want = rounded(ranking.panel_metrics(df.na.fill("none", ["panel"]), ["panel"], k=5))
    assert rounded(ranking.panel_metrics(df.na.fill("none", ["panel"]), ["panel"], k=5, large=50)) == want
    counts = lambda rows: sorted((str(r.panel), r.concordant, r.discordant) for r in rows.collect())
    assert counts(large_panels.pairs(df, ["panel"], block=64)) == counts(ranking.pair_metrics(df, ["panel"]))
    assert rounded(ranking.panel_metrics(df.limit(0), ["panel"])) == []


def test_repeated_rows_of_large_panels_are_cells(spark):
    rng = np.random.default_rng(8)
    few = [(p, None if i % 50 == 0 else float(rng.integers(0, 12)), None if i % 70 == 0 else float(rng.integers(0, 60) if p == "a" else rng.integers(0, 400))) for p in "ab" for i in range(500)]
    df = spark.createDataFrame([(p, j * 500 + i, g, q) for j in range(6) for i, (p, g, q) in enumerate(few)], "panel string, item int, gold double, pred double")
    assert large_panels.ranked_cells(df, ["panel"]).count() == len(set(few))
    counts = lambda rows: sorted((r.panel, r.concordant, r.discordant) for r in rows.collect())
    want = counts(ranking.pair_metrics(df, ["panel"]))
    assert counts(large_panels.pairs(df, ["panel"], block=64)) == counts(large_panels.pairs(df, ["panel"], block=700)) == want
    rounded = lambda out: sorted((r.panel, round(r.spearman, 9), r.top_enrichment, r.n) for r in out.collect())
    for k in (7, 5900):
        assert rounded(ranking.panel_metrics(df, ["panel"], k=k, large=100)) == rounded(ranking.panel_metrics(df, ["panel"], k=k))


def test_small_panels_lie_in_partitions_of_bounded_size(spark, monkeypatch):
    df = spark.range(20000).select(F.floor(F.col("id") / 4).alias("panel"), F.col("id").alias("item"), (F.col("id") % 7).alias("gold"), (F.col("id") % 5).alias("pred"))
    monkeypatch.setattr(ranking, "ROWS", 1000, raising=False)
    for measure in (ranking.spearman, ranking.pair_metrics, ranking.top_k):
        assert measure(df, ["panel"]).rdd.getNumPartitions() >= 20
