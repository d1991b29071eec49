"""Bloom filters before exact joins, and distance joins in crowded cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import bloom, splits, structure


def test_filters_deny_nothing_that_was_added(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("v"), F.lit("a").alias("kind"))
    bits = bloom.size(5000)
    halves = [bloom.words(keys.where(F.col("v").endswith("7") == odd), ["kind", "v"], bits) for odd in (True, False)]
    inside = bloom.contains(bloom.merge(*halves), bits)
    assert keys.where(~inside(F.col("kind"), F.col("v"))).count() == 0
    others = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("v"))
    assert others.where(inside(F.lit("a"), F.col("v"))).count() < 600 and keys.where(inside(F.lit("b"), F.col("v"))).count() < 150
    none = bloom.contains(bloom.words(keys.limit(0), ["kind", "v"], bloom.size(0)), bloom.size(0))
    assert others.where(none(F.lit("a"), F.col("v"))).count() == 0


def test_leakage_shuffles_candidates_only(spark):
    train = spark.range(20000).select(F.concat(F.lit("b"), "id").alias("benchmark_id"), F.array(F.struct(F.concat(F.lit("i"), F.col("id") + 7).alias("item_id"))).alias("items"), F.sha2(F.col("id").cast("string"), 256).alias("record_hash"))
    bench = spark.range(19990, 20050).select(F.concat(F.lit("b"), "id").alias("benchmark_id"), F.lit("test").alias("split"), F.sha2(F.col("id").cast("string"), 256).alias("case_hash"), F.lit(" i9 ").alias("item_id"))
    held = splits.values_under(bench, splits.ID_KEYS, "identifier").unionByName(splits.values_under(bench, splits.HASH_KEYS, "hash"))
    assert splits.leakage_candidates(train, held).count() < 21 + 60000 * 0.02
    got = sorted((r.kind, r.value) for r in splits.leakage(train, bench).collect())
    want = [("identifier", f"b{i}") for i in range(19990, 20000)] + [("identifier", "i9")]
    assert [g for g in got if g[0] == "identifier"] == sorted(want) and len([g for g in got if g[0] == "hash"]) == 10
    assert splits.leakage(train, bench.withColumn("split", F.lit("train"))).count() == 0
    assert splits.leakage(train.select("items"), bench.select(F.col("split").alias("other"))).count() == 0


@pytest.mark.parametrize("spread", [0.5, 30.0])
def test_contacts_in_crowded_cells(spark, spread):
    rng = np.random.default_rng(6)
    make = lambda n, p: [(f"{p}{i % (n // 3)}", *map(float, xyz)) for i, xyz in enumerate(np.concatenate([rng.normal(2, 0.4, (n // 2, 3)), rng.normal(0, spread, (n // 2, 3)), np.full((20, 3), 1.0)]))]
    left, right = make(240, "a"), make(300, "b")
    want = {}
    for r, *p in left:
        for s, *q in right:
            d = float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()))
            if d <= 5:
                want[r, s] = min(d, want.get((r, s), 9.0))
    frames = [spark.createDataFrame(x, "residue string, x double, y double, z double") for x in (left, right)]
    for part in (16, 10_000):
        got = {(r.residue, r.other_residue): r.distance for r in structure.contacts(*frames, part=part).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-4 for k in want)
    assert structure.contacts(frames[0], frames[1].limit(0)).count() == 0


def test_first_contacts_of_a_hot_pair(spark):
    found = spark.range(5000).select(F.lit("k").alias("k"), F.format_string("r%05d", (F.col("id") * 7 % 5000).cast("int")).alias("residue"), F.lit("o").alias("other_residue"), F.lit(1.0).alias("distance"))
    got = structure.contact_list(found, ("k",)).first().native_contacts
    assert [c.target_residue for c in got] == [f"r{i:05d}" for i in range(200)]


def test_copies_of_residues_are_met_once(spark):
    rng = np.random.default_rng(3)
    make = lambda n, p: [(f"{p}{i}", *map(float, at)) for i in range(n) for at in rng.integers(0, 4, (1 + i % 3, 3)) * 2.5]
    left, right = make(120, "a"), make(150, "b")
    least = {}
    for r, *p in left:
        for s, *q in right:
            d = float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()))
            if d <= 5:
                least[r, s] = min(d, least.get((r, s), 9.0))
    want = {r: (sum(k[0] == r for k in least), min(d for k, d in least.items() if k[0] == r)) for r in {k[0] for k in least}}
    frames = [spark.createDataFrame(x, "residue string, x double, y double, z double") for x in (left, right)]
    got = {r.residue: (r.n, r.nearest) for r in structure.contact_counts(*frames, part=16).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 6e-4 for k in want)


def test_a_billion_pairs_of_copies(spark):
    atoms = lambda n, p: spark.range(n).select(F.concat(F.lit(p), "id").alias("residue"), (F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = structure.contact_counts(atoms(40_000, "a"), atoms(40_000, "b"), cutoff=1.0).groupBy("n", "nearest").count().collect()
    assert sorted(tuple(r) for r in out) == [(20_000, 0.0, 20_000), (30_000, 0.0, 20_000)]
