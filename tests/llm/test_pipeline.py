from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import queries, secrets
from tests.llm import plain
from tests.llm.conftest import prose
from tests.llm.test_operators import check_packing


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus of clean, junk, copied, leaking and secret-bearing documents, written as the driver's tables are."""
    rng = random.Random(21)
    items = [(i, prose(rng, 30, 300)) for i in range(3)]
    clean = {i: prose(rng, 80, 300) for i in range(120)}
    junk = {150 + i: " ".join(w.upper() + "!!" for w in prose(rng, 60, 300).split()) for i in range(15)}
    copies = {200 + i: clean[i] if i % 2 else clean[i].replace(clean[i].split()[40], "edit", 1) for i in range(10)}
    leaks = {300 + i: prose(rng, 30, 300) + " " + items[i][1] for i in range(3)}
    keys = {400: prose(rng, 400, 300) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(rng, 40, 300)}
    odd = {500: None, 501: ""}
    texts = {**clean, **junk, **copies, **leaks, **keys, **odd}
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(150 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, texts, {**clean, **keys, **odd}


def test_pipeline_against_the_plain_version(spark, corpus):
    where, texts, kept = corpus
    groups = plain.near(list(texts.items()))
    left = {d: t for d, t in kept.items() if groups[d][1] == d}
    left[400] = left[400].replace('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff', secrets.MARK)
    found = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in found} == set(left)
    check_packing(found, left, 4096)


def test_stages_keep_the_columns(spark, corpus):
    where, _, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_repeated_rows_count_once(spark, corpus):
    where, _, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    twice = docs.unionByName(docs.where(F.col("doc_id") == 0))
    out = corpus_pipeline.drop_near_duplicates(spark, twice, where)
    assert out.where("doc_id = 0").count() == 1


def test_rows_of_odd_tables_pass_every_stage(spark, corpus):
    """Null and repeated ids, repeated ids of unequal texts, further columns with clashing names."""
    where, texts, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = ["kept", "found", "hex", "m", "t", "c0", "d", "digest", "n", "nth", "row", "mean"]
    more = [(None, texts[0]), (None, texts[300]), (7, texts[0]), (7, texts[301]), (7, texts[2]), (400, texts[400])]
    wide = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in more], docs.schema)).select("*", *[F.lit("x").alias(c) for c in names])
    out = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, where)
        assert out.columns == wide.columns, name
    got = {(r.doc_id, r.text) for r in out.where("doc_id is null or doc_id in (0, 2, 7, 300, 301, 400)").collect()}
    secret = texts[400].replace('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff', secrets.MARK)
    assert got == {(0, texts[0]), (2, texts[2]), (7, texts[7]), (None, texts[0]), (400, secret)}
    assert out.where("doc_id = 400").count() == 1


def test_empty_tables_pass_every_stage(spark, corpus):
    where, _, _ = corpus
    out = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, where)
        assert out.count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    import glob
    import os

    import duckdb

    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for p in glob.glob(f"{where}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries.QUERIES[name](spark, where).collect()
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    rows = [tuple(str(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall()]
    assert sorted(got[0].asDict()) == columns and sorted(tuple(str(r[c]) for c in columns) for r in got) == sorted(rows)


def test_registered_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
