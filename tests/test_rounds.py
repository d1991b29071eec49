"""Reading in rounds: no more than is needed, and all that is."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.plans import rounds
from lectern.sources import paged


@pytest.fixture
def stored(spark, tmp_path):
    spark.range(10000).select(F.col("id").alias("ord"), (F.col("id") % 7).alias("v")).coalesce(1).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_stops_when_enough_are_accepted(stored):
    got = rounds.until(rounds.of_table(stored), lambda df: df.where("v = 3"), 50, 100, length=10000)
    assert [r["ord"] for r in got.rows.collect()] == [3 + 7 * i for i in range(50)] and (got.read, got.rounds) == (700, 3)


@pytest.mark.parametrize("length", [10000, None])
def test_a_source_that_runs_out(stored, length):
    got = rounds.until(rounds.of_table(stored), lambda df: df.where("v = 9"), 5, 3000, length=length)
    assert got.rows.count() == 0 and got.read == 10000
    assert rounds.until(rounds.of_table(stored), lambda df: df, 0) is None


def test_rounds_decide_which_pages_are_read(spark, tmp_path):
    log = str(tmp_path / "asked")

    def fetch(url, body, timeout):
        page = json.loads(body)["request_options"]["paginate"]
        with open(log, "a") as f:
            f.write(f"{page['start']}\n")
        return json.dumps({"total_count": 5000, "result_set": [{"identifier": f"E{i}"} for i in range(page["start"], page["start"] + page["rows"])]})

    def pages(begin, end):
        return paged.search(spark, "rcsb_text", ["peptide"], end, 50, fetch).where(F.col("ord") >= begin)

    got = rounds.until(pages, lambda df: df.where("ord % 5 = 0"), 40, 100)
    assert [r["ord"] for r in got.rows.collect()] == list(range(0, 200, 5)) and got.read == 300
    assert sorted(int(x) for x in open(log)) == [0, 50, 100, 150, 200, 250]
