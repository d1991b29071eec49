"""Every query against its DuckDB form over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from lectern import queries_records, queries_runs  # noqa: F401 - they register their queries
from lectern.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def lines(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    cell = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert lines(got, sorted(got.columns)) == lines(want, sorted(got.columns))


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["pose_predictions", "structure_predictions", "effect_predictions"])
def test_wide_rows_of_a_small_file_are_made_by_many_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
