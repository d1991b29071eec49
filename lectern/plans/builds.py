"""Whole builds: a release written from cases, and its lists and counts rebuilt from what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import release
from lectern.operators.keys import union_all, with_order
from lectern.schemas import CASE_BASE, TRACKS, case_schema
from lectern.sinks.files import write_jsonl
from lectern.sources.files import read_cases


def write_release(cases: dict[str, DataFrame], root: str) -> DataFrame:
    """Write the cases of each track below ``root``, then everything that follows from them; returns (track, n)."""
    for track, df in cases.items():
        write_jsonl(df, f"{root}/{track}/cases.jsonl")
    spark = next(iter(cases.values())).sparkSession
    return rebuild(spark, root)


def rebuild(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """References, source status and counts of the release at ``root``, from its cases; a release without cases becomes an empty skeleton with every file. Returns (track, n)."""
    common = [f.split()[0] for f in ("benchmark_id", "track", "release_mode", "source_database", "source_id", "source_url", "citation", "scoring_subset", "split")]
    assert all(c in CASE_BASE for c in common)
    cases = union_all(*[with_order(read_cases(spark, root, t)).select(*common, "redistribution_policy_snapshot") for t in TRACKS]).withColumn("track", F.coalesce("track", F.lit("unknown"))).persist()
    try:
        for name, df in release.references(cases).items():
            write_jsonl(df, f"{root}/references/{name}.jsonl")
        sources = manifest if manifest is not None else cases.select(F.col("source_database").alias("name")).distinct()
        write_jsonl(release.status_grid(sources, cases, cases.where("release_mode = 'excluded'")), f"{root}/source_status_report.jsonl")
        tracks = spark.createDataFrame([(t,) for t in TRACKS], "track string")
        counts = tracks.join(cases.groupBy("track").agg(F.count(F.lit(1)).alias("n")), "track", "left").na.fill(0, ["n"])
        write_jsonl(counts, f"{root}/release_metadata_summary.json")
        for track in TRACKS:
            if read_cases(spark, root, track).isEmpty():
                write_jsonl(spark.createDataFrame([], case_schema(track)), f"{root}/{track}/cases.jsonl")
        return spark.read.schema("track string, n bigint").json(f"{root}/release_metadata_summary.json")
    finally:
        cases.unpersist()
