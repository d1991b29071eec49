"""Readers of files. Paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.schemas import TRACKS, case_schema, prediction_schema

SKIPPED = ("predictions", "leaderboard")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped. Strict: a line that isn't an object of the schema fails the query; else its fields are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are strings, empty cells are empty strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a YAML manifest (a list under ``sources``): a small file, parsed on the driver."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    sources = (yaml.safe_load(text) or {}).get("sources")
    if not isinstance(sources, list):
        raise ValueError(f"{path}: sources must be a list")
    names = sorted({k for s in sources for k in s})
    return spark.createDataFrame([[None if s.get(k) is None else (s[k] if isinstance(s[k], str) else str(s[k])) for k in names] for s in sources], ", ".join(f"`{n}` string" for n in names))


def manifest_errors(manifest: DataFrame) -> Column:
    """Messages for a manifest row: known bucket, HTTP url."""
    return F.array_compact(F.array(F.when(~F.col("bucket").isin("A", "B", "C"), "bucket: not in domain"), F.when(~F.col("url").rlike(r"^https?://[^\s/]+"), "url: not an HTTP url")))


def source_by_name(manifest: DataFrame, name: str) -> DataFrame:
    """The source of that name, whatever its case; an error if there is none."""
    found = manifest.where(F.lower("name") == name.lower())
    if found.isEmpty():
        raise KeyError(name)
    return found


def _nothing(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_cases(spark: SparkSession, release: str, track: str) -> DataFrame:
    """Cases of a track; a release without them gives an empty table."""
    path = f"{release}/{track}/cases.jsonl"
    return read_jsonl(spark, path, case_schema(track)) if _exists(spark, path) else _nothing(spark, case_schema(track))


def read_predictions(spark: SparkSession, path: str, track: str) -> DataFrame:
    return read_jsonl(spark, path, prediction_schema(track))


def cases_for_track(spark: SparkSession, release: str, track: str) -> DataFrame:
    """Cases to score; of poses those with computed contacts only, a filter at the scan."""
    cases = read_cases(spark, release, track)
    return cases.where((F.col("contact_label_status") == "computed_contacts") & (F.size("native_contacts") > 0)) if track == "pose" else cases


def read_release(spark: SparkSession, release: str) -> DataFrame:
    """(track, record) of every case file below a release, whether ``cases.jsonl`` is a file or a folder of parts."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{cases.jsonl,part-*}").text(release)
    track = F.regexp_extract("_metadata.file_path", r"/([^/]+)/cases\.jsonl(?:/part-[^/]*)?$", 1)
    return text.where(F.trim("value") != "").select(track.alias("track"), F.col("value").alias("record")).where(F.col("track").isin(*TRACKS))


def benchmark_records(spark: SparkSession, release: str) -> DataFrame:
    """(path, record) of all JSON lines below a release but those of predictions and leaderboards, whether a ``.jsonl`` is a file or a folder of parts."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.jsonl,part-*}").text(release).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record")).where(F.col("path").rlike(r"\.jsonl(/part-[^/]*)?$"))
    for part in SKIPPED:
        text = text.where(~F.array_contains(F.split("path", "/"), part))
    return text.where(F.trim("record") != "")


def read_training(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A training file, or the train, dev and holdout files of a folder."""
    paths = [path] if path.endswith(".jsonl") else [p for p in (f"{path}/{n}.jsonl" for n in ("train", "dev", "holdout")) if _exists(spark, p)]
    return read_jsonl(spark, paths, schema, strict=False) if paths else _nothing(spark, schema)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(path, result) of a JSON file or of the JSON files of a folder, in order of path."""
    where = path if path.endswith(".json") else f"{path}/*.json"
    return read_text(spark, where).withColumnRenamed("text", "result").orderBy("path")


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, model VARIANT) of a model file: a list, or an object with ``data`` or ``models``."""
    v = F.parse_json(F.col("text"))
    listed = F.coalesce(F.try_variant_get(v, "$.models", "array<variant>"), F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return read_text(spark, path).select(F.posexplode(listed).alias("ord", "model"))


def leaderboard_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a leaderboard JSON file; a missing file has none."""
    from lectern.operators.leaderboard import complete

    if not _exists(spark, path):
        return complete(_nothing(spark, "model_id string, mode string"))
    return complete(spark.read.option("multiLine", True).json(path))


def prior_run_counts(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, mode, attempted, completed) of a run manifest's details; the last entry of a pair counts."""
    schema = "details array<struct<model_id:string,mode:string,attempted:bigint,completed:bigint>>"
    if not _exists(spark, path):
        return _nothing(spark, "model_id string, mode string, attempted bigint, completed bigint")
    details = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("details").alias("at", "d"))
    return details.groupBy("d.model_id", "d.mode").agg(F.max_by("d", "at").alias("d")).select("model_id", "mode", "d.attempted", "d.completed")


def read_export(spark: SparkSession, path: str, source: str, release_mode: str = "source_reference_only") -> DataFrame:
    """(source, source_index, record, release_mode) of an export: a JSON list, an object with ``data``, or text lines."""
    if path.endswith(".json"):
        v = F.parse_json(F.col("text"))
        items = F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        rows = read_text(spark, path).select(F.posexplode(items).alias("source_index", "v")).select(F.col("source_index").cast("bigint"), F.to_json("v").alias("record"))
    else:
        rows = read_text(spark, path).select(F.posexplode(F.split("text", r"\r?\n")).alias("source_index", "record")).where(F.trim("record") != "").select(F.col("source_index").cast("bigint"), "record")
    return rows.select(F.lit(source).alias("source"), "source_index", "record", F.lit(release_mode).alias("release_mode"))


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(path, chain, residue, x, y, z) of fixed-width atom lines; lines without coordinates are skipped, a blank chain is ``_``."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    at = lambda a, n: F.trim(F.substring("v", a, n))
    chain = F.coalesce(F.nullif(at(22, 1), F.lit("")), F.lit("_"))
    atoms = text.where(F.col("v").startswith("ATOM  ") | F.col("v").startswith("HETATM")).select("path", chain.alias("chain"), F.concat(chain, F.lit(":"), at(23, 4)).alias("residue"), *[at(a, 8).try_cast("double").alias(n) for a, n in ((31, "x"), (39, "y"), (47, "z"))])
    return atoms.where("x is not null and y is not null and z is not null")
