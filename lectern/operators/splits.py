"""Splits and leakage between training and evaluation data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import token_estimate
from lectern.functions.text import answer_like
from lectern.operators.bloom import contains, size, words
from lectern.operators.ordering import positions

ID_KEYS = ("benchmark_id", "case_id", "source_id", "source_ids", "panel_id", "target_id", "item_id")
HASH_KEYS = ("processed_record_hash", "source_record_hash", "record_hash", "case_hash", "hash")
EVAL_SPLITS = ("test", "dev", "validation", "valid", "eval", "holdout")


def split_by_position(position: Column) -> Column:
    """7 of 10 rows train, 2 dev, 1 test."""
    at = position % 10
    return F.when(at < 7, "train").when(at < 9, "dev").otherwise("test")


def case_split(hint: Column) -> Column:
    """Train, dev, test in turn."""
    return F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (hint % 3 + 1).cast("int"))


def seeded_split(df: DataFrame, key: str, seed: int = 7, dev: float = 0.1, holdout: float = 0.1) -> DataFrame:
    """Adds ``split``: rows in a seeded order (SHA-256 of seed and key), of which the first share is dev, the next holdout, each of the exact size."""
    mixed = df.withColumn("_mixed", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    n = df.count()
    first, second = int(n * dev), int(n * holdout)
    at = F.col("_at")
    return positions(mixed, ["_mixed", key], "_at").withColumn("split", F.when(at < first, "dev").when(at < first + second, "holdout").otherwise("train")).drop("_mixed", "_at")


def is_eval(split: Column) -> Column:
    """Evaluation row; a row without a split is one."""
    return F.coalesce(F.nullif(F.lower(F.trim(split)), F.lit("")), F.lit("test")).isin(*EVAL_SPLITS)


def _values(df: DataFrame, keys: tuple[str, ...]) -> Column | None:
    """Array of the named fields' values wherever the schema has them: top level, structs, arrays of either."""
    found: list[Column] = []

    def walk(t, path: Column, name: str | None) -> None:
        if t.typeName() == "struct":
            for f in t.fields:
                walk(f.dataType, path[f.name], f.name)
        elif t.typeName() == "array":
            e = t.elementType
            if e.typeName() == "struct":
                for f in e.fields:
                    if f.dataType.typeName() not in ("struct", "array") and f.name.lower() in keys:
                        found.append(F.transform(path[f.name], lambda x: F.trim(x.cast("string"))))
            elif name and name.lower() in keys:
                found.append(F.transform(path, lambda x: F.trim(x.cast("string"))))
        elif name and name.lower() in keys:
            found.append(F.array(F.trim(path.cast("string"))))

    for f in df.schema.fields:
        walk(f.dataType, F.col(f"`{f.name}`"), f.name)
    return F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in found]) if found else None


def values_under(df: DataFrame, keys: tuple[str, ...], kind: str, only: Callable[..., Column] | None = None) -> DataFrame:
    """Distinct (kind, value) of the named fields; with ``only`` (a filter of (kind, value)) those alone that it lets through, before anything is exploded or shuffled."""
    values = _values(df, keys)
    if values is None:
        return df.sparkSession.createDataFrame([], "kind string, value string")
    wanted = F.filter(values, lambda v: v.isNotNull() & (v != "") & (F.lit(True) if only is None else only(F.lit(kind), v)))
    return df.select(F.lit(kind).alias("kind"), F.explode(wanted).alias("value")).distinct()


def leakage_candidates(train: DataFrame, held: DataFrame) -> DataFrame:
    """(kind, value) of training rows that a Bloom filter of ``held`` (kind, value) lets through: all that are shared, and few others."""
    bits = size(held.count())
    only = contains(words(held, ["kind", "value"], bits), bits)
    return values_under(train, ID_KEYS, "identifier", only).unionByName(values_under(train, HASH_KEYS, "hash", only))


def leakage(train: DataFrame, bench: DataFrame) -> DataFrame:
    """(kind, value) of identifiers and hashes that training and evaluation rows share; rows of other splits of ``bench`` don't count.

    Training rows are filtered where they are read; only candidates meet the evaluation rows' values.
    """
    part = bench.where(is_eval(F.col("split"))) if "split" in bench.columns else bench
    held = values_under(part, ID_KEYS, "identifier").unionByName(values_under(part, HASH_KEYS, "hash"))
    return leakage_candidates(train, held).join(held, ["kind", "value"], "left_semi")


def leakage_report(train: DataFrame, bench: DataFrame, prompt: str = "messages") -> DataFrame:
    """One row: overlaps by kind, prompts that name gold fields, the first 200 overlaps, 20 of them as examples, and whether all is well."""
    text = F.to_json(F.col(prompt)) if prompt in train.columns and dict(train.dtypes)[prompt].startswith(("array", "struct")) else (F.col(prompt) if prompt in train.columns else F.to_json(F.struct(*train.columns)))
    answers = train.agg(F.count_if(answer_like(text)).alias("answer_like_count"), F.count(F.lit(1)).alias("train_record_count"))
    shared = leakage(train, bench)
    top = F.slice(F.array_sort(F.collect_set("value")), 1, 200)
    few = shared.orderBy("value").limit(200).agg(top.alias("overlaps"))
    counts = shared.agg(F.count_if(F.col("kind") == "identifier").alias("identifier_overlap_count"), F.count_if(F.col("kind") == "hash").alias("exact_hash_overlap_count"), F.countDistinct("value").alias("overlap_count"))
    out = counts.select("*", *[answers.select(c).scalar().alias(c) for c in answers.columns], few.scalar().alias("overlaps")).withColumn("examples", F.slice("overlaps", 1, 20))
    return out.withColumn("passed", (F.col("overlap_count") == 0) & (F.col("answer_like_count") == 0))


def cost_estimate(df: DataFrame, text: str, epochs: int = 1, price_per_million: float = 0.0, expansion: float = 1.0, cap: float | None = None) -> DataFrame:
    """One row: tokens (a quarter of the characters, one at least a row), tokens trained on and their price, and whether it stays under a cap."""
    out = df.agg(F.sum(token_estimate(F.col(text))).alias("tokens")).withColumn("trained_tokens", F.col("tokens") * expansion * epochs).withColumn("cost", F.col("trained_tokens") / 1e6 * price_per_million)
    return out.withColumn("under_cap", F.lit(True) if cap is None else F.col("cost") <= cap)
