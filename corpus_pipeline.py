"""The corpus pipeline: five stages, each over all that its predecessor kept.

1. quality: documents that the Kneser-Ney classifier rejects go.
2. near_duplicates: one document of each group of near-duplicates stays.
3. decontamination: documents that hold a copy of a benchmark item go.
4. secrets: found secrets are replaced in the texts.
5. packing: what is left is packed into sequences of 4,096 tokens.

Between stages the documents are a Parquet table in the shared folder, so a lost
executor costs no earlier stage. All stages but the last return the columns of
``documents``, further ones included, whatever their names. Every stage judges a
row by its own text: rows that share an id can fare differently. Rows that repeat
an id and a text count once after stage 2; a row with a null id links with
nothing there. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, near, packing, quality, secrets
from lectern.llm.queries import table
from lectern.llm.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the quantiles of their language. Null and empty texts stay; a score that equals a threshold stays."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays; texts without words and rows with a null id link with nothing."""
    return near.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item. An empty benchmark, null and empty texts drop nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in the texts and n_chars with them; a null text stays null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece with its place in a sequence; a null text is an end token alone, rows that share an id are documents of their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Likelihood filters, alignment and tokenization have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
