"""Workflows composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import leaderboard, qc, release
from lectern.operators.evidence import evaluate_human_effect
from lectern.operators.keys import without
from lectern.operators.ranking import evaluate_binding_rank
from lectern.operators.structure import evaluate_pose, evaluate_structure

EVALUATORS = {"human_effect": evaluate_human_effect, "binding_rank": evaluate_binding_rank, "pose": evaluate_pose, "structure": evaluate_structure}


def evaluate(track: str, cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of metrics with the numbers of cases and predictions."""
    out = EVALUATORS[track](cases, predictions)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return out.withColumns({"n_cases": count(cases), "n_predictions": count(predictions), "track": F.lit(track)})


def long_metrics(result: DataFrame) -> DataFrame:
    """(track, metric, value, status): metrics as rows, those without a value as not_computed."""
    names = [c for c in result.columns if c not in ("track", "n_cases", "n_predictions")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")
    return result.select("track", pairs).select("track", "m.metric", "m.value", F.when(F.col("m.value").isNull(), "not_computed").otherwise("computed").alias("status"))


def missing_predictions(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    return without(cases.select("benchmark_id"), predictions, ["benchmark_id"])


def quality_control(cases: DataFrame) -> dict[str, DataFrame]:
    """Checked cases, exclusions, cards and metadata of a release: both passes run once."""
    checked = qc.check_records(cases).persist()
    kept, card = qc.apply_qc(checked), qc.cards(checked)
    return {"cases": kept, "excluded": qc.excluded_log(checked), "cards": card, "metadata": release.metadata(kept, card), "checked": checked}


def leaderboard_from_results(results: DataFrame) -> DataFrame:
    return leaderboard.public_rows(leaderboard.rows_from_results(results))


def call_models(prompts: DataFrame, caller: Callable[[str, str], str], done: DataFrame | None = None, key: str = "benchmark_id", retries: int = 2) -> DataFrame:
    """Answers (key, text, error) of an injected model function (model_id, messages JSON) -> text.

    Rows that ``done`` has are skipped, so a run resumes. A row is tried
    ``retries`` times more; what still fails is a row with the error.
    """
    todo = without(prompts, done, ["model_id", key]) if done is not None else prompts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for model, messages in zip(b["model_id"], b["messages_json"], strict=True):
                text = error = None
                for _ in range(retries + 1):
                    try:
                        text, error = caller(model, messages), None
                        break
                    except Exception as e:  # the row keeps the reason
                        error = f"{type(e).__name__}: {e}"[:300]
                texts.append(text)
                errors.append(error)
            yield b[["model_id", key]].assign(text=texts, error=errors)

    return todo.withColumn("messages_json", F.to_json("messages")).select("model_id", key, "messages_json").mapInPandas(run, f"model_id string, {key} {dict(prompts.dtypes)[key]}, text string, error string")
