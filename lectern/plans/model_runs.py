"""Model runs: chunked calls with pauses, a ladder of ever simpler requests, failing over, and resuming.

The model is a function (model_id, messages as JSON, options) -> text. What is
asked how often is data (``Attempt``), so every run and retry is the same loop.
Requests of one model, mode and track are one group in their order, because a
provider that fails for good is not asked again: the rest of its chunks get the
fallback. Groups run beside one another; Python holds a batch of a group's rows,
not the group.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.keys import without
from lectern.sources.adapters import OutOfCredits

Caller = Callable[[str, str, dict], str]
GROUP = ["model_id", "mode", "track"]
RESULT = "model_id string, mode string, track string, chunk bigint, benchmark_ids array<string>, text string, status string, attempts int, error_type string, error_message string"


class Attempt(NamedTuple):
    """One way to ask: which messages column, what options, how often."""

    messages: str
    options: dict
    times: int = 1


# Waits of 1, 2, 4 seconds and so on, 30 at most.
FIRST_WAIT, MOST_WAIT = 1.0, 30.0


def run_ladder(retries: int) -> tuple[Attempt, ...]:
    """A run asks for JSON as often as ``retries`` allows."""
    return (Attempt("messages", {"response_format": "json_object"}, retries + 1),)


def retry_ladder(retries: int) -> tuple[Attempt, ...]:
    """A retry asks for JSON, then without a format, then with the compact messages."""
    return (Attempt("messages", {"response_format": "json_object"}, retries + 1), Attempt("messages", {}, 1), Attempt("compact", {}, 1))


def error_type(error: Exception) -> str:
    return "credits_exhausted" if isinstance(error, OutOfCredits) else "invalid_json" if isinstance(error, ValueError) else "api_error"


def ask(caller: Caller, check: Callable[[str], None], model: str, row: dict, ladder: tuple[Attempt, ...], wait: Callable[[float], None] = time.sleep) -> tuple[str | None, int, Exception | None]:
    """(text, attempts, last error): the first answer that passes ``check``. Out of credits ends the ladder."""
    tries, last = 0, None
    for attempt in ladder:
        if row.get(attempt.messages) is None:
            continue
        for _ in range(attempt.times):
            if tries:
                wait(min(MOST_WAIT, FIRST_WAIT * 2 ** (tries - 1)))
            tries += 1
            try:
                text = caller(model, row[attempt.messages], attempt.options)
                check(text)
                return text, tries, None
            except OutOfCredits as e:
                return None, tries, e
            except Exception as e:  # the ladder goes on
                last = e
    return None, tries, last


def run_tracks(requests: DataFrame, caller: Caller, check: Callable[[str], None], ladder: tuple[Attempt, ...], done: DataFrame | None = None, fail_over: bool = True, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Results of ``requests`` (model_id, mode, track, chunk, benchmark_ids, messages, compact: JSON texts).

    Status is completed, failed (asked in vain) or fallback (not asked, since a
    chunk before it failed for good). Chunks that ``done`` has are skipped.
    """
    todo = without(requests, done, [*GROUP, "chunk"]) if done is not None else requests
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, down = None, False
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if group != (group := tuple(row[c] for c in GROUP)):
                    down = False
                text, tries, error = (None, 0, None) if down else ask(caller, check, row["model_id"], row, ladder, wait)
                status = "completed" if text is not None else "fallback" if down else "failed"
                down = down or (fail_over and text is None)
                out.append([*group, *(row[c] for c in ("chunk", "benchmark_ids")), text, status, tries, error_type(error) if error else None, f"{type(error).__name__}: {error}"[:300] if error else None])
            yield pd.DataFrame(out, columns=names)

    return todo.repartition(*GROUP).sortWithinPartitions(*GROUP, "chunk").mapInPandas(run, RESULT)


def requests_for(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every model, mode and track (``models``) with the chunks of its mode and track (``prompts``: mode, track, chunk, benchmark_ids, messages, compact)."""
    return models.select(*GROUP).join(prompts, ["mode", "track"])


def blocked(models: DataFrame, reason: str, details: str = "") -> DataFrame:
    """Result rows of runs that couldn't start."""
    return models.select(*GROUP, F.lit("blocked").alias("status"), F.lit(reason).alias("reason"), F.lit(details).alias("details"), F.lit(0).alias("attempted"), F.lit(0).alias("completed"), F.lit(False).alias("competitive"))


def sampled(prompts: DataFrame, caller: Caller, reason: Callable[[str], str | None], most_tokens: dict[str, int], default: int = 1024) -> DataFrame:
    """(prompt_id, text, attempts, degenerate): one answer a prompt (prompt_id, model_id, task_type, messages), asked once more where it is degenerate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                limit = next((n for word, n in most_tokens.items() if word in row["task_type"]), default)
                for attempt in (1, 2):
                    text = caller(row["model_id"], row["messages"], {"max_tokens": limit})
                    why = reason(text)
                    if why is None:
                        break
                out.append((row["prompt_id"], text, attempt, why))
            yield pd.DataFrame(out, columns=["prompt_id", "text", "attempts", "degenerate"])

    return prompts.select("prompt_id", "model_id", "task_type", "messages").mapInPandas(run, "prompt_id string, text string, attempts int, degenerate string")
