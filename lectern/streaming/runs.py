"""Model runs as keyed state: requests come as a stream, every model, mode and track is a key with its own queue.

The state of a key is what is open (a chunk with how often it was asked), what is
done, whether its provider is down, and until when it pauses. A pause is a timer,
so a key that waits holds no task. A batch asks ``most`` chunks a key, and goes on
for the ``seconds`` it is given where they are answered sooner: what a lost batch
asks again has that bound, what a finished one asked is never asked again,
however often the query is restarted from its checkpoint.

Chunks of a key are asked in their order, one after the other. Status is as in
``model_runs``: completed, failed (asked in vain) or fallback (not asked, since
one before it failed for good).

Defined cases: a chunk that comes again, done or open, is ignored; a chunk behind
one that is already done is asked when it comes; requests without the messages of
a rung skip it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.plans.model_runs import FIRST_WAIT, GROUP, MOST_WAIT, RESULT, Attempt, Caller, error_type
from lectern.sources.adapters import OutOfCredits

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = 1000  # results handed on at once
OPEN = "benchmark_ids array<string>, messages string, compact string, tries int"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


class Run(StatefulProcessor):
    """The queue of one model, mode and track."""

    def __init__(self, caller: Caller, check: Callable[[str], None], ladder: tuple[Attempt, ...], fail_over: bool, most: int, first_wait: float, seconds: float = 0):
        self.caller, self.check, self.ladder, self.fail_over, self.most, self.first_wait, self.seconds = caller, check, ladder, fail_over, most, first_wait, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "chunk bigint", OPEN)
        self.done = handle.getMapState("done", "chunk bigint", "status string")
        self.down = handle.getValueState("down", "down boolean")
        self.pause = handle.getValueState("pause", "until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for b in rows:
            for r in b.to_dict("records"):
                chunk = (int(r["chunk"]),)
                if not self.done.containsKey(chunk) and not self.open.containsKey(chunk):
                    self.open.updateValue(chunk, (list(r["benchmark_ids"]), r["messages"], r["compact"], 0))
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.pause.exists() or self.pause.get()[0] <= now:
            yield from self._advanced(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._advanced(key, timerValues.getCurrentProcessingTimeInMs())

    def _later(self, until: int) -> None:
        self.pause.update((until,))
        self.handle.registerTimer(until)

    def _advanced(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        out, asked, down, began = [], 0, self.down.exists(), time.monotonic()
        self.pause.clear()
        for (chunk,) in sorted(tuple(k) for k in list(self.open.keys())):
            ids, messages, compact, tries = self.open.getValue((chunk,))
            text, error, status = None, None, "fallback"
            if not down:
                if asked >= self.most and time.monotonic() - began >= self.seconds:
                    self._later(now + 1)
                    break
                ways = [a for a in self.ladder for _ in range(a.times) if {"messages": messages, "compact": compact}[a.messages] is not None]
                try:
                    way = ways[tries]
                    asked += 1
                    text = self.caller(key[0], {"messages": messages, "compact": compact}[way.messages], way.options)
                    self.check(text)
                    status = "completed"
                except Exception as e:  # the ladder goes on, but for credits
                    text, error, status = None, e, "failed"
                tries += 1
                if status == "failed" and tries < len(ways) and not isinstance(error, OutOfCredits):
                    self.open.updateValue((chunk,), (ids, messages, compact, tries))
                    self._later(now + int(1000 * min(MOST_WAIT, self.first_wait * 2 ** (tries - 1))))
                    break
                if status == "failed" and self.fail_over:
                    down = True
                    self.down.update((True,))
            self.open.removeKey((chunk,))
            self.done.updateValue((chunk,), (status,))
            out.append([*key, chunk, list(ids), text, status, tries, error_type(error) if error else None, f"{type(error).__name__}: {error}"[:300] if error else None])
            if len(out) == ROWS:
                yield self._frame(out)
                out = []
        yield self._frame(out)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=NAMES).astype({"chunk": "int64", "attempts": "int32"})

    def close(self) -> None:
        pass


def run_stream(requests: DataFrame, caller: Caller, check: Callable[[str], None], ladder: tuple[Attempt, ...], fail_over: bool = True, most: int = 16, first_wait: float = FIRST_WAIT, seconds: float = 0) -> DataFrame:
    """Results of streamed ``requests`` (model_id, mode, track, chunk, benchmark_ids, messages, compact), to be written with a checkpoint and a repeating trigger, since pauses are timers."""
    return requests.groupBy(*GROUP).transformWithStateInPandas(Run(caller, check, ladder, fail_over, most, first_wait, seconds), RESULT, "append", "processingTime")


def ready(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state needs."""
    spark.conf.set(PROVIDER, ROCKS)
    return spark


def drain(results: DataFrame, path: str, checkpoint: str, expected: int, seconds: float = 120, every: str = "200 milliseconds", idle: float = 0, stop_at: int | None = None) -> DataFrame:
    """Run the stream into Parquet at ``path`` until ``expected`` results are there (or ``stop_at``, to be gone on with later) and return what is there.

    It fails after ``seconds`` without a new result, however long the whole run takes; results are counted once a trigger. The query is stopped between two batches if there is a pause between them within ``idle`` seconds; a batch that is stopped asks its chunks again when the run goes on.
    """
    spark = results.sparkSession
    query = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    last, have, seen = time.monotonic(), 0, None
    try:
        while have < (stop_at or expected):
            if query.exception() or time.monotonic() - last > seconds:
                raise RuntimeError(f"{have} of {expected} results, none for {time.monotonic() - last:.0f} s: {query.exception()}")
            time.sleep(0.2)
            progress = query.lastProgress
            if progress and progress.timestamp != seen:
                seen, found = progress.timestamp, spark.read.schema(RESULT).parquet(path).count()
                last, have = (time.monotonic(), found) if found > have else (last, have)
    finally:
        until = time.monotonic() + idle
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.02)
        query.stop()
    return spark.read.schema(RESULT).parquet(path)
