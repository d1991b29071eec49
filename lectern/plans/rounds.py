"""Reading a source in rounds until enough rows are accepted.

A round is a range of the source's places, each twice as long as the one before
it. The range is a filter that reaches the scan (of a table that lies in order, or
of a paged search, whose pages it decides), so what lies behind the last round is
never read. What a round accepts is written below the shared folder; how much it
read is observed while it is written, not counted in a pass of its own.

Defined cases: ``least`` below 1 reads nothing; a source that runs out gives what
it has; an empty round does not end the reading unless its source is known to be
no longer than that; rows of one place count each, in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lectern.runtime import scratch


class Read(NamedTuple):
    rows: DataFrame  # accepted, the first ``least`` in order
    read: int  # rows that the rounds read
    rounds: int


def until(source: Callable[[int, int], DataFrame], accept: Callable[[DataFrame], DataFrame], least: int, first: int = 1024, order: str = "ord", length: int | None = None) -> Read | None:
    """``source(begin, end)`` gives the rows of a range of places, ``accept`` what counts of them; None where nothing is asked.

    Without ``length`` the source ends with its first range that has no rows.
    """
    begin, step, read, have, rounds, kept, where = 0, first, 0, 0, 0, None, None
    while have < least and (length is None or begin < length):
        rows = source(begin, begin + step)
        seen, some = Observation(), Observation()
        where = where or scratch(rows.sparkSession, "rounds")
        accept(rows.observe(seen, F.count(F.lit(1)).alias("n"))).observe(some, F.count(F.lit(1)).alias("n")).write.parquet(f"{where}/lectern_round={rounds}")
        n = seen.get["n"]
        read, have, rounds, begin, step = read + n, have + some.get["n"], rounds + 1, begin + step, 2 * step
        kept = rows.sparkSession.read.parquet(where)
        if length is None and not n:
            break
    return None if kept is None else Read(kept.drop("lectern_round").orderBy(order).limit(least), read, rounds)


def of_table(df: DataFrame, order: str = "ord") -> Callable[[int, int], DataFrame]:
    """Ranges of a table by its column of places."""
    return lambda begin, end: df.where((F.col(order) >= begin) & (F.col(order) < end))
