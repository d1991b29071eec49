"""Counts of n-grams: merging them in a task, tables of the most frequent ones, and what a table lacks of a document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def least_kept(levels: list[DataFrame], column: str, most: int) -> int:
    """Least count for which at most ``most`` rows have as much."""
    steps = F.when(F.col(column) < 4096, F.col(column)).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2(column)))).cast("long"))
    sizes: dict[int, int] = {}
    for level in levels:
        for r in level.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect():  # 4,150 rows at most
            sizes[r.step] = sizes.get(r.step, 0) + r.n
    least, kept = 1 << 62, 0
    for step in sorted(sizes, reverse=True):
        kept += sizes[step]
        if kept > most:
            break
        least = step
    return least


def sorted_table(df: DataFrame, kind: type = np.float32) -> tuple[np.ndarray, ...]:
    """Columns as arrays in order of the first, the keys; a table of bounded size."""
    found = df.toArrow()
    key = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], *(c.to_numpy().astype(kind)[order] for c in found.columns[1:])


def looked_up(keys: np.ndarray, codes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, cached) of each gram; 0 where it isn't cached."""
    if not len(keys):
        return np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    cached = keys[at] == grams
    return np.where(cached, codes[at], 0.0), cached


def rare_of(found: np.ndarray, each: np.ndarray, rare: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, times, offsets): each document's distinct grams among the rare ones."""
    at = np.flatnonzero(rare[each])
    doc = np.searchsorted(offs, at, side="right") - 1
    pair, times = np.unique(doc * len(found) + each[at], return_counts=True)
    return found[pair % max(len(found), 1)], times, np.searchsorted(pair, np.arange(len(offs)) * len(found))
