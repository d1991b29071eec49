"""Ranking metrics of panels that no task should hold: ranks, rank correlation, pair counts and top items from weighted cells.

* A cell is a pair of values of a panel with how many rows have it, so ties and
  repeated values shrink before they are shuffled. Ranks come from the counts of
  distinct values, summed in order. All metrics read the same cells, which are
  ranked once. Sums are exact.
* Pairs: both orders are cut into blocks of values by how many rows lie before
  them; a value of more rows than a block has a block of its own. Pairs in one
  block of gold, and those in one block of pred but not of gold, are counted by
  merging inside tasks, but for blocks of a single value, whose pairs are ties;
  all others follow from how many rows each pair of blocks shares.
* Top items are looked for among rows at or above the k-th value, and taken from
  ``SHARES`` parts of a panel first.

Nothing is collected; a task holds a block, of up to twice ``BLOCK`` rows, and up
to BLOCK * MOST rows a panel; beyond that twice a part in ``MOST`` of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordering import running_within
from lectern.runtime import scratch

BLOCK, MOST, SHARES = 1 << 14, 4096, 64


def inversions(values: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Pairs i < j with values[i] > values[j], each by the product of its weights (1 where not given), by merging pairs of runs, all of a width at once."""
    if len(values) < 2:
        return 0
    ranks = np.unique(values, return_inverse=True)[1]
    x = np.full(1 << (len(ranks) - 1).bit_length(), len(ranks), dtype=np.int64)
    x[: len(ranks)] = ranks
    n = np.zeros(len(x), dtype=np.int64)
    n[: len(ranks)] = 1 if weights is None else weights
    total, width = 0, 1
    while width < len(x):
        pairs, each = x.reshape(-1, 2 * width), n.reshape(-1, 2 * width)
        order = np.argsort(pairs, axis=1, kind="stable")
        each = np.take_along_axis(each, order, axis=1)
        left = np.where(order < width, each, 0)
        above = left.sum(axis=1, keepdims=True) - np.cumsum(left, axis=1)
        total += int(((each - left) * above).sum())
        x, n, width = np.take_along_axis(pairs, order, axis=1).reshape(-1), each.reshape(-1), 2 * width
    return total


def ordered(g: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(concordant, discordant) pairs of rows in distinct cells (g, p) of n rows each."""
    order = np.lexsort((p, g))
    g, p, n = g[order], p[order], n[order]
    square = lambda x: int((x * x).sum())
    of = lambda x: square(np.bincount(np.unique(x, return_inverse=True)[1], n).astype(np.int64))
    untied = (int(n.sum()) ** 2 - of(g) - of(p) + square(n)) // 2
    down = inversions(p, n)
    return np.array([untied - down, down])


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table as written below the shared folder: places of tied rows stay as they are, and a lost executor costs no earlier stage."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def ranked_cells(items: DataFrame, by: list[str]) -> DataFrame:
    """(_panel, gold, pred, n, g, gn, p, pn): each pair of values with its rows, how many rows of the panel are below either value, and how many have it; nulls come first."""
    cells = kept(items.groupBy(F.struct(*by).alias("_panel"), "gold", "pred").agg(F.count(F.lit(1)).alias("n")), "cells")
    out = cells
    for value, name in (("gold", "g"), ("pred", "p")):
        counts = kept(cells.groupBy("_panel", value).agg(F.sum("n").alias("n")), "counts")
        ranks = running_within(counts, "_panel", [value], name, F.col("n")).select(F.col("_panel").alias("_panel2"), F.col(value).alias("_value"), name, F.col("n").alias(f"{name}n"))
        out = out.join(ranks, (F.col("_panel") == F.col("_panel2")) & F.col(value).eqNullSafe(F.col("_value"))).drop("_panel2", "_value")
    return kept(out, "ranked")


def spearman(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, spearman) of each panel, from exact sums of doubled ranks, whose mean is n + 1."""
    return _spearman(ranked_cells(items, by))


def _spearman(cells: DataFrame) -> DataFrame:
    wide = lambda c: c.cast("decimal(19,0)")
    n, g, p = F.col("n"), 2 * F.col("g") + F.col("gn") + 1, 2 * F.col("p") + F.col("pn") + 1
    product = lambda a, b: F.sum((wide(n) * wide(a) * wide(b)).cast("decimal(38,0)"))
    sums = cells.groupBy("_panel").agg(F.sum("n").alias("n"), product(g, p).alias("gp"), product(g, g).alias("gg"), product(p, p).alias("pp"))
    mean = (wide(n) * (wide(n) + 1) * (wide(n) + 1)).cast("decimal(38,0)")
    part = lambda c: (F.col(c) - mean).cast("double")
    return sums.select("_panel.*", "n", F.coalesce(F.try_divide(part("gp"), F.sqrt(part("gg") * part("pp"))), F.lit(0.0)).alias("spearman"))


def pairs(items: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, concordant, discordant) of each panel's pairs that neither gold nor pred ties; rows that lack either are left out."""
    return _pairs(ranked_cells(items, by), block)


def _pairs(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    width = cells.groupBy("_panel").agg(F.greatest(F.lit(block).cast("long"), F.ceil(F.sum("n") / MOST)).alias("_width"))
    place = lambda c: 2 * F.floor(F.col(c) / F.col("_width")) + (F.col(f"{c}n") >= F.col("_width")).cast("long")  # noqa: E731 - odd where a value is a block
    both = cells.where("gold is not null and pred is not null").join(F.broadcast(width), "_panel").select("_panel", "g", "p", "n", place("g").alias("a"), place("p").alias("b"))
    columns = lambda table, names: (table.column(c).to_numpy() for c in names)

    def result(table: pa.Table, found: np.ndarray) -> pa.Table:
        return pa.table({"_panel": table.column("_panel").slice(0, 1), "concordant": pa.array(found[:1], pa.int64()), "discordant": pa.array(found[1:], pa.int64())})

    def one(table: pa.Table) -> pa.Table:
        return result(table, ordered(*columns(table, "gpn")))

    def other(table: pa.Table) -> pa.Table:
        g, p, n, a = columns(table, "gpna")
        same = [a == x for x in np.unique(a[a % 2 == 0])]
        return result(table, ordered(g, p, n) - sum((ordered(g[s], p[s], n[s]) for s in same), np.zeros(2, np.int64)))

    schema = f"_panel {cells.schema['_panel'].dataType.simpleString()}, concordant long, discordant long"
    inside = both.where("a % 2 = 0").groupBy("_panel", "a").applyInArrow(one, schema).unionByName(both.where("b % 2 = 0").groupBy("_panel", "b").applyInArrow(other, schema))
    shared = kept(both.groupBy("_panel", "a", "b").agg(F.sum("n").alias("n")), "shared")
    last = shared.groupBy("_panel").agg(F.max("b").alias("last"))
    grid = shared.groupBy("_panel", "a").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m")).join(F.broadcast(last), "_panel")  # at most 2 * MOST entries a row
    grid = grid.select("_panel", "a", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("b"), "m").select("_panel", "a", "b", F.coalesce(F.try_element_at("m", "b"), F.lit(0)).alias("n"))
    row, column = Window.partitionBy("_panel", "a"), Window.partitionBy("_panel", "b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    beside = lambda order: F.coalesce(F.sum("n").over(row.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = lambda c: F.coalesce(F.sum(c).over(column), F.lit(0))
    sides = grid.withColumn("less", beside(F.col("b").asc())).withColumn("more", beside(F.col("b").desc())).withColumn("less", before("less")).withColumn("more", before("more"))
    across = sides.groupBy("_panel").agg(F.sum(F.col("n") * F.col("less")).alias("concordant"), F.sum(F.col("n") * F.col("more")).alias("discordant"))
    return inside.unionByName(across).groupBy("_panel").agg(F.sum("concordant").alias("concordant"), F.sum("discordant").alias("discordant")).select("_panel.*", "concordant", "discordant")


def first_rows(df: DataFrame, by: list[str], order: list[Column], most: int, place: str = "_place") -> DataFrame:
    """The first ``most`` rows of each group with their place from 1; taken from parts of a group first, so that no task sorts a hot group."""
    share = F.pmod(F.monotonically_increasing_id(), F.lit(SHARES))
    w = Window.partitionBy(*by, "_share").orderBy(*order)
    few = df.withColumn("_share", share).withColumn(place, F.row_number().over(w)).where(F.col(place) <= most).drop("_share")
    return few.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= most)


def top_k(items: DataFrame, by: list[str], k: int, item: str) -> DataFrame:
    """(by, top_enrichment) as the small panels have it, for items named once a panel; at most k rows a panel and side are compared."""
    return _top_k(items, ranked_cells(items, by), by, k, item)


def _top_k(items: DataFrame, cells: DataFrame, by: list[str], k: int, item: str) -> DataFrame:
    sizes = cells.groupBy("_panel").agg(F.sum("n").alias("_n"))
    fits = lambda c: F.col("_n") - F.col(c) - F.col(f"{c}n") < k  # noqa: E731 - fewer than k rows above the value
    least = lambda c, name: [F.min(F.when(fits(name), F.col(c))).alias(f"_least_{c}"), F.bool_or(fits(name) & F.col(c).isNull()).alias(f"_all_{c}")]
    limits = cells.join(F.broadcast(sizes), "_panel").groupBy("_panel").agg(F.first("_n").alias("_n"), *least("gold", "g"), *least("pred", "p"))
    limits = kept(limits, "limits")  # a row a panel
    rows = items.withColumn("_panel", F.struct(*by)).join(F.broadcast(limits), "_panel")
    side = lambda c: first_rows(rows.where(F.col(f"_all_{c}") | (F.col(c) >= F.col(f"_least_{c}"))).select("_panel", item, c), ["_panel"], [F.col(c).desc(), F.col(item)], k).select("_panel", item)
    both = side("gold").join(side("pred"), ["_panel", item]).groupBy("_panel").agg(F.count(F.lit(1)).alias("_both"))
    return limits.join(both, "_panel", "left").select("_panel.*", (F.coalesce("_both", F.lit(0)) / F.least(F.col("_n"), F.lit(k))).alias("top_enrichment"))


def metrics(items: DataFrame, by: list[str], k: int, item: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rank correlation, pairs and top items over the same ranked cells."""
    cells = ranked_cells(items, by)
    return _spearman(cells), _pairs(cells), _top_k(items, cells, by, k, item)
