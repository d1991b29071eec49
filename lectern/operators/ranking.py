"""Ranking metrics of panels of items: fractional ranks, Spearman, tie-free Kendall, pairwise accuracy, top-k overlap.

Items come as rows (panel, item, gold, pred). A panel's items are gathered once
and pairs are counted inside the row, so no pair becomes a row; panels beyond
``SMALL`` items are counted by merging in O(n log n). Panels of more than
``LARGE`` items, which no task should hold, go through ``large_panels``; which
they are is counted first. Both ways give the same figures.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.operators import large_panels

SMALL, LARGE, ROWS = 512, 50_000, 1 << 19


def strength(value: Column, direction: Column) -> Column:
    """Measured value as a strength: negated where lower is stronger."""
    return F.when(direction == "lower_is_stronger", -value).otherwise(value)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate, 0 where it isn't defined."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))), F.lit(0.0))


def by_size(items: DataFrame, by: list[str], large: int = LARGE) -> tuple[DataFrame, DataFrame | None]:
    """(items of panels up to ``large`` items, items of the others or None); keys of at most a ``large``-th of the rows are collected and broadcast.

    Items of small panels lie by panel in partitions of about ``ROWS`` rows, or
    in the session's number where those have fewer.
    """
    sizes = items.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows, found = sizes.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > large, F.struct(*by)))).first()
    small, hot = items, None
    if found:
        keys = F.broadcast(items.sparkSession.createDataFrame(found, sizes.select(*by).schema).toDF(*[f"_{c}" for c in by]))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        small, hot = items.join(keys, same, "left_anti"), items.join(keys, same, "left_semi")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.repartition(max(parts, -(-rows // ROWS)), *by) if (rows or 0) > ROWS else small, hot


def _either(parts: tuple[DataFrame, DataFrame | None], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return small(parts[0]) if parts[1] is None else small(parts[0]).unionByName(large(parts[1]))


def spearman(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, spearman) of each panel."""
    return _either(by_size(items, by), lambda small: _small_spearman(small, by), lambda large: large_panels.spearman(large, by))


def _small_spearman(items: DataFrame, by: list[str]) -> DataFrame:
    ranked = items.withColumn("_g", average_rank("gold", by)).withColumn("_p", average_rank("pred", by))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("_g"), F.col("_p")).alias("spearman"))


def _sorted_agreement(gold: np.ndarray, pred: np.ndarray) -> tuple[int, int]:
    """(concordant, discordant) of all pairs without ties, by merging."""
    order = np.lexsort((pred, gold))
    g, p = gold[order], np.unique(pred[order], return_inverse=True)[1]

    def less(values: np.ndarray) -> int:
        """Pairs i < j with values[i] < values[j]."""
        total, width, n = 0, 1, len(values)
        values = values.copy()
        while width < n:
            for a in range(0, n - width, 2 * width):
                left, right = values[a : a + width], values[a + width : a + 2 * width]
                total += int(np.searchsorted(left, right, side="left").sum())
                values[a : a + 2 * width] = np.sort(values[a : a + 2 * width], kind="stable")
            width *= 2
        return total

    edges = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    inside_up = sum(less(part) for part in np.split(p, edges[1:]))
    inside_down = sum(less(-part) for part in np.split(p, edges[1:]))
    return less(p) - inside_up, less(-p) - inside_down


@F.pandas_udf(StructType([StructField("concordant", LongType()), StructField("discordant", LongType())]))
def merged_pairs(items: pd.Series) -> pd.DataFrame:
    """Pair counts of large panels."""
    return pd.DataFrame([_sorted_agreement(np.array([i["g"] for i in x], float), np.array([i["p"] for i in x], float)) for x in items], columns=["concordant", "discordant"])


def _pairs_in_row(items: Column) -> Column:
    """Struct of concordant and discordant pairs, counted in the JVM."""
    sign = lambda a, b: F.signum(a["g"] - b["g"]) * F.signum(a["p"] - b["p"])
    each = F.transform(items, lambda a, i: F.aggregate(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("d")), lambda s, b: F.struct((s["c"] + (sign(a, b) > 0).cast("bigint")).alias("c"), (s["d"] + (sign(a, b) < 0).cast("bigint")).alias("d"))))
    return F.aggregate(each, F.struct(F.lit(0).cast("bigint").alias("concordant"), F.lit(0).cast("bigint").alias("discordant")), lambda s, x: F.struct((s["concordant"] + x["c"]).alias("concordant"), (s["discordant"] + x["d"]).alias("discordant")))


def pair_metrics(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, concordant, discordant, kendall_tau, pairwise_accuracy): pairs tied in gold or prediction are left out of Kendall's; accuracy counts pairs that gold and prediction both order."""
    return _agreement(_either(by_size(items, by), lambda small: _small_pairs(small, by), lambda large: large_panels.pairs(large, by)))


def _agreement(both: DataFrame) -> DataFrame:
    untied = F.col("concordant") + F.col("discordant")
    return both.withColumn("kendall_tau", F.coalesce(F.try_divide(F.col("concordant") - F.col("discordant"), untied), F.lit(0.0))).withColumn("pairwise_accuracy", F.coalesce(F.try_divide(F.col("concordant"), untied), F.lit(0.0)))


def _small_pairs(items: DataFrame, by: list[str]) -> DataFrame:
    packed = items.where("gold is not null and pred is not null").groupBy(*by).agg(F.collect_list(F.struct(F.col("gold").cast("double").alias("g"), F.col("pred").cast("double").alias("p"))).alias("_items"))
    small = packed.where(F.size("_items") <= SMALL).withColumn("_c", _pairs_in_row(F.col("_items")))
    large = packed.where(F.size("_items") > SMALL).withColumn("_c", merged_pairs("_items"))
    return small.select(*by, "_c.*").unionByName(large.select(*by, "_c.*"))


def top_k(items: DataFrame, by: list[str], k: int = 1, item: str = "item") -> DataFrame:
    """(by, enrichment): share of the k strongest items by gold among the k best by prediction, k at most the panel's size; ties go by item id."""
    return _either(by_size(items, by), lambda small: _small_top_k(small, by, k, item), lambda large: large_panels.top_k(large, by, k, item))


def _small_top_k(items: DataFrame, by: list[str], k: int, item: str) -> DataFrame:
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).desc(), F.col(item)))
    ranked = items.withColumn("_g", place("gold")).withColumn("_p", place("pred"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if((F.col("_g") <= k) & (F.col("_p") <= k)).alias("_both")).select(*by, (F.col("_both") / F.least(F.col("_n"), F.lit(k))).alias("top_enrichment"))


def panel_metrics(items: DataFrame, by: list[str], item: str = "item", k: int = 1, large: int = LARGE) -> DataFrame:
    """All metrics of each panel; those of more than ``large`` items are spread over tasks."""
    small, hot = by_size(items, by, large)
    correlated, paired, top = (None,) * 3 if hot is None else large_panels.metrics(hot, by, k, item)
    either = lambda few, many: few if many is None else few.unionByName(many)
    return either(_small_spearman(small, by), correlated).join(_agreement(either(_small_pairs(small, by), paired)), by, "left").join(either(_small_top_k(small, by, k, item), top), by, "left").na.fill(0.0, ["kendall_tau", "pairwise_accuracy"])


def panel_items(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items (benchmark_id, item, gold, pred) of comparable panels with their last predicted scores."""
    from lectern.operators.keys import last_by, with_order

    gold = cases.where(F.coalesce("comparable_panel", F.lit(True))).select("benchmark_id", "measurement_direction", F.explode("items").alias("i")).select("benchmark_id", F.col("i.item_id").alias("item"), strength(F.col("i.measured_value"), F.col("measurement_direction")).alias("gold"))
    last = last_by(with_order(predictions).select("benchmark_id", "scores", "ord"), ["benchmark_id"])
    scored = last.select("benchmark_id", F.posexplode("scores").alias("at", "s")).groupBy("benchmark_id", F.col("s.item_id").alias("item")).agg(F.max_by("s.score", "at").alias("pred"))
    return gold.join(scored, ["benchmark_id", "item"])


def evaluate_binding_rank(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: mean of the panels' metrics and the number of panels."""
    each = panel_metrics(panel_items(cases, predictions), ["benchmark_id"])
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return each.agg(mean("spearman", "spearman"), mean("kendall_tau", "kendall_tau"), mean("pairwise_accuracy", "pairwise_ranking_accuracy"), mean("pairwise_accuracy", "concordance_index"), mean("top_enrichment", "top_1_enrichment"), F.count(F.lit(1)).alias("assay_aware_subgroup_count"))
