"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text.

Every ``ORDER``-gram of the trusted documents' bytes is counted: a task sums what
it reads, a shuffle by n-gram joins the shards' counts, and each lower order
counts the distinct continuations of the order above. Discounts come from each
order's counts of counts; an n-gram's probability is joined up from the lowest
order. The model is tables of n-grams and contexts, however many there are. A
document's n-grams meet them by a join, those that trusted text lacks by a join a
level on the way down. The ``CACHE`` most frequent ones are broadcast instead,
which changes no result. Bytes are taken as they are, whatever the script.

A document's score is its mean surprise per byte in nats (the logarithm of its
perplexity), drawn to its
language's mean by ``PRIOR`` bytes so that a short text needs strong
evidence. One in ``FOLDS`` trusted documents, by hash of its id, is kept from
training, and these give the thresholds: a language's is the quantile
``QUANTILE`` of their scores (exact on a grid of 1e-3) plus ``MARGIN``, and
alike on the other side, since text that surprises too little repeats itself;
that side is lowered by what trained text surprises less than text kept aside, so
that trusted documents and their copies stay (it shrinks as text grows).
With less than ``FEWEST`` of them a language takes these distances from its mean
from all languages; with less than that in all, the quantile is estimated from
their spread as well (Student's t) and the wider one counts.

Trusted: labelled with quality 1 and, where known, toxic 0; a document with
several labels needs all of them. Defined cases: null text counts as empty; an
empty text has its language's mean and is kept; a language without trusted
documents takes the threshold of all trusted ones; without any, everything is
kept; null is a language of its own; rows that repeat an id, or have none, are
scored row by row; a score that equals a threshold is kept; a very long text is a
block by itself; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernel
from lectern.llm.grams import counted, least_kept, looked_up, merged, rare_of, sorted_table
from lectern.llm.idset import texts_of
from lectern.llm.session import cut

ORDER = 4
CACHE = 1_000_000
FEW_ROWS = 200_000
PRIOR = 40.0
QUANTILE, MARGIN = 0.999, 0.02
FEWEST = 100
FOLDS = 5
GRID = 1e-3
FLUSH = 1 << 19
BLOCK = 1 << 18


def ngram_keys(buf: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The ``order`` bytes that end at each byte, as one number; what precedes a document is 0."""
    n, pad = len(offs) - 1, order - 1
    at = np.arange(len(buf)) + pad * (1 + np.repeat(np.arange(n), np.diff(offs)))
    line = np.zeros(len(buf) + pad * (n + 1), dtype=np.uint64)
    line[at] = buf
    key = line[at - pad]
    for back in range(pad - 1, -1, -1):
        key = (key << np.uint64(8)) | line[at - back]
    return key


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n) over all documents; every task sums what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, buf, offs in kernel.blocks(batch, "text", BLOCK):
                k, n = counted(ngram_keys(buf, offs, order))
                keys, counts, held = [*keys, k], [*counts, n], held + len(k)
                if held > FLUSH:
                    k, n = merged(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])
                        keys, counts, held = [], [], 0
        if keys:
            k, n = merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from how many n-grams are counted once, twice, three and four times."""
    if not (n[0] and n[1]):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 * (i + 1) for i in range(3)]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _below(column: str, size: int) -> Column:
    """The last ``size`` bytes of a key."""
    return F.col(column).bitwiseAND(F.lit((1 << (8 * size)) - 1))


class Model:
    """Kneser-Ney tables: for each order (key, raw, p) of the n-grams seen, and (ctx, gamma), the share that a context leaves to the order below."""

    def __init__(self, trusted: DataFrame, order: int = ORDER):
        level = cut(count_ngrams(trusted, order).select("key", F.col("n").alias("raw"), F.col("n").alias("c")))
        levels = [level]
        for size in range(order - 1, 0, -1):
            level = cut(level.groupBy(_below("key", size).alias("key")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("c")), light=True)
            levels.insert(0, level)
        self.nodes, self.contexts, lower = [], [], None
        for size, level in enumerate(levels, 1):
            many = level.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
            d = discounts(list(many))
            cost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            here = level.withColumn("ctx", F.shiftrightunsigned("key", 8)).withColumn("cost", cost)
            contexts = cut(here.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cost").alias("spare")), light=True)
            below = here.withColumn("lower", F.lit(1 / 256)) if lower is None else here.withColumn("low", _below("key", size - 1)).join(lower.select(F.col("key").alias("low"), F.col("p").alias("lower")), "low")
            p = (F.col("c") - F.col("cost") + F.col("spare") * F.col("lower")) / F.col("total")
            lower = cut(below.join(contexts, "ctx").select("key", "raw", p.alias("p")), light=size < order)
            self.nodes.append(lower)
            self.contexts.append(contexts.select("ctx", (F.col("spare") / F.col("total")).alias("gamma")))
        #: (key, raw, code): log p of the n-grams that trusted text has
        self.known = lower.select("key", "raw", F.log("p").alias("code"))

    def code_unseen(self, grams: DataFrame) -> DataFrame:
        """(key, code) of distinct n-grams that trusted text lacks."""
        out, todo = [], grams.select("key", F.lit(0.0).alias("code"))
        for size in range(len(self.nodes), 0, -1):
            here = todo.withColumn("low", _below("key", size)).withColumn("ctx", F.shiftrightunsigned("low", 8))
            found = cut(here.join(self.contexts[size - 1], "ctx", "left").join(self.nodes[size - 1].select(F.col("key").alias("low"), "p"), "low", "left").select("key", "code", "gamma", "p"), light=True)
            out.append(found.where("p is not null").select("key", (F.col("code") + F.log("p")).alias("code")))
            todo = found.where("p is null").select("key", (F.col("code") + F.coalesce(F.log("gamma"), F.lit(0.0))).alias("code"))
        out.append(todo.select("key", (F.col("code") - F.lit(float(np.log(256)))).alias("code")))
        return reduce(DataFrame.unionByName, out)


def trusted_ids(labels: DataFrame) -> DataFrame:
    by_doc = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return by_doc.where("q = 1 and t = 0").select("doc_id")


def surprise(docs: DataFrame, model: Model, cache: int = CACHE) -> DataFrame:
    """(doc_id, language, lang, digest, n_symbols, surprise) of each row: md5 and bytes of its text, and their total surprise in nats."""
    cached = sorted_table(model.known.where(F.col("raw") >= least_kept([model.known], "raw", cache)).select("key", "code"), np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(cached)
    names = ["row", "doc_id", "language", "lang", "digest", "n_symbols", "surprise", "grams", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, buf, offs in kernel.blocks(batch, "text", BLOCK):
                found, each = np.unique(ngram_keys(buf, offs), return_inverse=True)
                code, known = looked_up(keys, codes, found)
                sums = np.zeros(len(buf) + 1)
                np.cumsum(code[each], out=sums[1:])
                rare, times, cuts = rare_of(found, each, ~known, offs)
                raw, ends = memoryview(np.ascontiguousarray(buf)), offs.tolist()
                digest = [hashlib.md5(raw[a:b]).digest() if there else None for a, b, there in zip(ends, ends[1:], part.column(3).is_valid().to_pylist(), strict=False)]
                lists = (pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (rare.view(np.int64), times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(part.num_rows)), *part.columns[:3], pa.array(digest, pa.binary()), pa.array(np.diff(offs)), pa.array(sums[offs[:-1]] - sums[offs[1:]]), *lists], names)
                row += part.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("language"), "lang", F.col("text").cast("string").alias("text"))
    scored = cut(rows.mapInArrow(run, "row long, doc_id long, language string, lang string, digest binary, n_symbols long, surprise double, grams array<long>, times array<int>"))
    rare = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("key"), F.col("g.times").alias("times"))
    unseen = cut(rare.select("key").distinct().join(model.known, "key", "left_anti"), light=True)
    codes = model.known.select("key", "code").unionByName(model.code_unseen(unseen))
    more = rare.join(codes, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("code")).alias("more"))
    return scored.drop("grams", "times").join(more, "row", "left").select(*names[1:6], (F.col("surprise") - F.coalesce("more", F.lit(0.0))).alias("surprise"))


def _quantiles(scores: DataFrame, q: float, by: str) -> DataFrame:
    """(by, low, high): the quantiles 1 - q and q of ``score`` in each group, exact on the grid."""
    bins = scores.groupBy(by, F.floor(F.col("score") / GRID).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(by)
    ranked = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    high = F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("bin") + 1))
    low = F.max(F.when(F.col("all") - F.col("upto") + F.col("n") >= F.lit(q) * F.col("all"), F.col("bin")))
    return ranked.groupBy(by).agg((low * GRID).alias("low"), (high * GRID).alias("high"))


class Fitted(NamedTuple):
    scored: DataFrame
    by_language: DataFrame  # (language, mean, lowest, threshold)
    other: tuple[float, float, float]  # mean, lowest and threshold of languages without trusted documents


def _fitted(docs: DataFrame, labels: DataFrame, quantile: float, margin: float) -> Fitted:
    trusted = trusted_ids(labels)
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    fit, rest = trusted.where(~aside), trusted.where(aside)
    if fit.isEmpty() or rest.isEmpty():
        fit = rest = trusted
    scored = cut(surprise(docs, Model(texts_of(docs, fit))))
    known = scored.join(rest, "doc_id", "left_semi")
    mean = F.sum("surprise") / F.greatest(F.sum("n_symbols"), F.lit(1))
    overall = known.agg(F.coalesce(mean, F.lit(0.0)).alias("mean")).first()["mean"]
    trained = scored.join(fit, "doc_id", "left_semi").agg(mean.alias("mean")).first()["mean"]
    less = max(0.0, overall - (overall if trained is None else trained))
    means = known.groupBy("language").agg(mean.alias("mean"))
    known = known.join(means, "language").withColumn("score", _score(F.col("mean")))
    of_all = _limits(known.select(F.lit(0).alias("one"), "score"), quantile, margin, "one").first()
    off = _limits(known.select(F.lit(0).alias("one"), (F.col("score") - F.col("mean")).alias("score")), quantile, margin, "one").first()
    if not (of_all and off):
        return Fitted(scored, means.select("language", "mean", F.lit(0.0).alias("lowest"), F.lit(0.0).alias("threshold")), (overall, float("-inf"), float("inf")))
    enough = F.col("n") >= FEWEST
    limits = means.join(_limits(known, quantile, margin, "language"), "language").select(
        "language",
        "mean",
        (F.when(enough, F.col("lowest")).otherwise(F.col("mean") + off.lowest) - less).alias("lowest"),
        F.when(enough, F.col("threshold")).otherwise(F.col("mean") + off.threshold).alias("threshold"),
    )
    return Fitted(scored, cut(limits, light=True), (overall, of_all.lowest - less, of_all.threshold))


def _limits(scores: DataFrame, quantile: float, margin: float, by: str) -> DataFrame:
    """(by, n, lowest, threshold) of each group."""
    z = NormalDist().inv_cdf(quantile)
    free = F.greatest(F.col("n") - 1, F.lit(1))
    t = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free * free)
    spread = scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
    wide = F.when(F.col("n") < FEWEST, t * F.col("sd") * F.sqrt(1 + 1 / F.col("n")))
    return _quantiles(scores, quantile, by).join(spread, by).select(by, "n", (F.least("low", F.col("avg") - wide) - margin).alias("lowest"), (F.greatest("high", F.col("avg") + wide) + margin).alias("threshold"))


def _language() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def _score(mean: Column) -> Column:
    return (F.col("surprise") + PRIOR * mean) / (F.col("n_symbols") + PRIOR)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, n_symbols, score, lowest, threshold, kept) of every row of ``docs``."""
    return _judged(_fitted(docs, labels, quantile, margin)).select("doc_id", "lang", "n_symbols", "score", "lowest", "threshold", "kept")


def _judged(fitted: Fitted) -> DataFrame:
    mean, lowest, threshold = (F.coalesce(c, F.lit(x)) for c, x in zip(("mean", "lowest", "threshold"), fitted.other, strict=True))
    out = fitted.scored.join(fitted.by_language, "language", "left").withColumn("score", _score(mean)).withColumns({"lowest": lowest, "threshold": threshold})
    return out.withColumn("kept", F.col("score").between(F.col("lowest"), F.col("threshold")))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, each judged by its own text and language, whatever its id.

    Rows are told apart by id, language and md5 of the text; those rejected are
    broadcast if they are at most ``FEW_ROWS``, else joined by a shuffle.
    """
    judged = _judged(_fitted(docs, labels, quantile, margin)).where(~F.col("kept"))
    bad = cut(judged.select(F.col("doc_id").alias("d"), F.col("language").alias("l"), F.col("digest").alias("m")).distinct(), light=True)
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, lang, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "lang", "text"))
    same = ident.cast("long").eqNullSafe(F.col("d")) & (F.coalesce(lang, F.lit("")) == F.col("l")) & F.unhex(F.md5(text.cast("string").cast("binary"))).eqNullSafe(F.col("m"))
    few = bad.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return docs.toDF(*names).join(F.broadcast(bad) if few else bad, same, "left_anti").toDF(*docs.columns)
