"""LM scoring: prediction by partial matching over a byte-context trie.

A text is its words, lower-cased (A-Z), each followed by a space, the last by
the end symbol. The trie has contexts of up to ``ORDER`` bytes. Its deepest
level has counts of the training text; a shorter context counts in how many
longer ones its symbol was seen (update exclusion). A symbol is coded in the
longest context known; if it wasn't seen there, an escape is coded and the search
goes on in the next shorter context, without the symbols already ruled out
(symbol exclusion), down to a uniform choice of bytes. How likely an
escape is after n counts of q symbols is estimated for each level by leaving one
count out of every context; what pruning took away is left to escapes, too.

Counting covers the whole training text: a task sums the n-grams of what it
reads, a shuffle joins the sums, and each level is one aggregation of the level
below. The trie that scores has all nodes, however many, as tables by key:

* A gram of the training text is coded at the deepest level, from its own
  count and its context's: one window over the contexts of that level.
* A gram that only held-out documents have goes down level by level, joined
  with contexts and nodes by key.
* A document's grams meet these code lengths by a join. Those of the ``CACHE``
  most frequent grams are broadcast instead, which changes no result.

``train_trie`` makes the same model as arrays in memory, for texts known to be
small; pruned to a number of nodes, it drops those counted fewer than t times.

Beside it stands a word model as a base line: log10((c + 1) / (N + V + 1)) a
token. Counts of the ``HEAD`` most frequent words are broadcast, and what texts
have of all other words is joined with the other counts, so no word is lost.

Defined cases: null text counts as empty and has one token, the end; a null id
belongs to the training text; rows that repeat an id are scored row by row;
without training text N and V are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernel
from lectern.llm.grams import counted, least_kept, looked_up, merged, rare_of, sorted_table
from lectern.llm.session import cut

ORDER = 6
CACHE = 1_000_000
HEAD = 500_000
FOLDS, HELD_OUT = 7, 2
BLOCK = 2 << 20
FLUSH = 10 << 20
_END, _SPACE = 10, 32
_8 = np.uint64(8)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def line_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): the (order + 1)-byte gram that ends at each symbol of each document."""
    docs = len(first) - 1
    n_words = np.diff(first)
    size = end - start + 1
    sums = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=sums[1:])
    length = sums[first[1:]] - sums[first[:-1]] + (n_words == 0)
    offs = np.zeros(docs + 1, dtype=np.int64)
    np.cumsum(length, out=offs[1:])
    line = np.full(int(offs[-1]) + order * docs, _END, dtype=np.uint8)
    doc = np.repeat(np.arange(docs), n_words)
    at = sums[:-1] + np.cumsum(n_words == 0)[doc] - (n_words == 0)[doc] + order * (doc + 1)
    line[kernel.ragged(at, end - start)] = kernel.LOWER[buf[kernel.ragged(start, end - start)]]
    inner = np.ones(len(size), dtype=bool)
    inner[first[1:][n_words > 0] - 1] = False
    line[(at + size - 1)[inner]] = _SPACE
    key = np.zeros(len(line), dtype=np.uint64)
    for back in range(order, -1, -1):
        key[order:] = (key[order:] << _8) | line[order - back : len(line) - back]
    real = np.ones(len(line), dtype=bool)
    real[kernel.ragged(offs[:-1] + order * np.arange(docs), np.full(docs, order))] = False
    return key[real], offs


def _count(train: DataFrame, grams: bool, order: int = ORDER) -> DataFrame:
    """(key, n): counts of the deepest grams, or of words, over the whole training text."""

    def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)].view(np.int64)), pa.array(n[i : i + (1 << 18)].astype(np.int64))], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, buf, offs in kernel.blocks(batch, "text", BLOCK):
                start, end, first = kernel.words(buf, offs)
                k, n = counted(line_of(buf, start, end, first, order)[0] if grams else kernel.span_hashes(buf, start, end))
                keys.append(k)
                counts.append(n)
                held += len(buf)
                if held > FLUSH:
                    yield from out(*merged(keys, counts))
                    keys, counts, held = [], [], 0
        if keys:
            yield from out(*merged(keys, counts))

    return train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


N_BINS, Q_BINS = 56, 33


def n_bin(n: np.ndarray) -> np.ndarray:
    """Counts up to 15 each have a class, greater ones share one a half octave."""
    return np.where(n < 16, n, np.minimum(8 + 2 * np.log2(np.maximum(n, 1)), N_BINS - 1)).astype(np.int64)


def escape_table(totals: np.ndarray, symbols: np.ndarray, once: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Probability of a new symbol in a context with n counts of q symbols, by leaving one out.

    Taking one count from a context with n + 1 of them leaves a context where
    what was taken is new (it was counted once, q falls) or isn't. The sums of
    both over all contexts of a level are the estimate, with four counts of the
    prior q / 2n. The arguments describe groups of alike contexts.
    """
    new, old = np.zeros((N_BINS, Q_BINS)), np.zeros((N_BINS, Q_BINS))
    row = n_bin(np.maximum(totals - 1, 0))
    np.add.at(new, (row, np.clip(symbols - 1, 0, Q_BINS - 1)), once * contexts)
    np.add.at(old, (row, np.minimum(symbols, Q_BINS - 1)), (totals - once) * contexts)
    n = np.where(np.arange(N_BINS) < 16, np.arange(N_BINS), 2.0 ** ((np.arange(N_BINS) - 8) / 2))[:, None]
    prior = np.clip(np.arange(Q_BINS)[None, :] / (2 * np.maximum(n, 1)), 0.0005, 0.9)
    out = (new + 4 * prior) / (new + old + 4)
    out[:, 0] = 1.0  # nothing is left in the context
    return np.clip(out, 1e-5, 1.0)


class Trie:
    """The trie, whole or pruned, as sorted arrays, one set for each order."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], escapes: list[np.ndarray]):
        self.levels = []
        for o, ((keys, count), (ctx, total, symbols)) in enumerate(zip(nodes, contexts, strict=True)):
            if not len(keys):
                self.levels.append(None)
                continue
            first = np.flatnonzero(np.append(True, (keys[1:] >> _8) != (keys[:-1] >> _8)))
            own = keys[first] >> _8
            at = np.searchsorted(ctx, own)
            seen = np.diff(np.append(first, len(keys))).astype(np.float32)
            low = np.zeros(len(first), dtype=np.float32)
            if o:  # what the next shorter context counts of the symbols seen here
                low = np.add.reduceat(nodes[o - 1][1][np.searchsorted(nodes[o - 1][0], keys & np.uint64((1 << (8 * o)) - 1))], first)
            pruned = total[at] - np.add.reduceat(count, first)
            self.levels.append((keys, count, own, total[at], symbols[at], pruned, seen, low, escapes[o]))

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each gram after those before it (sorted grams are fastest)."""
        order = len(self.levels) - 1
        out = np.zeros(len(grams))
        ruled_out, ruled_symbols = np.zeros(len(grams)), np.zeros(len(grams))
        todo = np.arange(len(grams))
        for o in range(order, -1, -1):
            if self.levels[o] is None or not len(todo):
                continue
            keys, count, ctx, total, symbols, pruned, seen, low, escapes = self.levels[o]
            key = grams[todo] & np.uint64((1 << (8 * (o + 1))) - 1)
            if o < order:
                sort = np.argsort(key, kind="stable")
                todo, key = todo[sort], key[sort]
            at = np.minimum(np.searchsorted(ctx, key >> _8), len(ctx) - 1)
            known = ctx[at] == key >> _8
            here, at, key = todo[known], at[known], key[known]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[node] == key
            rest = np.maximum(total[at] - ruled_out[here], 0)
            left = np.clip(symbols[at] - ruled_symbols[here], 0, Q_BINS - 1).astype(np.int64)
            new = np.where(rest > 0, escapes[n_bin(rest), left], 1.0)
            share = np.where(hit, count[node], pruned[at]) / np.maximum(rest, 1)
            out[here] += np.log10(np.clip((1 - new) * share + np.where(hit, 0.0, new), 1e-9, 1.0))
            miss, lost = here[~hit], at[~hit]
            ruled_out[miss], ruled_symbols[miss] = low[lost], seen[lost]
            going = np.ones(len(grams), dtype=bool)
            going[here[hit]] = False
            todo = todo[going[todo]]
        out[todo] -= np.log10(np.maximum(256.0 - ruled_symbols[todo], 1.0))
        return out


def _levels(train: DataFrame, order: int) -> list[DataFrame]:
    """(key, raw, c) of each order: all nodes, how often they occur and what they count in their context."""
    level = cut(_count(train, True, order).select("key", F.col("n").alias("raw"), F.col("n").alias("c")))
    levels = [level]
    for o in range(order, 0, -1):
        level = cut(level.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * o)) - 1)).alias("key")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("c")))
        levels.insert(0, level)
    return levels


def _contexts(level: DataFrame, *more: Column) -> DataFrame:
    """(ctx, total, symbols, once, more...) of a level's contexts."""
    return cut(level.groupBy(_context("key").alias("ctx")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("c") == 1).alias("once"), *more))


def _context(key: str) -> Column:
    return F.shiftrightunsigned(key, 8)


def _escapes(contexts: DataFrame) -> np.ndarray:
    alike = contexts.groupBy(_half_octave(F.col("total")).alias("total"), F.least("symbols", F.lit(Q_BINS)).alias("symbols")).agg(F.avg("total").alias("n"), F.avg("once").alias("once"), F.count(F.lit(1)).alias("contexts")).toArrow()  # N_BINS * Q_BINS rows at most
    return escape_table(*(alike.column(c).to_numpy() for c in ("n", "symbols", "once", "contexts")))


def train_trie(train: DataFrame, order: int = ORDER, most: int = CACHE) -> Trie:
    """The trie of a small training text (column text) in memory, pruned to ``most`` nodes."""
    levels = _levels(train, order)
    least = least_kept(levels, "raw", most)
    nodes, contexts, escapes = [], [], []
    for level in levels:
        keep = F.col("raw") >= least
        by_context = _contexts(level, F.count_if(keep).alias("kept"))
        escapes.append(_escapes(by_context))
        nodes.append(sorted_table(level.where(keep).select("key", "c")))
        contexts.append(sorted_table(by_context.where("kept > 0").select("ctx", "total", "symbols")))
    return Trie(nodes, contexts, escapes)


def _step(rest: Column, left: Column, count: Column, escapes: np.ndarray) -> Column:
    """log10 of coding a symbol counted ``count`` times, or an escape where that is null, of ``rest`` counts of ``left`` symbols."""
    row = F.when(rest < 16, rest).otherwise(F.least(8 + 2 * F.log2(F.greatest(rest, F.lit(1))) + 1e-9, F.lit(N_BINS - 1.0))).cast("int")
    new = F.when(rest > 0, F.get(F.lit(escapes.reshape(-1)), row * Q_BINS + F.greatest(F.least(left, F.lit(Q_BINS - 1)), F.lit(0)).cast("int"))).otherwise(1.0)
    p = F.when(count.isNotNull(), (1 - new) * count / F.greatest(rest, F.lit(1))).otherwise(new)
    return F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-9)))


class Model:
    """The whole trie as tables."""

    def __init__(self, train: DataFrame, order: int):
        self.levels = _levels(train, order)
        siblings = Window.partitionBy("ctx")  # 256 at most
        deepest = self.levels[-1].withColumn("ctx", _context("key")).select("*", F.sum("c").over(siblings).alias("total"), F.count(F.lit(1)).over(siblings).alias("symbols"), F.count_if(F.col("c") == 1).over(siblings).alias("once"), (F.row_number().over(siblings.orderBy("key")) == 1).alias("first"))
        self.levels[-1] = deepest = cut(deepest)
        self.contexts = [*(_contexts(level) for level in self.levels[:-1]), deepest.where("first").select("ctx", "total", "symbols", "once")]
        self.escapes = [_escapes(c) for c in self.contexts]
        #: (key, raw, code) of the training text's grams
        self.known = deepest.select("key", "raw", _step(F.col("total"), F.col("symbols"), F.col("c"), self.escapes[-1]).alias("code"))

    def code_unseen(self, grams: DataFrame) -> DataFrame:
        """(key, code) of distinct grams that the training text doesn't have."""
        order = len(self.levels) - 1
        out = []
        todo = grams.select("key", F.lit(0.0).alias("code"), F.lit(0).cast("long").alias("out_n"), F.lit(0).cast("long").alias("out_q"))
        for o in range(order, -1, -1):
            part = F.col("key").bitwiseAND(F.lit((1 << (8 * (o + 1))) - 1))
            node = self.levels[o].select(F.col("key").alias("node"), F.col("c").alias("count"))
            here = todo.withColumn("node", part).withColumn("ctx", _context("node")).join(self.contexts[o].drop("once"), "ctx", "left").join(node, "node", "left")
            step = _step(F.greatest(F.col("total") - F.col("out_n"), F.lit(0)), F.col("symbols") - F.col("out_q"), F.col("count"), self.escapes[o])
            here = cut(here.withColumn("code", F.col("code") + F.when(F.col("total").isNotNull(), step).otherwise(0.0)))
            out.append(here.where("count is not null").select("key", "code"))
            here = here.where("count is null")
            if o:  # what the next shorter context counts of the symbols seen here
                need = here.where("total is not null").select("ctx").distinct()
                low = F.col("node").bitwiseAND(F.lit((1 << (8 * o)) - 1))
                seen = self.levels[o].select(F.col("key").alias("node"), _context("key").alias("ctx")).join(need, "ctx", "left_semi").withColumn("below", low)
                lows = seen.join(self.levels[o - 1].select(F.col("key").alias("below"), "c"), "below").groupBy("ctx").agg(F.sum("c").alias("low"))
                here = here.join(lows, "ctx", "left")
                out_n = F.coalesce("low", "out_n")
            else:
                out_n = F.col("out_n")
            todo = here.select("key", "code", out_n.alias("out_n"), F.coalesce("symbols", "out_q").alias("out_q"))
        out.append(todo.select("key", (F.col("code") - F.log10(F.greatest(256.0 - F.col("out_q"), F.lit(1.0)))).alias("code")))
        return reduce(DataFrame.unionByName, out)


def _half_octave(total: Column) -> Column:
    return F.when(total <= 16, total).otherwise(16 + F.floor(2 * F.log2(total)))


def score(docs: DataFrame, order: int = ORDER, cache: int = CACHE, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    words = cut(_count(train, False))
    end = rows.where(~F.col("held_out")).count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_types = total.n + end, total.v + (end > 0)
    per_token = float(np.log10(n_train + n_types + 1))
    least = least_kept([words], "n", head)
    head_keys, head_counts = sorted_table(words.where(F.col("n") >= least), np.float64)
    model = Model(train, order)
    cached = sorted_table(model.known.where(F.col("raw") >= least_kept([model.known], "raw", cache)).select("key", "code"), np.float64)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((*cached, head_keys, head_counts))
    end_score = float(np.log10(end + 1)) - per_token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_known, codes, keys, counts = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, buf, offs in kernel.blocks(batch, "text", BLOCK):
                start, end_at, first = kernel.words(buf, offs)
                grams, at = line_of(buf, start, end_at, first, order)
                found, each = np.unique(grams, return_inverse=True)
                code, cached = looked_up(grams_known, codes, found)
                sums = np.zeros(len(grams) + 1)
                np.cumsum(code[each], out=sums[1:])
                rare, times, rare_cuts = rare_of(found, each, ~cached, at)
                h = kernel.span_hashes(buf, start, end_at)
                types, which = np.unique(h, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, types), max(len(keys) - 1, 0))
                known = keys[place] == types if len(keys) else np.zeros(len(types), dtype=bool)
                value = np.where(known, np.log10((counts[place] if len(keys) else 0) + 1.0), 0.0)
                base, n_head = np.zeros(len(h) + 1), np.zeros(len(h) + 1, dtype=np.int64)
                np.cumsum(value[which], out=base[1:])
                np.cumsum(known[which], out=n_head[1:])
                n = np.diff(first)
                rest = np.flatnonzero(~known[which])
                cuts = np.searchsorted(rest, first)
                tail = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h[rest].view(np.int64)))
                rare_keys, rare_times = (pa.ListArray.from_arrays(pa.array(rare_cuts.astype(np.int32)), pa.array(x)) for x in (rare.view(np.int64), times.astype(np.int32)))
                many = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(many)), part.column(0), part.column(1), pa.array(n + 1), pa.array(np.diff(n_head[first])), pa.array(np.diff(base[first]) - n * per_token + end_score), pa.array(sums[at[1:]] - sums[at[:-1]]), tail, rare_keys, rare_times],
                    ["row", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "score", "tail", "grams", "times"],
                )
                row += many

    scored = cut(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score double, tail array<long>, grams array<long>, times array<int>"))
    tail = scored.select("row", F.explode("tail").alias("key")).join(words.where(F.col("n") < least), "key").groupBy("row").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.log10(F.col("n") + 1)).alias("base_tail"))
    rare = scored.select("row", "held_out", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", "held_out", F.col("g.grams").alias("key"), F.col("g.times").alias("times"))
    unseen = cut(rare.where("held_out").select("key").distinct().join(model.known, "key", "left_anti"))
    codes = model.known.select("key", "code").unionByName(model.code_unseen(unseen))
    rare = rare.join(codes, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("code")).alias("rare_score"))
    known_end = F.lit(int(end > 0))
    return scored.drop("tail", "grams", "times").join(tail, "row", "left").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base_tail", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
