"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, so what is
   broadcast has a fixed bound and a larger benchmark takes more passes.
2. Seeds are the word 3-grams of the items. Their document frequencies are
   counted over the whole corpus, and an item's common seeds (in more than
   ``COMMON`` of all documents) are dropped if they are also in its more common
   half and over twice as frequent as the median seed of their stretch of the
   item. Stretches are so
   short that any copied part of ``LEAST`` of an item has a whole one, so parts
   of an item that leaked into very many documents are still found by its seeds.
3. A task streams its documents; where seeds hit, the stretch of words around
   them is aligned with the item (match 2, mismatch -1, gap -1), all stretches
   of a block of text at once.
4. A document and an item are reported if the best local alignment has at least
   ``LEAST`` of the score of a full copy: verbatim, edited and partly
   paraphrased copies pass, a few words in common don't.

Words are lower-cased (ASCII and Latin-1 letters), and closing and opening ASCII marks don't belong to them.
One pass counts, one aligns; texts are never shuffled and a third of all
documents with one passage is a third of the rows, in whatever tasks read them.

Defined cases: null text counts as empty; items without words, or with a null
id, are left out; an item of fewer than three words is found only in documents
that consist of it; rows that repeat an item id count as one item (best score
wins); ``leaks`` reports rows that repeat a document id as one document, with its
best score, and ``decontaminate`` judges every row by its own text, whatever its
id; a score that equals the least one is a leak, and of equally good alignments
the first in the text is reported; a very long text is a block by itself; either
table may be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lectern.llm import kernel

SEED = 3
COMMON = 0.001
LEAST = 0.4
MATCH, MISMATCH, GAP = 2, 1, 1
BLOCK_WORDS = 1_000_000
BATCH_CELLS = 1 << 16
TEXT_BYTES = 1 << 18
SCHEMA = "doc_id long, item_id long, score long, coverage double, first_word long, last_word long"

_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def bare_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the words without up to four marks at either end; words of marks alone are left out."""
    if len(buf) > 1:  # capitals of the Latin-1 letters, as UTF-8
        low = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf = buf.copy()
        buf[1:][low] += 32
    start, end, first = kernel.words(buf, offs)
    for _ in range(4):
        end = end - ((end > start) & _MARK[buf[np.maximum(end - 1, 0)]])
        start = start + ((end > start) & _MARK[buf[np.minimum(start, max(len(buf) - 1, 0))]] if len(buf) else 0)
    there = end > start
    kept = np.zeros(len(there) + 1, dtype=np.int64)
    np.cumsum(there, out=kept[1:])
    return kernel.span_hashes(buf, start[there], end[there]), kept[first]


class Items:
    """A block of benchmark items as arrays: what each task needs."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.words, self.first = bare_words(*kernel.encode_spans_as_text(texts))
        self.ids = np.array(ids, dtype=np.int64)
        grams, first = kernel.shingle_hashes(self.words, self.first, SEED)
        order = np.argsort(grams, kind="stable")
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        at = np.arange(len(grams)) - first[:-1][item]
        self.seeds, begin = np.unique(grams[order], return_index=True)
        self.begin = np.append(begin, len(grams))
        self.item, self.at = item[order], at[order]

    def keep_rare(self, frequency: np.ndarray, documents: int, least: float = LEAST) -> None:
        """Drop postings of common seeds, never from the rarer half of an item's, nor where their whole stretch of the item is about as common."""
        df = np.repeat(frequency, np.diff(self.begin))
        order = np.lexsort((self.at, df, self.item))
        many = np.bincount(self.item, minlength=len(self.ids))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)
        length = np.maximum((least * np.diff(self.first) - SEED + 1) // 2, 1).astype(np.int64)
        stretch = self.at // length[self.item]
        order = np.lexsort((df, stretch, self.item))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(self.item[order]) != 0) | (np.diff(stretch[order]) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        median = np.empty(len(order), dtype=np.int64)
        median[order] = np.repeat(df[order][begin + size // 2], size)
        keep = (df <= max(COMMON * documents, 2)) | (2 * rank < many[self.item]) | (df <= 2 * median)
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.begin))[keep]
        self.item, self.at = self.item[keep], self.at[keep]
        there, begin = np.unique(seed, return_index=True)
        self.seeds, self.begin = self.seeds[there], np.append(begin, len(seed))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in grams, seed) of the grams that are seeds."""
        if not len(self.seeds) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == grams)
        return hit, at[hit]


def smith_waterman(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of it in the text) of each item with its text, for arrays of word hashes."""
    many, rows, width = len(items), max(map(len, items)), max(map(len, texts))
    grid = np.zeros((many, width), dtype=np.uint64)
    side = np.zeros((many, rows), dtype=np.uint64)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        side[i, : len(x)], grid[i, : len(y)] = x, y
    height = np.array([len(x) for x in items])
    beyond = np.arange(width)[None, :] >= np.array([len(y) for y in texts])[:, None]
    slope = (GAP * np.arange(width + 1)).astype(np.int32)
    last = np.zeros((many, width + 1), dtype=np.int32)
    best, where = np.zeros(many, dtype=np.int32), np.zeros(many, dtype=np.int64)
    for r in range(rows):
        step = np.where((grid == side[:, r : r + 1]) & ~beyond, MATCH, -MISMATCH).astype(np.int32)
        now = np.zeros_like(last)
        np.maximum(last[:, :-1] + step, last[:, 1:] - GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        last = np.maximum.accumulate(now + slope, axis=1) - slope
        top = last.argmax(axis=1)
        value = np.where(height > r, last[np.arange(many), top], 0)
        better = value > best
        best, where = np.where(better, value, best), np.where(better, top, where)
    return best, where


def _stretches(items: Items, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, from word, to word) around runs of seed hits."""
    grams, gram_first = kernel.shingle_hashes(words, first, SEED)
    hit, seed = items.find(grams)
    if not len(hit):
        return []
    doc = np.searchsorted(gram_first, hit, side="right") - 1
    pos = hit - gram_first[doc]
    many = items.begin[seed + 1] - items.begin[seed]
    post = kernel.ragged(items.begin[seed], many)
    doc, pos, item, at = np.repeat(doc, many), np.repeat(pos, many), items.item[post], items.at[post]
    order = np.lexsort((pos, item, doc))
    doc, pos, item, at = doc[order], pos[order], item[order], at[order]
    size = np.diff(items.first)[item]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > size[1:])
    begin = np.flatnonzero(new)
    slack = size[begin] // 4 + SEED
    low = np.maximum(np.minimum.reduceat(pos - at, begin) - slack, 0)
    high = np.minimum(np.maximum.reduceat(pos - at + size, begin) + slack, np.diff(first)[doc[begin]])
    return list(zip(doc[begin].tolist(), item[begin].tolist(), low.tolist(), high.tolist(), strict=True))


def _aligned(items: Items, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(document, item): (score, first word of the stretch, last word of the alignment)}, the best of each."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    todo = _stretches(items, words, first)
    todo.sort(key=lambda x: x[3] - x[2])
    at = 0
    while at < len(todo):
        take = max(1, BATCH_CELLS // max(1, todo[min(at + 63, len(todo) - 1)][3] - todo[min(at + 63, len(todo) - 1)][2]))
        part = todo[at : at + take]
        at += take
        score, end = smith_waterman([items.words[items.first[i] : items.first[i + 1]] for _, i, _, _ in part], [words[first[d] + a : first[d] + b] for d, _, a, b in part])
        for (d, i, a, _), s, e in zip(part, score.tolist(), end.tolist(), strict=True):
            if s > found.get((d, i), (0,))[0]:
                found[d, i] = (s, a, a + e)
    return found


def _blocks_of(benchmark: DataFrame) -> Iterator[Items]:
    ids, texts, words = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        n = len(row.t.split())
        if not n:
            continue
        if ids and words + n > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, words = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        words += n
    if ids:
        yield Items(ids, texts)


def _frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """(documents with each seed, documents), over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total, documents = np.zeros(len(items.seeds), dtype=np.int64), 0
        for batch in batches:
            for _, buf, offs in kernel.blocks(batch, "text", TEXT_BYTES):
                grams, first = kernel.shingle_hashes(*bare_words(buf, offs), SEED)
                hit, seed = items.find(grams)
                doc = np.searchsorted(first, hit, side="right") - 1
                total += np.bincount(np.unique(doc * len(total) + seed) % max(len(total), 1), minlength=len(total))
                documents += len(offs) - 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(total[there], documents))], ["seed", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    seed, n = found.column("seed").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(len(items.seeds), dtype=np.int64)
    out[seed[seed >= 0]] = n[seed >= 0]
    return out, int(n[seed < 0].sum())


def _leaks_of(docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        full = MATCH * np.diff(items.first)
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text", TEXT_BYTES):
                found = [(d, int(items.ids[i]), s, round(s / int(full[i]), 6), a, b) for (d, i), (s, a, b) in _aligned(items, *bare_words(buf, offs)).items() if s >= least * full[i]]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cols[0])), *[pa.array(c, pa.float64() if n == "coverage" else pa.int64()) for c, n in zip(cols[1:], names[1:], strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, coverage, first_word, last_word) of each document and item that it holds a copy of."""
    out = None
    for items in _blocks_of(benchmark):
        items.keep_rare(*_frequencies(docs, items), least)
        part = _leaks_of(docs, items, least)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.max_by(F.struct("score", "coverage", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose texts hold no copy of any item. A row is judged where it is read; nothing is shuffled."""
    out = docs
    for items in _blocks_of(benchmark):
        items.keep_rare(*_frequencies(docs, items), least)
        out = _clean(out, items, least)
    return out


def _clean(docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        full = MATCH * np.diff(items.first)
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, text, TEXT_BYTES):
                keep = np.ones(rows.num_rows, dtype=bool)
                keep[[d for (d, i), (s, _, _) in _aligned(items, *bare_words(buf, offs)).items() if s >= least * full[i]]] = False
                yield rows.filter(pa.array(keep))

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
