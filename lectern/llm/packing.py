"""Sequence packing: length patterns fitted by non-negative least squares.

1. Documents are tokenized and cut into pieces of at most ``limit`` tokens.
2. The histogram of piece lengths (``limit`` counts at most, whatever the
   corpus) goes to the driver. Lengths are rounded up to coarse bins, patterns
   of up to three bins that fill a sequence are enumerated, and non-negative
   least squares fits how often each is used. Counts are rounded down to what
   the histogram supports. A pattern's last piece takes up what rounding left.
3. Pieces left over are packed by best fit, also into what the patterns left
   free. This runs on the histogram: whole groups of equal gaps at once.
4. The plan maps (length, rank among pieces of that length) to a sequence and
   an offset. Ranks are given in salted parts of each length, so a length that
   a third of all pieces have is spread over many tasks.

Defined cases: null text counts as empty and has the end token alone; equal or
null ids are separate documents (their rows are kept apart by a row number
inside the rank); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernel
from lectern.llm.session import cut
from lectern.llm.tokens import END_ID, tokenizer

LIMIT = 4096
BINS = 128
SALTS = 64
#: Bytes of text that are tokenized at once.
TEXT_BYTES = 1 << 18
#: The word cache has this part of its bounds: workers of the pipeline share an executor with what earlier stages left.
CACHE_SHARE = 8


def pieces(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, CACHE_SHARE)
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text", TEXT_BYTES):
                ids, cuts = tok.encode(buf, offs, END_ID)
                raw = memoryview(ids.astype("<u4")).cast("B")
                n = np.diff(cuts)
                many = -(-n // limit)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * limit
                length = np.minimum(n[row] - start, limit)
                at = (cuts[:-1][row] + start) * 4
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    target = a.T @ b
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = target - a.T @ (a @ x)
        gain[on] = -np.inf
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= tolerance:
            break
        on[best] = True
        while True:
            z = np.zeros_like(x)
            part = np.flatnonzero(on)
            inner = a[:, part].T @ a[:, part]
            z[part] = np.linalg.solve(inner + 1e-12 * np.trace(inner) * np.eye(len(part)), target[part])
            if (z[on] > 0).all():
                x = z
                break
            low = on & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            on &= x > 1e-10
            x[~on] = 0
    return x


def fit_patterns(counts: np.ndarray, limit: int, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats): how often each pattern of up to three bins is to be used."""
    width = -(-limit // bins)
    n_bins = -(-limit // width)
    have = np.zeros(n_bins + 1)
    for length in np.flatnonzero(counts).tolist():
        have[-(-length // width)] += counts[length]
    there = [b for b in range(1, n_bins + 1) if have[b]]
    full = limit // width
    found = [(b,) for b in there if b >= full]
    present = set(there)
    for a in there:
        for b in there:
            if b < a:
                continue
            if a + b == full:
                found.append((a, b))
            c = full - a - b
            if c >= b and c in present:
                found.append((a, b, c))
    if not found:
        return []
    matrix = np.zeros((n_bins + 1, len(found)))
    for j, pattern in enumerate(found):
        for b in pattern:
            matrix[b, j] += 1
    scale = max(1.0, have.max())
    wanted = np.floor(nnls(matrix, have / scale) * scale + 1e-6).astype(np.int64)
    left, out = have.astype(np.int64), []
    for j in np.argsort(-wanted, kind="stable").tolist():
        need = defaultdict(int)
        for b in found[j]:
            need[b] += 1
        use = min(int(wanted[j]), *(int(left[b]) // k for b, k in need.items()))
        if use > 0:
            out.append((found[j], use))
            for b, k in need.items():
                left[b] -= use * k
    return out


def plan(histogram: dict[int, int], limit: int = LIMIT, bins: int = BINS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, count, first sequence, offset)], number of sequences).

    The pieces of a length with ranks first..first+count-1 go to consecutive
    sequences, all at the same offset. The size depends on ``limit`` and ``bins``.
    """
    counts = np.zeros(limit + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    taken, width = np.zeros(limit + 1, dtype=np.int64), -(-limit // bins)
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, sequences)
    sequences = 0

    def put(length: int, n: int, first: int, free: int) -> None:
        out.append((length, int(taken[length]), n, first, limit - free))
        taken[length] += n

    for pattern, repeats in fit_patterns(counts, limit, bins):
        open_runs = [(sequences, repeats, limit)]
        sequences += repeats
        for b, last in ((b, i == len(pattern) - 1) for i, b in enumerate(sorted(pattern, reverse=True))):
            filled = []
            for first, n, free in open_runs:  # the last piece is the longest that fits what rounding left free
                for length in range(free if last else min(b * width, free), (b - 1) * width, -1):
                    use = min(n, int(counts[length] - taken[length]))
                    if use > 0:
                        put(length, use, first, free)
                        filled.append((first, use, free - length))
                        first, n = first + use, n - use
                if n:
                    filled.append((first, n, free))
            open_runs = filled
        for first, n, free in open_runs:
            groups[free].append((first, n))
    gaps = sorted(groups)
    for length in range(limit, 0, -1):
        left = int(counts[length] - taken[length])
        while left:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                each = limit // length
                whole = -(-left // each)
                free = limit
                if whole * each > left and whole > 1:
                    whole -= 1
                if whole == 1 and left < each:
                    each = left
                for _ in range(each):
                    put(length, whole, sequences, free)
                    free -= length
                left -= whole * each
                if free not in groups or not groups[free]:
                    bisect.insort(gaps, free)
                groups[free].append((sequences, whole))
                sequences += whole
                continue
            free = gaps[i]
            first, n = groups[free].pop()
            if not groups[free]:
                gaps.pop(i)
            use = min(n, left)
            put(length, use, first, free)
            left -= use
            for f, start, m in ((free - length, first, use), (free, first + use, n - use)):
                if m:
                    if not groups[f]:
                        bisect.insort(gaps, f)
                    groups[f].append((start, m))
    return out, sequences


def pack(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, salts: int = SALTS) -> DataFrame:
    """``pieces`` with (sequence_id, offset): each sequence is filled without gaps, none beyond ``limit`` tokens."""
    cutted = cut(pieces(docs, limit, id_col, text_col, path).withColumn("salt", F.abs(F.xxhash64("doc_id", "piece", "ids_crc32") % salts)))
    parts = cutted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    steps, _ = plan(histogram, limit)
    steps.sort()
    table = np.array(steps, dtype=np.int64).reshape(-1, 5)
    ranked = cutted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        if not len(steps):
            return
        wide = int(steps[:, 1].max()) + int(steps[:, 2].max()) + 1
        keys = steps[:, 0] * wide + steps[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])], names)

    return ranked.select(*names[:5], "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
