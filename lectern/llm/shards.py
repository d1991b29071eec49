"""Token output in training order: keyed Feistel slots, range partitions, fixed-stride shards.

The corpus is one stream of token ids (each document and its end token, in the
order of the table's partitions), cut into sequences of ``length`` tokens. A
keyed Feistel permutation of [0, sequences), cycle-walking past values that the
power-of-four domain has too many, gives each sequence its global slot: the
training order is a function of the key, needs no sort of random numbers and
can be inverted. Slots are dealt to range partitions, each of which writes its
shards in order: shard s holds slots s * per_shard and up, each at a fixed
stride, so any slot is one seek and a run resumes from a slot number.

Two passes read the table. The first returns one count for each partition, from
which the driver has every partition's place in the stream; the second tokenizes
again (its words are cached) and shuffles token ids only. Each pass digests what
it saw of a partition, and the second fails if the table changed in between. A
task that is rerun writes the same bytes; files appear by renaming.

Defined cases: null text counts as empty (its end token alone); an empty table
gives no rows and no shards; the last sequence is padded with ``PAD``; repeated
and null ids are documents like any other; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernel
from lectern.llm.session import fresh_path, partitions
from lectern.llm.tokens import END_ID, tokenizer

LENGTH, PER_SHARD = 2048, 1024
PAD = 0
KEY = 0x243F6A8885A308D3
ROUNDS = 6
DTYPE = "<u2"  # the vocabulary has 49,408 ids
SCHEMA = "doc_id long, start long, length long, sequence long, slot long, offset long, shard long, byte_offset long, ids_crc32 long"


def _round(half: np.ndarray, key: int, r: int, mask: int) -> np.ndarray:
    return kernel.mix64(half ^ np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) & np.uint64(mask)


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Keyed bijection of [0, n): balanced Feistel rounds over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = (1 << half) - 1, np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & np.uint64(mask)
        for r in range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, ROUNDS - 1 - r, mask), left
            else:
                left, right = right, left ^ _round(right, key, r, mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _counts(docs: DataFrame, path: str | None) -> list[tuple[int, int, int]]:
    """(partition, tokens, digest) of each partition with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, tokens, digest = tokenizer(path), 0, 0
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text"):
                cuts = tok.count(buf, offs, END_ID)
                tokens += int(cuts[-1])
                digest = _digest(rows, cuts, digest)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), tokens, digest)], ["part", "tokens", "digest"])

    return sorted((r.part, r.tokens, r.digest) for r in docs.mapInArrow(run, "part long, tokens long, digest long").collect())


def _digest(rows: pa.RecordBatch, cuts: np.ndarray, before: int) -> int:
    ids = rows.column(0).fill_null(-1).to_numpy()
    return zlib.crc32(np.diff(cuts).tobytes(), zlib.crc32(np.ascontiguousarray(ids).tobytes(), before))


def write_shards(docs: DataFrame, out: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None, dtype: str = DTYPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``out`` and return a row for each stretch of a document in a sequence.

    ``shard-<number>.bin`` holds ``per_shard`` sequences of ``length`` little-endian ids at a stride of ``length`` ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = _counts(docs, path)
    total = sum(c for _, c, _ in counts)
    sequences = -(-total // length)
    if not total:
        return spark.createDataFrame([], SCHEMA)
    base, at = {}, 0
    for part, tokens, digest in counts:
        base[part] = (at, digest)
        at += tokens
    shards = -(-sequences // per_shard)
    tasks = min(shards, max(partitions(spark), spark.sparkContext.defaultParallelism))
    width = np.dtype(dtype).itemsize

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = tokenizer(path), 0
        at, expected = base.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text"):
                ids, cuts = tok.encode(buf, offs, END_ID)
                seen = _digest(rows, cuts, seen)
                n = np.diff(cuts)
                begin = at + cuts[:-1]
                many = (begin + n - 1) // length - begin // length + 1
                row = np.repeat(np.arange(len(n)), many)
                sequence = begin[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                low = np.maximum(sequence * length, begin[row])
                high = np.minimum((sequence + 1) * length, begin[row] + n[row])
                edges = np.append(low, high[-1]) - at  # stretches follow one another in the stream
                payload = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(ids.astype(dtype))])
                slot = permute(sequence, sequences, key)
                yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard) * tasks // shards, pa.int32()), pa.array(slot), pa.array(low - sequence * length), pa.array(sequence), rows.column(0).take(pa.array(row)), pa.array(low - begin[row]), payload], ["task", "slot", "offset", "sequence", "doc_id", "start", "ids"])
                at += int(cuts[-1])
        if seen != expected:
            raise RuntimeError("the table's partitions changed between the two passes; write it to a table first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        shard, file, temp, filled = -1, None, "", 0

        def close() -> None:
            file.write(np.full((-filled) % (length * width) // width, PAD, dtype=dtype).tobytes())
            file.close()
            store.move(temp, f"{root}/shard-{shard:08d}.bin")

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                slot, offset, payload = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(6)
                sizes, crc = [], []
                for i, raw in enumerate(payload):
                    raw = raw.as_buffer()
                    if slot[i] // per_shard != shard:
                        if file:
                            close()
                        shard, filled = int(slot[i] // per_shard), 0
                        temp = f"{root}/.{uuid.uuid4().hex}"
                        file = store.open_output_stream(temp)
                    place = (int(slot[i]) % per_shard * length + int(offset[i])) * width
                    if place != filled:  # only the corpus's last sequence is short
                        file.write(np.full((place - filled) // width, PAD, dtype=dtype).tobytes())
                    file.write(raw)
                    filled = place + len(raw)
                    sizes.append(len(raw) // width)
                    crc.append(zlib.crc32(raw))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4), batch.column(5), pa.array(sizes, pa.int64()), batch.column(3), batch.column(1), batch.column(2), pa.array(slot // per_shard), pa.array((slot % per_shard * length + offset) * width), pa.array(crc, pa.int64())],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )
            if file:
                close()
        finally:
            if file and not file.closed:
                file.close()
                store.delete_file(temp)

    stretches = docs.mapInArrow(cut_up, "task int, slot long, offset long, sequence long, doc_id long, start long, ids binary")
    return stretches.repartitionById(tasks, "task").sortWithinPartitions("slot", "offset").mapInArrow(write, SCHEMA)


def read_slots(out: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: str = DTYPE) -> Iterator[np.ndarray]:
    """The sequences of slots first..first+count-1: one seek, then a sequential read."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out)
    stride = length * np.dtype(dtype).itemsize
    slot = first
    while slot < first + count:
        with store.open_input_file(f"{root}/shard-{slot // per_shard:08d}.bin") as file:
            file.seek(slot % per_shard * stride)
            while slot < first + count:
                raw = file.read(stride)
                if len(raw) < stride:
                    return
                yield np.frombuffer(raw, dtype=dtype)
                slot += 1
                if slot % per_shard == 0:
                    break


def shards_below_shared(docs: DataFrame) -> DataFrame:
    """``write_shards`` to a new folder in the shared one."""
    where = fresh_path(docs.sparkSession, "shards")
    return write_shards(docs, where if "://" in where or where.startswith("file:") else f"file://{where}")
