"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint keeps the k smallest distinct 48-bit hashes of a document's
5-word shingles. Sketches of parts merge into the sketch of the whole (the k
smallest of the union), and two of them estimate resemblance, containment and
the number of distinct shingles. The string form is base64 of big-endian 6-byte
values in ascending order, so equal shingle sets give equal strings.

Defined cases: null text counts as empty; a text without words has the empty
fingerprint; two empty fingerprints are alike (1.0), an empty and a full one
are not (0.0); equal ids are ordered by text; a null id sorts first; a lone row is
its own next one; an empty table gives no rows; other columns are ignored; a very
long text is a block of its own, whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernel

K = 128
BITS = 48
BUCKET_BYTES, ROW_BYTES = 8 << 20, 64
_FIRST = -(1 << 63)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct 48-bit hashes."""
    h = hashes >> np.uint64(64 - BITS)
    if len(h) > 8 * k:  # all but a few values can't be among the k smallest distinct ones
        bound = int(np.partition(h, 4 * k)[4 * k])
        low = np.unique(h[h <= np.uint64(bound)])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while both sets are smaller than k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twin = both[1:] == both[:-1]
    distinct = len(both) - int(twin.sum())
    if distinct <= k:
        return int(twin.sum()) / distinct
    keep = np.ones(len(both), dtype=bool)
    keep[1:] = ~twin
    last = both[np.flatnonzero(keep)[k - 1]]
    return int((both[1:][twin] <= last).sum()) / k


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, j * union / distinct_count(a, k))


def _sketches(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    h, first = kernel.document_shingles(buf, offs)
    at = first.tolist()
    return [sketch(h[i:j], k) for i, j in zip(at, at[1:], strict=False)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, fingerprint, n_shingles estimate) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text"):
                found = _sketches(buf, offs, k)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([encode(s) for s in found], pa.string()), pa.array([distinct_count(s, k) for s in found], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, key, doc_id, text): each bucket is a range of ids, in one partition and in order.

    The row after a bucket's last one is the first row of the next bucket that
    has any. As its guests a bucket gets the rows with that row's id, and the
    last bucket those with the least id of all. There is a bucket for each
    ``BUCKET_BYTES`` of text, by quantiles of the ids; its bound and its least id
    are all that comes to the driver and goes to the tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + ROW_BYTES), F.lit(0))).first()[0]
    wide = max(1, -(-total // BUCKET_BYTES))
    ids = rows.select("key")
    bounds = np.unique(np.array(ids.approxQuantile("key", [i / wide for i in range(1, wide)], 0.25 / wide) if wide > 1 else [], dtype=np.int64))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(bounds)

    @F.arrow_udf("int")
    def bucket_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, key.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    firsts = ids.withColumn("bucket", bucket_of("key")).groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").toArrow()
    least, bucket = firsts.column("key").to_numpy(), firsts.column("bucket").to_numpy()
    hosts = context.broadcast((least, np.roll(bucket, 1)))  # the bucket before, for the first id of all the last one

    @F.arrow_udf("int")
    def guest_of(key: pa.Array) -> pa.Array:
        key = key.to_numpy(zero_copy_only=False)
        least, before = hosts.value
        at = np.minimum(np.searchsorted(least, key), len(least) - 1)
        return pa.array(before[at], mask=least[at] != key)

    own = rows.select(bucket_of("key").alias("bucket"), F.lit(False).alias("guest"), "key", "doc_id", "text")
    guests = rows.select(guest_of("key").alias("bucket"), F.lit(True).alias("guest"), "key", "doc_id", "text").where("bucket is not null")
    return own.union(guests).repartitionById(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "guest", "key", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n/2) code points replaced by as many
    first ones (or all) of the next document by ascending id. One shuffle of the
    texts by ranges of ids; a task streams its rows and holds one row over.
    Rows that repeat an id follow one another by text.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text"):
                ids, texts = rows.column(3).to_pylist(), rows.column(4).to_pylist()
                buckets, guests = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                line = [*([held] if held else []), *zip(buckets, guests, ids, texts, _sketches(buf, offs, k), strict=True)]
                held, out, edits = line[-1], [], []
                for this, after in zip(line, line[1:], strict=False):
                    if this[1]:
                        continue
                    assert this[0] == after[0], "a bucket lacks its guest"
                    n = len(this[3])
                    edits.append(this[3][: n - n // 2] + after[3][: n // 2])
                    out.append((this, after))
                if not out:
                    continue
                changed = _sketches(*kernel.encode_spans_as_text(edits), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t[2] for t, _ in out], pa.int64()),
                        pa.array([len(t[3]) for t, _ in out], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                        pa.array([encode(t[4]) for t, _ in out], pa.string()),
                        pa.array([encode(s) for s in changed], pa.string()),
                        pa.array([resemblance(t[4], s, k) for (t, _), s in zip(out, changed, strict=True)], pa.float64()),
                        pa.array([resemblance(t[4], a[4], k) for t, a in out], pa.float64()),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
