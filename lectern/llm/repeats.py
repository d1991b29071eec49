"""Suffix-array deduplication: remove bytes covered by a long string that starts anywhere twice.

Suffix order is only needed among places that can repeat. The least hash of 48
bytes in each run of ``length`` bytes picks an anchor, so equal strings of
``length`` bytes have equal anchors, and every such string belongs to exactly
one anchor's window of starts. Then:

1. Equal windows are aggregated by (anchor, content): one stands for all of them,
   with their number, before any text is sent; groups of copies and common
   passages are one window, whatever their number. An anchor at one place only
   can't hold a repeat.
2. All other windows go to shards, by anchor. Shards have about ``SHARD`` bytes of
   text. A shard's suffixes are put in order by induced sorting (``suffix``);
   neighbours whose common prefix has ``length`` bytes are repeated, and so is a
   suffix that stands for several. The windows found are joined with all equal
   ones.
3. Repeated starts become byte runs in their documents; only documents that have
   some are read again.

Rows are known by their place in the scan (partition, row), so repeated and null
ids are different documents; a reread row of another length is an error.

Defined cases: null text counts as empty; texts shorter than ``length`` lose
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import idset, kernel
from lectern.llm.session import cut, partitions
from lectern.llm.suffix import suffix_order

LENGTH = 400
GRAM = 48
SHARD = 2 << 20
_U = np.uint64
_FAR = np.uint64((1 << 64) - 1)


def _spark_hash(value: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << _U(r)) | (x >> _U(64 - r))
    h = turn((_U(42) + p5 + _U(8)) ^ (turn(value.astype(np.int64).view(_U) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return h ^ (h >> _U(32))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` successive values."""
    pick = np.minimum if least else np.maximum
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    whole = np.full(blocks * width, _FAR if least else _U(0), dtype=_U)
    whole[: len(values)] = values
    whole = whole.reshape(blocks, width)
    ahead = pick.accumulate(whole, axis=1).reshape(-1)
    back = pick.accumulate(whole[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, number of starts, 16-byte content hash, whether the anchor occurs in it twice) of one text's windows; each start of ``length`` bytes is in one."""
    starts = len(buf) - length + 1
    if starts <= 0:
        return (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), _U), np.zeros(0, bool))
    hashes = kernel.rolling(buf, gram)
    low = _sliding(hashes, length - gram + 1, True)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    many = np.diff(np.append(first, starts))
    twice, grams = np.zeros(len(first), dtype=bool), many + length - gram
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(np.cumsum(grams[at:]), 1 << 21)) + at)
        part = slice(at, end)
        equal = hashes[kernel.ragged(first[part], grams[part])] == np.repeat(low[first[part]], grams[part])
        twice[part] = np.add.reduceat(equal, np.cumsum(grams[part]) - grams[part], dtype=np.int64) > 1
        at = end
    raw = memoryview(np.ascontiguousarray(buf))
    content = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (first + many - 1 + length).tolist(), strict=True)])
    return low[first], first, many, np.frombuffer(content, _U).reshape(-1, 2), twice


def _uids(rows: int, at: int) -> np.ndarray:
    return (np.int64(TaskContext.get().partitionId()) << np.int64(40)) + at + np.arange(rows)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """(uid, doc_id, n_bytes, sha256, windows) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text"):
                found = [anchors(buf[a:b], length) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                cuts = np.append(0, np.cumsum([len(f[0]) for f in found])).astype(np.int32)
                key, first, many, content, twice = (np.concatenate([f[i] for f in found]) for i in range(5))
                content = np.ascontiguousarray(content.T).view(np.int64)
                windows = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(content[0]), pa.array(content[1]), pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(twice)], ["key", "content", "check", "first", "many", "twice"])
                raw = memoryview(np.ascontiguousarray(buf))
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_uids(rows.num_rows, at)), rows.column(0), pa.array(np.diff(offs)), pa.array(digests), pa.ListArray.from_arrays(pa.array(cuts), windows)], ["uid", "doc_id", "n_bytes", "sha256", "windows"])
                at += rows.num_rows

    return docs.mapInArrow(run, "uid long, doc_id long, n_bytes long, sha256 string, windows array<struct<key:long,content:long,check:long,first:int,many:int,twice:boolean>>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, text, and the columns of ``wanted``) of the rows that ``wanted`` (uid, n_bytes, ...) has."""
    shared = docs.sparkSession.sparkContext.broadcast(idset.bitmap(wanted.select(F.col("uid").alias("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            uid = _uids(batch.num_rows, at)
            at += batch.num_rows
            keep = pa.array(idset.passes(shared.value, _place(uid)))
            text = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uid).filter(keep), text.filter(keep)], ["uid", "text"])

    return docs.mapInArrow(run, "uid long, text binary").join(wanted.hint("merge"), "uid").where(F.when(F.octet_length(F.coalesce("text", F.lit(b""))) == F.col("n_bytes"), True).otherwise(F.raise_error(F.lit("the table changed between two scans")).cast("boolean")))


def _place(uid: np.ndarray) -> np.ndarray:
    return (_spark_hash(uid).view(np.int64) % np.int64(idset.BITS)).astype(np.int64)


def repeated_starts(windows: list[tuple[bytes, int]], length: int = LENGTH, many_times: list[bool] | None = None) -> list[np.ndarray]:
    """For windows (text, number of starts): which starts' strings of ``length`` bytes occur at another start. A window that stands for several of equal content counts as often."""
    sizes = np.array([len(t) for t, _ in windows])
    text = np.zeros(int(sizes.sum()) + len(windows), dtype=np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[kernel.ragged(begin, sizes)] = np.frombuffer(b"".join(t for t, _ in windows), dtype=np.uint8).astype(np.uint16) + 1
    starts = np.array([m for _, m in windows])
    times = np.zeros(len(text), dtype=np.int8)  # of the suffixes that are starts; 2 for several
    times[kernel.ragged(begin, starts)] = np.repeat(1 + np.array(many_times if many_times is not None else [False] * len(windows), dtype=np.int8), starts)
    order = suffix_order(text, length)
    order = order[times[order] > 0].astype(np.int64)
    prefix = kernel.span_sums(kernel.prefix_sums(text), order, order + length)
    common = np.append(False, prefix[1:] == prefix[:-1]) if len(order) else np.zeros(0, dtype=bool)
    twice = times > 1
    twice[order[common]] = True
    twice[order[:-1][common[1:]]] = True
    return [twice[b : b + m] for b, (_, m) in zip(begin.tolist(), windows, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _ranges(docs: DataFrame, seen: DataFrame, length: int) -> DataFrame:
    """(uid, n_bytes, first, many): ranges of repeated starts."""
    place = ["key", "content", "check"]
    windows = seen.select("uid", "n_bytes", F.explode("windows").alias("w")).select("uid", "n_bytes", "w.*")
    contents = cut(windows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first", "many", "n_bytes", "twice")).alias("one")))
    keys = contents.groupBy("key").agg(F.sum("n").alias("places"), F.max("one.twice").alias("inner")).where("places > 1 or inner").select("key")
    sent = cut(contents.join(keys, "key", "left_semi").select(*place, "n", "one.*"))
    total = sent.agg(F.coalesce(F.sum(F.col("many") + length), F.lit(0))).first()[0]
    if not total:
        return windows.select("uid", "n_bytes", "first", "many").limit(0)
    shards = -(-total // SHARD)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    wanted = sent.groupBy("uid", "n_bytes").agg(F.collect_list(F.struct(shard, *place, (F.col("n") > 1).alias("many_times"), "first", "many")).alias("cuts"))
    names = ["shard", *place, "many_times", "many", "text"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, cuts = memoryview(batch.column(0)[i].as_buffer()), batch.column(1)[i].values
                first, many = cuts.field(5).to_pylist(), cuts.field(6)
                pieces = [bytes(raw[a : a + m - 1 + length]) for a, m in zip(first, many.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(cuts.field(j) for j in range(5)), many, pa.array(pieces, pa.binary())], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None

        def ended() -> Iterator[pa.RecordBatch]:
            found = []
            for (_, many, key, content, check, many_times), flags in zip(held, repeated_starts([h[:2] for h in held], length, [h[5] for h in held]), strict=True):
                found += [(key, content, check, int(a), int(m)) for a, m in zip(*_runs(flags), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (*[pa.int64()] * 3, *[pa.int32()] * 2), strict=True)], [*place, "after", "long"])

        for batch in batches:
            for s, key, content, check, many_times, many, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if held:
                        yield from ended()
                    held, shard = [], s
                held.append((text, many, key, content, check, many_times))
        if held:
            yield from ended()

    spread = max(1, min(shards, 4 * partitions(docs.sparkSession)))
    pieces = _texts(docs, wanted).select("text", "cuts").mapInArrow(cut_out, "shard int, key long, content long, check long, many_times boolean, many int, text binary")
    task = (F.col("shard") * F.lit(spread) / F.lit(shards)).cast("int")
    found = cut(pieces.withColumn("task", task).repartitionById(spread, "task").sortWithinPartitions("shard").drop("task").mapInArrow(sort, "key long, content long, check long, after int, long int"))
    return windows.join(found, place).select("uid", "n_bytes", (F.col("first") + F.col("after")).alias("first"), F.col("long").alias("many"))


def removed_runs(docs: DataFrame, seen: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, n_bytes, starts): the repeated starts of each row that has any, as ranges."""
    return _ranges(docs, seen, length).groupBy("uid", "n_bytes").agg(F.collect_list(F.struct("first", "many")).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``kept`` (the bytes left) if asked for."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(_scan(docs, length))
    wanted = cut(removed_runs(docs, seen, length))
    names = ["uid", "n_removed", "n_spans", "digest", *(["kept"] if with_text else [])]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text, starts = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8), batch.column(3)[i].values
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                first, many = starts.field(0).to_numpy(), starts.field(1).to_numpy()
                np.add.at(edge, first, 1)
                np.add.at(edge, first + many - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = text[~gone].tobytes()
                out.append((batch.column(0)[i].as_py(), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names)

    stripped = _texts(docs, wanted).select("uid", "text", "n_bytes", "starts").mapInArrow(strip, "uid long, n_removed long, n_spans long, digest string" + ", kept binary" * with_text)
    zero = F.lit(0).cast("long")
    out = seen.drop("windows").join(stripped, "uid", "left")
    kept = [F.col("kept")] if with_text else []
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("digest", "sha256").alias("kept_sha256"), *kept)


def remove_repeats_sql() -> str:
    """``remove_repeats`` of ``documents`` in DuckDB SQL: every string of 400 bytes by its digest, for small tables."""
    return """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents), w as (select doc_id, i, hash(substring(h, 2 * i + 1, 800)) as m from (select doc_id, h, unnest(range(0, greatest(n - 399, 0))) as i from d)),
f as (select m from w group by 1 having count(*) > 1), v as (select doc_id, i, md5(substring(h, 2 * i + 1, 800)) as m from (select doc_id, i from w semi join f using (m)) join d using (doc_id)),
c as (select m from v group by 1 having count(*) > 1), g as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from v semi join c using (m)), k as (select doc_id, i, sum(case when gap <= 400 then 0 else 1 end) over (partition by doc_id order by i) as run from g),
r as (select doc_id, run, min(i) as a, max(i) + 400 as b from k group by 1, 2), q as (select doc_id, h, n, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before, row_number() over (partition by doc_id order by a desc) as last from d left join r using (doc_id)),
o as (select doc_id, any_value(n) as n, count(a) as spans, coalesce(sum(b - a), 0) as gone, string_agg(case when a is null then h else h[2 * before + 1:2 * a] || case when last = 1 then h[2 * b + 1:] else '' end end, '' order by a) as left_ from q group by 1)
select doc_id, n::bigint as n_bytes, gone::bigint as n_removed, spans::bigint as n_spans, sha256(unhex(left_)) as kept_sha256 from o"""
