"""Near-duplicates: SetSketch registers, banded, estimated by likelihood, verified on full sets.

A document is the set of its distinct 5-word shingles. Register i keeps the
least of its shingles' i-th exponential variates, rounded down to the power
``-K`` of base ``B`` and truncated, as the integer K. Registers of parts merge
by maximum. Two sets with Jaccard similarity J agree in about a share J of
their registers, so four registers make a band, and 32 bands miss a pair at
J = 0.75 with probability 5e-6.

Rows and links stay proportional to the input:

* Documents of equal sets are one class, represented by the smallest id, from
  the first aggregation on; a group of copies is one row afterwards.
* A bucket (documents that agree in a band) is not expanded into pairs. Every
  member is compared with the bucket's smallest member; what verifies is
  connected at once.
* Where the members of one smallest member still fall into several components,
  those outside the largest one are compared with all others in blocks: on
  registers, then on whole sets, which are intersected block by block inside a
  task, so that pairs are never rows. No link is lost to a cap, and pairs inside
  one component are never made.

Registers of a pair are judged jointly: with both set sizes known, the numbers
of greater, smaller and equal registers have a likelihood in J alone. Pairs that
pass are verified on the whole sets: 100 * intersection >= 75 * union.

Defined cases: a null text counts as empty; a text without words has no
shingles and links with nothing; one with fewer than five words has its whole
sequence as one shingle; rows that repeat an id are judged by their texts (where
an id has several, links of any of them are links of the id); a row with a null id links with nothing, has a null component and is kept; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernel
from lectern.llm.components import connected_components
from lectern.llm.idset import texts_of
from lectern.llm.session import cut, partitions

ROWS, BANDS = 4, 32
M = ROWS * BANDS
B, A, Q = 1.02, 20.0, (1 << 16) - 2
PERCENT = 75
SIGMAS = 5.0
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Bytes of text that are sketched at once.
TEXT_BYTES = 1 << 18

_MULTIPLY, _ADD = kernel.stream64(M, 31) | np.uint64(1), kernel.stream64(M, 37)
_BAND = kernel.stream64(BANDS, 41)


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, M) SetSketch registers of ragged shingle hashes."""
    low = np.empty((M, len(first) - 1), dtype=np.uint64)
    for i in range(M):
        low[i] = kernel.least(hashes * _MULTIPLY[i] + _ADD[i], first)
    u = (low.T.astype(np.float64) + 0.5) / 2.0**64
    level = np.floor(1 - np.log(np.maximum(-np.log1p(-np.minimum(u, 1 - 1e-16)), 1e-300) / A) / np.log(B))
    return np.clip(level, 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    return kernel.mix64(packed ^ _BAND)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


_GRID = np.linspace(0.0, 1.0, 101)


def may_be_similar(above: np.ndarray, below: np.ndarray, n: np.ndarray, other: np.ndarray, least: float = PERCENT / 100, sigmas: float = SIGMAS) -> np.ndarray:
    """False where the joint likelihood rules out J >= least. above: registers in which the first set's is greater; below: smaller; n, other: set sizes."""
    u = n / (n + other)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def loglik(j: np.ndarray) -> np.ndarray:
        p, q = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        return above * np.log(np.maximum(p, 1e-12)) + below * np.log(np.maximum(q, 1e-12)) + (M - above - below) * np.log(np.maximum(1 - p - q, 1e-12))

    best = np.full(u.shape, -np.inf)
    where = np.zeros(u.shape)
    for g in _GRID:
        now = loglik(g * top)
        better = now > best
        best, where = np.where(better, now, best), np.where(better, g * top, where)
    at = loglik(np.minimum(least, top))
    return (top >= least - 1e-12) & ((where >= least) | (best - at <= sigmas * sigmas / 2))


def _sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, sig, regs): md5 of the text, set size, 128-bit set signature, registers."""
    names = ["doc_id", "digest", "n", "sig", "regs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0x5851F42D4C957F2D)
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text", TEXT_BYTES):
                h, first = kernel.document_shingles(buf, offs)
                at = first.tolist()
                sets = [np.unique(h[i:j]) for i, j in zip(at, at[1:], strict=False)]
                sigs = [np.array([s.sum(), kernel.mix64(s ^ salt).sum() + np.uint64(len(s))], dtype=np.uint64).tobytes() for s in sets]
                regs = registers(h, first)
                raw, ends = memoryview(np.ascontiguousarray(buf)), offs.tolist()
                digests = [hashlib.md5(raw[a:b]).digest() if there else None for a, b, there in zip(ends, ends[1:], rows.column(1).is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, n long, sig binary, regs binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, rep) of each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_stack(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "rep"])

    return classes.select("rep", "regs").mapInArrow(run, "key long, rep long")


def _stack(col: pa.Array) -> np.ndarray:
    return kernel.column_bytes(col)[0].view(np.uint16).reshape(-1, M)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the registers don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _stack(batch.column(4)), _stack(batch.column(5))
                keep = may_be_similar((x > y).sum(1), (x < y).sum(1), batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float), percent / 100)
                yield batch.select([0, 1]).filter(pa.array(keep))

    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("regs").alias("ar"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("regs").alias("br"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "an", "bn", "ar", "br").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents with the given distinct ids: sorted 64-bit hashes as bytes."""

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in kernel.blocks(batch, "text", TEXT_BYTES):
            h, first = kernel.document_shingles(buf, offs)
            cuts = first.tolist()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([np.unique(h[i:j]).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "shingles"])

    return texts_of(docs, ids, sets, "doc_id long, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs of document ids whose whole shingle sets are similar enough."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    whole = _sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    one, two = whole.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), whole.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct()


def _blocked(members: DataFrame, weight: Column, block: int, *fields: str, attach: DataFrame | None = None) -> DataFrame:
    """(outside, every) for each two blocks of a group ``centre``: packed outsiders and packed members, ``block`` of weight each; ``attach`` (rep, ...) joins once blocks are known."""
    size = members.groupBy("centre").agg(F.ceil(F.sum(weight) / block).alias("blocks"))
    placed = members.join(size, "centre").withColumn("part", F.pmod(F.xxhash64("rep"), F.greatest("blocks", F.lit(1))))
    if attach is not None:
        placed = placed.join(attach, "rep")
    packed = F.collect_list(F.struct(*fields))
    every = placed.groupBy("centre", "part").agg(packed.alias("every"))
    outside = placed.where("outer").groupBy("centre", F.col("part").alias("part_out")).agg(packed.alias("outside"))
    spread = partitions(members.sparkSession)
    return outside.join(every, "centre").repartition(spread, "centre", "part", "part_out").select("centre", "outside", "every")


def _across(star: DataFrame, classes: DataFrame, component: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Verified links between the components that the members of one centre still fall into.

    Members outside the centre's largest component are compared with all, first
    by registers, block against block, which tells who has a likely partner at
    all; the whole sets of those are then intersected, block against block. Of
    an outsider's links to one component in one block, one is returned.
    """
    members = star.select(F.col("a").alias("centre"), F.col("b").alias("rep")).join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = members.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("own"), F.count(F.lit(1)).alias("components")).where("components > 1").select("centre", "own")
    members = cut(members.join(mixed, "centre").join(classes.select("rep", "n", "regs"), "rep").withColumn("outer", F.col("component") != F.col("own")), light=True)
    if members.isEmpty():
        return star.limit(0).select("a", "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (rep, comp, n, regs), (rep2, comp2, n2, regs2) = ((s.field(0).to_numpy(), s.field(1).to_numpy(), s.field(2).to_numpy().astype(float), _stack(s.field(3))) for s in (_row(batch.column(1), i), _row(batch.column(2), i)))
                partner, has = np.zeros(len(rep2), dtype=bool), np.zeros(len(rep), dtype=bool)
                for j in range(len(rep)):
                    other = np.flatnonzero((comp2 != comp[j]) & (np.minimum(n2, n[j]) * 100 >= percent * np.maximum(n2, n[j])))
                    if len(other):
                        x, y = regs[j], regs2[other]
                        keep = other[may_be_similar((x > y).sum(1), (x < y).sum(1), np.full(len(other), n[j]), n2[other], percent / 100)]
                        partner[keep] = True
                        has[j] = len(keep) > 0
                found = np.concatenate([rep[has], rep2[partner]])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0)[i].as_py(), len(found)), pa.int64()), pa.array(found, pa.int64())], ["centre", "rep"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, all_ = _row(batch.column(1), i), _row(batch.column(2), i)
                rep2, comp2 = all_.field(0).to_numpy(), all_.field(1).to_numpy()
                raw, offs = kernel.column_bytes(all_.field(2))
                hashes, size = raw.view(np.uint64), np.diff(offs) // 8
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], np.repeat(np.arange(len(size)), size)[order]
                a, b = [], []
                for rep, comp, mine in zip(out.field(0).to_pylist(), out.field(1).to_pylist(), out.field(2), strict=True):
                    mine = np.frombuffer(mine.as_buffer(), np.uint64)
                    low = np.searchsorted(hashes, mine, "left")
                    same = np.bincount(owner[kernel.ragged(low, np.searchsorted(hashes, mine, "right") - low)], minlength=len(size))
                    hit = np.flatnonzero((100 * same >= percent * (size + len(mine) - same)) & (comp2 != comp))
                    for k in hit[np.unique(comp2[hit], return_index=True)[1]].tolist():
                        a.append(min(rep, int(rep2[k])))
                        b.append(max(rep, int(rep2[k])))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    needed = cut(_blocked(members, F.lit(1), BLOCK, "rep", "component", "n", "regs").mapInArrow(likely, "centre long, rep long").distinct(), light=True)
    sets = _sets(docs, needed.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])
    few = members.drop("regs").join(needed, ["centre", "rep"], "left_semi")
    return _blocked(few, 8 * F.col("n"), BLOCK_BYTES, "rep", "component", "shingles", attach=sets).mapInArrow(linked, "a long, b long").distinct()


def _row(col: pa.ListArray, i: int) -> pa.StructArray:
    """The values of row i of a list column."""
    return pa.concat_arrays([col.slice(i, 1).flatten()])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text). The bands are made for 75 percent and more."""
    return _judged(docs, percent).drop("digest")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    if percent < PERCENT:
        raise ValueError(f"links below {PERCENT} percent would be lost")
    sketches = cut(_sketch(docs))
    linked = sketches.where("n > 0 and doc_id is not null")
    classes = cut(linked.groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), light=True)
    buckets = _buckets(classes)
    centres = buckets.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "centre")
    star = cut(buckets.join(centres, "key").where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), light=True)
    edges = cut(_verified(cut(_likely(star, classes, percent), light=True), docs, percent), light=True)
    component = connected_components(edges).select(F.col("node").alias("rep"), "component")
    more = cut(_across(star, classes, component, docs, percent), light=True)
    if not more.isEmpty():
        component = connected_components(edges.union(more)).select(F.col("node").alias("rep"), "component")
    group = classes.join(component, "rep", "left").select("sig", "n", F.coalesce("component", "rep").alias("component"))
    found = sketches.drop("regs").join(group, ["sig", "n"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return found.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps; of rows that repeat an id and a text, one stays.

    Rows are told apart by id and md5 of the text, so one of two texts of an id
    can go. Texts are shuffled only where rows repeat both, or where too many
    go for a broadcast.
    """
    rows = _judged(docs, percent).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = cut(rows.where("not kept or n > 1").select(F.col("doc_id").alias("d"), "digest", "kept", "n"), light=True)
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    ident, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    digest = F.unhex(F.md5(text.cast("string").cast("binary")))
    left = renamed.join(marked, ident.cast("long").eqNullSafe(F.col("d")) & digest.eqNullSafe(F.col("digest")), "left").where("kept is null or kept")
    if not marked.where("kept and n > 1").isEmpty():
        one = Window.partitionBy(ident, digest).orderBy(ident)
        left = left.withColumn("nth", F.when(F.col("n") > 1, F.row_number().over(one)).otherwise(1)).where("nth = 1")
    return left.select(*names).toDF(*docs.columns)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates_sql() -> str:
    """``near_duplicates`` of ``documents`` in DuckDB SQL, for tables whose pairs with a common shingle are few enough to list."""
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
e as (select doc_id, unnest(s) as h from s), p as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)), u as (select a, b from l union select b, a from l),
r(node, root) as (select doc_id, doc_id from s union select u.b, r.root from r join u on u.a = r.node), c as (select node, min(root) as component_id from r group by 1)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on node = doc_id"""
