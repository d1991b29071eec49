"""Centroid clustering: Lloyd's rounds over integer vectors, with two trees to skip comparisons.

Vectors lie in blocks of at most ``BLOCK`` rows, each with a cover tree that is
built once: a node is a range of the block's rows, a centre and a radius; its
children are centres that lie farther apart than its reach divided by ``BASE``, and
what they cover. The centroids of a round get a tree of their own, halved by their longest
axis. A block is walked down both trees together: a pair of nodes is dropped when
its least possible distance exceeds the greatest possible one of another pair of
the same vectors. Where one centroid is left, a whole node counts as its own by
the node's sum; pairs of leaves are compared exactly, in integers. Bounds are
floating point with a margin for their rounding, so they decide what is compared
but never what is nearest.

A round is one job: a row of sums a centroid and task, added up exactly by Spark.
The driver holds the centroids, ``k`` rows, and nothing that grows with the
vectors. Blocks are written to the shared folder, so a lost executor costs no
trees. Neither many equal vectors nor a hot label matter: rows aren't shuffled.

Defined cases: only vectors of ``dims`` components without null, NaN or infinity
are kept; components beyond ``MOST`` in size count as that, so that distances fit
into 64 bits; rows with equal ids are vectors of their own; a null id is kept, its
starting rank is that of the empty string; equal starting ranks go by the vector;
equal distances go to the centroid of smaller number; with fewer vectors than
``k`` there are as many centroids as vectors; an empty cluster keeps its centroid;
sums that don't fit into 64 bits are null; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.session import cut

DIMS, K, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
BLOCK, LEAF, PAIRS = 2048, 16, 1 << 14
BASE = 1.3  # by which a node's reach shrinks from level to level
MOST = 1 << 27
_BLOCKS = "ids array<long>, vectors binary, nodes binary, reach binary"


# trees


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, reach) of a block: rows in the order of the tree; (first, last, centre, children from, children to) of each node over that order, children after their parents and together; each node's radius."""
    wide = points.astype(np.float64)
    order = np.arange(len(points))
    nodes, reach, todo = [[0, len(points), 0, 0, 0]], [0.0], [0]
    far = _lengths(wide, order, 0)
    reach[0] = float(far.max(initial=0.0))
    while todo:
        at = todo.pop()
        first, last, centre = nodes[at][:3]
        if last - first <= LEAF or reach[at] == 0.0:
            continue
        rest, rows, made = reach[at] / BASE, order[first:last].copy(), []
        pick = int(np.flatnonzero(rows == centre)[0])
        left = np.ones(len(rows), dtype=bool)
        while left.any():
            if not left[pick]:
                pick = int(np.argmax(left))
            away = _lengths(wide, rows, int(rows[pick]))
            own = left & (away <= rest)
            made.append((int(rows[pick]), rows[own], float(away[own].max())))
            left &= ~own
        if len(made) == len(rows):  # no two rows are that near: one leaf
            continue
        nodes[at][3:] = [len(nodes), len(nodes) + len(made)]
        for child, own, radius in made:
            order[first : first + len(own)] = own
            todo.append(len(nodes))
            nodes.append([first, first + len(own), child, 0, 0])
            reach.append(radius)
            first += len(own)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array(nodes, dtype=np.int32).reshape(-1, 5)
    table[:, 2] = place[table[:, 2]]
    return order, table, np.array(reach)


def _lengths(wide: np.ndarray, rows: np.ndarray, to: int) -> np.ndarray:
    """Distances of rows to one row."""
    diff = wide[rows] - wide[to]
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def centroid_tree(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, centres, reach): (centroid or -1, left child, right child) of each node, its middle and the distance from there to its farthest centroid."""
    wide = centroids.astype(np.float64)
    nodes, centres, reach, members = [], [], [], [np.arange(len(centroids))]
    for own in members:  # grows as nodes are halved
        middle = wide[own].mean(axis=0)
        centres.append(middle)
        reach.append(float(np.sqrt(((wide[own] - middle) ** 2).sum(axis=1)).max()))
        if len(own) == 1:
            nodes.append((int(own[0]), 0, 0))
            continue
        axis = int(np.ptp(wide[own], axis=0).argmax())
        sorted_ = own[np.argsort(wide[own, axis], kind="stable")]
        nodes.append((-1, len(members), len(members) + 1))
        members += [sorted_[: len(own) // 2], sorted_[len(own) // 2 :]]
    return np.array(nodes), np.array(centres), np.array(reach)


# a round


def nearest(points: np.ndarray, nodes: np.ndarray, reach: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes left whole with their centroid, rows of leaves with their nearest centroid), each as two columns."""
    tree, middles, spread = centroid_tree(centroids)
    wide = points.astype(np.float64)
    whole, single = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    mine, theirs = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, by node of the block
    while len(mine):
        least, most = np.empty(len(mine)), np.empty(len(mine))
        for i in range(0, len(mine), PAIRS):
            diff = wide[nodes[mine[i : i + PAIRS], 2]] - middles[theirs[i : i + PAIRS]]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            around = reach[mine[i : i + PAIRS]] + spread[theirs[i : i + PAIRS]]
            least[i : i + PAIRS], most[i : i + PAIRS] = d - around, d + around
        begin, many = _runs(mine)
        bound = np.repeat(np.minimum.reduceat(most, begin), many)
        kept = least <= bound + 1e-6 * (1.0 + np.abs(bound))
        mine, theirs = mine[kept], theirs[kept]
        alone = (np.repeat(_runs(mine)[1], _runs(mine)[1]) == 1) & (tree[theirs, 0] >= 0)
        whole.append(np.column_stack([mine[alone], tree[theirs[alone], 0]]))
        mine, theirs = mine[~alone], theirs[~alone]
        if not len(mine):
            break
        halved = tree[theirs, 0] < 0
        begin, many = _runs(mine)
        ready = (nodes[mine, 4] == nodes[mine, 3]) & ~np.repeat(np.logical_or.reduceat(halved, begin), many)
        single.append(_compared(points, nodes, mine[ready], tree[theirs[ready], 0], centroids))
        mine, theirs, halved = mine[~ready], theirs[~ready], halved[~ready]
        mine, theirs = _split(mine, np.where(halved, tree[theirs, 1], theirs), np.where(halved, tree[theirs, 2], -1), nodes)
    return np.concatenate(whole), np.concatenate(single)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the runs of equal values."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return begin, np.diff(np.append(begin, len(values)))


def _split(mine: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the children, by node of the block; a leaf stands for itself on either side."""
    two = right >= 0
    mine, theirs = np.concatenate([mine, mine[two]]), np.concatenate([left, right[two]])
    first = np.where(nodes[mine, 4] > nodes[mine, 3], nodes[mine, 3], mine)
    n = np.maximum(nodes[mine, 4] - nodes[mine, 3], 1)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    mine, theirs = np.repeat(first, n) + step, np.repeat(theirs, n)
    order = np.argsort(mine, kind="stable")
    return mine[order], theirs[order]


def _compared(points: np.ndarray, nodes: np.ndarray, mine: np.ndarray, theirs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(row, centroid): the nearest of the centroids that a leaf is paired with, for each of its rows, exactly."""
    out = [np.zeros((0, 2), np.int64)]
    for i, n in zip(*(r.tolist() for r in _runs(mine)), strict=True):
        rivals, (first, last), most = np.sort(theirs[i : i + n]), nodes[mine[i], :2].tolist(), max(1, PAIRS // n)
        for at in range(first, last, most):
            rows = np.arange(at, min(at + most, last))
            out.append(np.column_stack([rows, rivals[squared(points[rows], centroids[rivals]).argmin(axis=1)]]))
    return np.concatenate(out)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centroids."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        diff = points.astype(np.int64) - c
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def assigned(points: np.ndarray, nodes: np.ndarray, reach: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cluster of each row of a block."""
    whole, single = nearest(points, nodes, reach, centroids)
    out = np.empty(len(points), np.int64)
    sizes = nodes[whole[:, 0], 1] - nodes[whole[:, 0], 0]
    rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(nodes[whole[:, 0], 0], sizes)
    out[rows] = np.repeat(whole[:, 1], sizes)
    out[single[:, 0]] = single[:, 1]
    return out


def sums(points: np.ndarray, nodes: np.ndarray, reach: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, component sums) of each cluster in a block; nodes left whole count by their own sums."""
    whole, single = nearest(points, nodes, reach, centroids)
    before = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points, axis=0, dtype=np.int64, out=before[1:])
    first, last = nodes[whole[:, 0], 0], nodes[whole[:, 0], 1]
    count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), points.shape[1]), np.int64)
    np.add.at(count, whole[:, 1], last - first)
    np.add.at(total, whole[:, 1], before[last] - before[first])
    np.add.at(count, single[:, 1], 1)
    np.add.at(total, single[:, 1], points[single[:, 0]].astype(np.int64))
    return count, total


# Spark


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that are kept, as integers."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))


def starts(rows: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The k vectors of least digest of salt and id, in its order."""
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()], dtype=np.int64)


def blocks(rows: DataFrame, dims: int = DIMS, most: int = BLOCK) -> DataFrame:
    """A row a block: ids and vectors in the order of their cover tree, and the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy().reshape(-1, dims)
            for i in range(0, b.num_rows, most):
                points = flat[i : i + most]
                order, nodes, reach = cover_tree(points)
                ids = b.column(0).slice(i, most).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in (points[order].astype(np.int32), nodes, reach))], ["ids", "vectors", "nodes", "reach"])

    return cut(rows.mapInArrow(run, _BLOCKS))


def _read(b: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b.column(c)[i].as_py() for c in (1, 2, 3)]
    return np.frombuffer(raw[0], np.int32).reshape(-1, dims), np.frombuffer(raw[1], np.int32).reshape(-1, 5), np.frombuffer(raw[2], np.float64)


def _round(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; exact sums come to the driver, a row a centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                n, s = sums(*_read(b, i, dims), centroids)
                count, total = count + n, total + s
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = held.mapInArrow(run, "cluster long, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "t")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    moved = centroids.copy()
    for r in each.collect():  # k * dims rows
        moved[r.cluster, r["at"]] = int(r.t) // r.n
    return moved


def lloyd(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector of ``rows`` (id, v), the last centroids)."""
    centroids = starts(rows, k)
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    held = blocks(rows, dims)
    for _ in range(rounds):
        centroids = _round(held, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                points, nodes, reach = _read(b, i, dims)
                own = assigned(points, nodes, reach, centroids)
                diff = points.astype(np.int64) - centroids[own]
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(own.astype(np.int32)), pa.array(np.einsum("ij,ij->i", diff, diff))], ["id", "cluster", "distance"])

    return cut(held.mapInArrow(run, "id long, cluster int, distance long")), centroids


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors`` (vec_id, embedding)."""
    rows, centroids = lloyd(scaled(vectors), k, rounds)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(exact.alias("s")).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    told = [(j, fits(each.get(j, 0)), fits(sum(each.values())), ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())]
    table = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, line string")
    return rows.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("line", 256).alias("centroid_sha256"))  # k rows


def clustered_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``clustered``: every vector against every centroid."""
    fine = f"len(embedding) = {DIMS} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0"
    sql = [f"with v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as x from embeddings where {fine})"]
    sql.append(f"c0 as materialized (select row_number() over (order by h, x) - 1 as c, x as m from (select sha256('{SALT}:' || coalesce(vec_id::varchar, '')) as h, x from v order by h, x limit {K}))")
    apart = "list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    near = lambda i: f"(select row, any_value(vec_id) as vec_id, any_value(x) as x, min(struct_pack(d := d, c := c)) as b from (select v.*, c, {apart} as d from v, c{i}) group by row)"
    for i in range(rounds):
        mean = f"(select c, list(((s - ((s % n) + n) % n) // n)::bigint order by place) as m from (select b.c as c, place, sum(x[place]) as s, count(*) as n from {near(i)}, range(1, {DIMS + 1}) r(place) group by all) group by c)"
        sql.append(f"c{i + 1} as materialized (select c, coalesce(n.m, o.m) as m from c{i} o left join {mean} n using (c))")
    sql.append(f"e as materialized (select vec_id, b.c as c, b.d as d from {near(rounds)})")
    return ",\n".join(sql) + f"\nselect vec_id, c::integer as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from e join c{rounds} using (c)"
