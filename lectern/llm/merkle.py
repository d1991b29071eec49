"""Merkle manifest of a dataset: a tree a group of rows, a tree over the groups, and a proof a row.

A row's leaf is the digest of its fields, each with its length. Within a group
the leaves ascend by id; level by level, ``FANOUT`` neighbours become the digest
of their digests, until one is left, the group's subroot. The subroots, by group,
make a tree in the same way, whose last node is the root.

Levels are tables. Leaves get their index from bounds drawn once
(``positions_within``: a group that holds a third of all rows is spread over
partitions as any other). ``index div FANOUT`` groups at most ``FANOUT`` children
into a row, whose sorted digests are hashed into the parent, so a level is one
shuffle of a sixteenth of the rows below it. The way back joins each level with
what lies above it and appends its siblings; what siblings share is carried once
a row of children, not once a leaf, and opened at the end. Both sides of these
joins have a row a key. Every level is written to the shared folder, so a lost
executor costs no earlier one.

A leaf can be checked alone: ``folded`` recomputes the root from a leaf and the
siblings to its left and right, level by level.

Defined cases: a null field is ``-``; null text, an empty one and a text ``-``
have different leaves; a null group is a group, the first one; ids ascend with
null first, rows of one id by their leaves, rows equal in all take neighbouring
places; a lone row is its group's subroot, a lone group's subroot is the root;
an empty table gives no rows; other columns are ignored, whatever their names;
a very long text is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.session import cut
from lectern.operators.ordering import positions, positions_within

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hashed(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (tree, parent, run) from ``nodes`` (tree, at, digest and whatever else a child carries): the children of each parent in order.

    A run of one child that is a tree's first is the tree's top; it isn't hashed again.
    """
    child = F.struct("at", "digest", *[c for c in nodes.columns if c not in ("tree", "at", "digest")])
    out: list[DataFrame] = []
    while True:
        runs = cut(nodes.groupBy("tree", F.expr(f"at div {fanout}").alias("parent")).agg(F.array_sort(F.collect_list(child)).alias("run")))
        out.append(runs)
        more = runs.where(~_is_top())
        if more.isEmpty():
            return out
        nodes = more.select("tree", F.col("parent").alias("at"), _hashed(F.transform("run", lambda c: c["digest"])).alias("digest"))
        child = F.struct("at", "digest")


def _is_top() -> Column:
    return (F.col("parent") == 0) & (F.size("run") == 1)


def tops(found: list[DataFrame]) -> DataFrame:
    """(tree, top): the last node of each tree."""
    parts = [runs.where(_is_top()).select("tree", F.col("run")[0]["digest"].alias("top")) for runs in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _opened(runs: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """(tree, child, top, path): each child with its siblings in front of what lies above its parent."""
    digests = F.transform("run", lambda c: c["digest"])
    each = F.transform("run", lambda c, i: F.struct(c.alias("child"), F.struct(F.array_join(F.slice(digests, 1, i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.size("run")), "").alias("right")).alias("step")))
    rows = runs.join(above, keys).select("tree", "top", "path", F.explode(each).alias("e"))
    return rows.select("tree", F.col("e.child").alias("child"), "top", F.concat(F.array("e.step"), "path").alias("path"))


def paths(found: list[DataFrame], roofs: DataFrame) -> DataFrame:
    """(tree, child, top, path) of every leaf: its tree's top, and the steps (left, right siblings) from the leaf up, with those of ``roofs`` (tree, top, path) behind them."""
    above = None
    for k in range(len(found) - 1, -1, -1):
        done = found[k].where(_is_top()).select("tree", F.col("run")[0].alias("child")).join(roofs, "tree")
        if above is None:
            above = done.select("tree", "child", "top", "path")
        else:
            up = above.select("tree", F.col("child.at").alias("parent"), "top", "path")
            above = _opened(found[k].where(~_is_top()), up, ["tree", "parent"]).unionByName(done.select("tree", "child", "top", "path"))
        if k:
            above = cut(above)
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, group: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, changed_leaf, subroot, root, path) of every row; ``changed`` gives other values of fields, for the leaf of an altered row."""
    at = lambda c: F.col(f"`{c}`")
    other = leaf(*[(changed or {}).get(f, at(f)) for f in fields])
    rows = cut(docs.select(F.coalesce(F.concat(F.lit("1"), at(group).cast("string")), F.lit("0")).alias("tree"), at(id_col).alias("id"), leaf(*[at(f) for f in fields]).alias("digest"), other.alias("other")))
    found = levels(positions_within(rows, "tree", ["id", "digest"], "at"), fanout)
    groups = cut(tops(found))
    over = levels(positions(groups, ["tree"], "at").select(F.lit(0).alias("tree"), "at", F.col("top").alias("digest"), F.col("tree").alias("group")), fanout)
    root = tops(over).select("top").first()  # the one row of the tree over groups
    none = F.array().cast(STEP)
    roofs = paths(over, docs.sparkSession.range(1).select(F.lit(0).alias("tree"), F.lit("").alias("top"), none.alias("path")))
    roofs = cut(roofs.select(F.col("child.group").alias("tree"), F.col("child.digest").alias("top"), "path"))
    rooted = paths(found, roofs)
    return rooted.select(F.col("child.id").alias(id_col), F.col("child.digest").alias("leaf"), F.col("child.other").alias("changed_leaf"), F.col("top").alias("subroot"), F.lit(root.top if root else None).cast("string").alias("root"), "path")


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of ``docs``, held against rows of which those whose id's CRC-32 is divisible by 5 have lower-cased texts."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = manifest(docs, changed={"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def verified_sql(levels: int = 8) -> str:
    """DuckDB SQL of ``verified``, for groups and numbers of groups up to FANOUT ** levels."""
    f = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join([*(f(c) for c in FIELDS[:-1]), f(text)]) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 1, 2, 3, 4, 5, 6, 7]::bigint[], lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))"
    sql = [f"with d as (select doc_id, source, {leaf_of('text')} as leaf, case when xor({crc}, 4294967295) % 5 = 0 then {leaf_of(low)} else {leaf_of('text')} end as other from documents)"]
    sql.append("a0 as (select row_number() over () as row, doc_id, leaf, other, coalesce('1' || source, '0') as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as nth, leaf as node, '' as proof, other as fold from d)")

    def up(name: str, k: int, by: str) -> None:
        sql.append(f"{name}n{k} as (select distinct {by}, nth // {FANOUT ** k} as n, node from {name}{k})")
        sql.append(f"{name}r{k} as (select {by}, n // {FANOUT} as parent, list(node order by n) as run, count(*) as size, max(n // {FANOUT}) over (partition by {by}) as last from {name}n{k} group by {by}, n // {FANOUT})")
        at = f"(nth // {FANOUT ** k}) % {FANOUT}"
        left, right = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:], '')"
        top = "size = 1 and last = 0"
        sql.append(f"{name}{k + 1} as (select * exclude (node, proof, fold, parent, run, size, last, {by}_), case when {top} then node else sha256(array_to_string(run, '')) end as node, case when {top} then proof else proof || {left} || {right} end as proof, case when {top} then fold else sha256({left} || fold || {right}) end as fold from {name}{k} join (select {by} as {by}_, parent, run, size, last from {name}r{k}) on {by}_ = {by} and parent = nth // {FANOUT ** (k + 1)})")

    for k in range(levels):
        up("a", k, "tree")
    sql.append(f"b0 as (select * exclude (nth, node), node as subroot, dense_rank() over (order by encode(tree)) - 1 as nth, node, 0 as roof from a{levels})")
    for k in range(levels):
        up("b", k, "roof")
    sql.append(f"c as (select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = node as verified from b{levels})")
    return ",\n".join(sql) + "\nselect * from c"
