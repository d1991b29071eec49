"""License scans, Merkle manifests and centroid clusters against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import clusters, licenses, merkle
from tests.llm import plain

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# Merkle manifest


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """(top, steps of each leaf)."""
    level, owners, steps = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, up_owners = [], []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for j in range(len(run)):
                for i in owners[at + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            up_owners.append(sum(owners[at : at + 16], []))
        level, owners = up, up_owners
    return level[0], steps


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: b"" if s is None else b"1" + s.encode())
    made = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        made[s] = (own, *plain_tree([plain_leaf(r) for r in own]))
    root, over = plain_tree([made[s][1] for s in names])
    out = []
    for s, above in zip(names, over, strict=True):
        for r, steps in zip(made[s][0], made[s][2], strict=True):
            path = steps + above
            other = (*r[:4], r[4].translate(plain.UPPER)) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            node = plain_leaf(other)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], plain_leaf(r), made[s][1], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, at string, digest string"
ordered = lambda rows: sorted(map(tuple, rows), key=repr)


def test_manifest_equals_a_plain_one(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.choice(["hot", "hot", f"s{rng.randrange(30)}", None, "", "ünï"]), rng.choice(["en", None]), rng.randrange(99), rng.choice(["Some TEXT", "", None, "-", "no capitals ü", "L" * 70000])) for i in range(700)]
    rows += [(9, "hot", "en", 1, "Again"), (9, "hot", "en", 1, "Again"), (9, "hot", "en", 1, "Other"), (None, "hot", None, None, None), (None, None, None, None, "X"), (7, "lone", "en", 3, "One")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = merkle.verified(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(got.collect()) == ordered(plain_manifest(rows))


def test_small_manifests(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []
    one = (5, "a", None, 1, "Text")
    r = merkle.verified(spark.createDataFrame([(*one, 0, "", "")], SCHEMA)).first()
    assert r.leaf == r.subroot == r.root == plain_leaf(one) and r.proof_sha256 == sha("")
    full = [(i, "a", "en", 1, "t") for i in range(257)]  # the last run of a level has one node
    assert ordered(merkle.verified(spark.createDataFrame([(*f, 0, "", "") for f in full], SCHEMA)).collect()) == ordered(plain_manifest(full))


# Centroid clusters


def plain_clusters(vectors, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = {j: sum(d for _, d, o in last if o == j) for j in range(len(centroids))}
    return [(i, j, d, each[j], sum(each.values()), sha(",".join(map(str, centroids[j])))) for i, d, j in last]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_clusters_equal_plain_ones(spark, spread):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(9, 64))
    vectors = [(i, (middles[i % 9] + spread * rng.normal(size=64)).tolist()) for i in range(400)]
    vectors += [(1000 + i, [0.25] * 64) for i in range(300)] + [(1000, [0.25] * 64), (None, [0.5] * 64)]
    vectors += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] + [1.0] * 63), (2005, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, id int").repartition(3)
    assert ordered(clusters.clustered(df).collect()) == ordered(plain_clusters(vectors))


def test_few_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert clusters.clustered(spark.createDataFrame([], schema)).collect() == []
    few = [(1, [0.5] * 64), (2, [1.5] * 64), (3, [1.5] * 64)]
    assert ordered(clusters.clustered(spark.createDataFrame(few, schema)).collect()) == ordered(plain_clusters(few))
    huge = clusters.clustered(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], schema)).collect()
    assert [r.distance for r in huge] == [0, 0]


def test_trees_hold_what_they_cover():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-9, 9, (300, 4)), rng.integers(900, 905, (300, 4)), np.ones((200, 4), int)]).astype(np.int32)
    order, nodes, reach = clusters.cover_tree(points)
    assert sorted(order.tolist()) == list(range(800)) and len(nodes) > 10
    held = points[order].astype(float)
    for (first, last, centre, a, b), r in zip(nodes.tolist(), reach, strict=True):
        assert first <= centre < last and np.sqrt(((held[first:last] - held[centre]) ** 2).sum(axis=1)).max() <= r + 1e-9
        if b > a:
            assert nodes[a][0] == first and nodes[b - 1][1] == last and all(nodes[c][1] == nodes[c + 1][0] for c in range(a, b - 1))
    many = rng.integers(-50, 950, (60, 4))
    assert (clusters.assigned(points[order], nodes, reach, many) == clusters.squared(points[order], many).argmin(axis=1)).all()
    whole, single = clusters.nearest(points[order], nodes, reach, many)
    assert len(single) < 800  # some nodes are left whole


# License scans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def plain_base(text):
    w = WORD.findall((text or "").translate(plain.UPPER))
    at = [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({label for _, label in at}))


def license_rows():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "of", "a", "license", "version", "under", f"w{rng.randrange(500)}", "Ünder"]) for _ in range(n))
    wording = lambda i: licenses.WORDINGS[i][1]
    texts = [prose(rng.randrange(5, 200)) for _ in range(60)]
    texts += [prose(20) + ". " + wording(i).title().replace(" ", ", ") + "! " + prose(20) for i in range(len(licenses.WORDINGS))]
    texts += ["Released under the MIT\n\nLicense.", "under the mit license " * 50, "CC-BY-NC 4.0 and CC BY-NC", "under the mit licenses", "xcc by nc", "cc by", "by nc", "\x80cc by nc", "Apache License, Version 2.0", None, "", "  ", "license " * 30000, "Licensed under the GNU General Public License, version 3."]
    edited = wording(1).split()
    edited[9], edited[12] = "changed", "words"
    return [*texts, " ".join(edited), " ".join(wording(1).split()[8:])]


def test_licenses_equal_sql_and_plain_base(spark):
    texts = license_rows()
    data = [(i if i % 7 else None, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_words int, row string").repartition(3)
    got = licenses.report(df)
    want = {t: plain_base(t) for t in texts}
    seen = licenses.scan(df).select("row.n_words", F.col("n_words").alias("n"), F.size("base").alias("b")).collect()
    assert {r.n_words: (r.n, r.b) for r in seen} == {i: want[t][:2] for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    sql = [tuple(json.loads(json.dumps(v)) for v in r) for r in con.sql(licenses.report_sql()).fetchall()]
    assert ordered(got.collect()) == ordered(sql)
    assert ordered(tuple(r)[1:6] for r in got.collect()) == ordered(want[t] for t in texts)


def test_wordings_are_found_and_prose_is_not(spark):
    texts = license_rows()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    by = {r.doc_id: r for r in licenses.report(df).collect()}
    for i, (label, _, _) in enumerate(licenses.WORDINGS):
        assert label in by[60 + i].labels.split(",") and by[60 + i].score == 1.0
    assert all(by[i].labels == "" and by[i].score == 0.0 for i in range(60))
    assert by[len(texts) - 3].labels == "gpl-3" and 0.6 <= by[len(texts) - 2].score < 1.0 and by[len(texts) - 2].labels == "mit"
    assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in by.values())


def test_licenses_of_nothing(spark):
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = licenses.scan(spark.createDataFrame([("cc by nc",), (None,)], "text string")).collect()
    assert sorted(len(r.base) for r in alone) == [0, 1]
