from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, decontaminate, fingerprint, kernel, near, packing, ppm, quality, repeats, reputation, secrets, shards
from lectern.llm.tokens import tokenizer
from tests.llm import plain
from tests.llm.conftest import prose


def ids_of(text):
    return tokenizer().model.encode(text or "", add_special_tokens=False).ids + [1]


# 1 token shards


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000])
def test_permutation(n):
    p = shards.permute(np.arange(n), n, key=7)
    assert sorted(p) == list(range(n))
    assert (shards.permute(p, n, key=7, inverse=True) == np.arange(n)).all()
    assert n < 50 or (p != shards.permute(np.arange(n), n, key=8)).any()


def test_shards_round_trip(docs, rows, tmp_path):
    out = f"file://{tmp_path}/shards"
    placed = shards.write_shards(docs, out, length=64, per_shard=16).orderBy("start").collect()
    n = max(r.slot for r in placed) + 1
    line = list(shards.read_slots(out, 0, n, 64, 16))
    assert len(line) == n and sorted({r.slot for r in placed}) == list(range(n))
    assert [x.tolist() for x in shards.read_slots(out, 5, 20, 64, 16)] == [x.tolist() for x in line[5:25]]
    texts = dict(rows)
    for d in texts:
        mine = [r for r in placed if r.doc_id == d]
        assert sum((line[r.slot][r.offset : r.offset + r.length].tolist() for r in mine), []) == ids_of(texts[d])
        assert all(zlib.crc32(line[r.slot][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32 for r in mine)


def test_shards_of_nothing_and_odd_rows(nothing, odd, tmp_path):
    assert shards.write_shards(nothing, f"file://{tmp_path}/none").count() == 0
    assert shards.write_shards(odd, f"file://{tmp_path}/odd").count() == 6


# 2 decontamination


def test_leaks(spark, rows):
    import random

    rng = random.Random(3)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(6, None), (7, ""), (None, "x y z"), (8, "two words")]
    clean = [(100 + i, prose(rng, 150)) for i in range(40)]
    planted = []
    for i in range(6):
        w = items[i][1].split()
        edited = " ".join(x if j % 7 else "edited" for j, x in enumerate(w))
        planted += [(i, prose(rng, 30) + " " + items[i][1].upper() + " " + prose(rng, 30)), (10 + i, prose(rng, 30) + " " + edited + " " + prose(rng, 9))]
    hot = [(1000 + i, prose(rng, 5) + " " + items[0][1]) for i in range(60)]
    docs = spark.createDataFrame(clean + planted + hot + [(500, None), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(i, i) for i in range(6)} | {(10 + i, i) for i in range(6)} | {(1000 + i, 0) for i in range(60)}
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {d for d, _ in clean} | {500, 501}


def test_parts_of_an_item_beside_many_whole_copies(spark):
    import random

    rng = random.Random(8)
    words = prose(rng, 26).split()
    whole = [(i, prose(rng, 5) + " " + " ".join(words)) for i in range(60)]
    dense = [x if j % 2 or j > 12 else "edited" for j, x in enumerate(words)]
    parts = [words[:13], words[13:], words[7:20], dense]
    docs = spark.createDataFrame(whole + [(100 + i, " ".join([prose(rng, 20), *w, prose(rng, 20)])) for i, w in enumerate(parts)], "doc_id long, text string")
    found = {r.doc_id for r in decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert found == set(range(60)) | {100, 101, 102, 103}


def test_rows_leak_by_their_own_texts(spark):
    import random

    rng = random.Random(12)
    item = prose(rng, 25)
    clean = [prose(rng, 60) for _ in range(4)]
    leak = clean[0] + " " + item + " " + clean[1]
    rows = [(1, leak), (1, clean[2]), (None, leak), (None, clean[3]), (2, None), (3, "")]
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, c0 string, item_id string")
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, clean[2]), (0, clean[3]), (2, ""), (3, "")])


def test_leaks_against_alignment_of_all_pairs(spark):
    """Every document with every item by a plain Smith-Waterman; copies edited at known rates."""
    import random

    rng = random.Random(23)
    items = [prose(rng, rng.randrange(20, 45), 900) for _ in range(10)]
    docs, rate = [prose(rng, 80, 900) for _ in range(60)], {}
    for share in (0.0, 0.1, 0.2, 0.3):
        for i, item in enumerate(items):
            w = [f"new{rng.randrange(999)}" if rng.random() < share else x for x in item.split()]
            rate[len(docs)] = (share, i)
            docs.append(" ".join([prose(rng, 30, 900), *w, prose(rng, 30, 900)]))

    def best(x, y):
        last, top = [0] * (len(y) + 1), 0
        for a in x:
            now = [0]
            for j, b in enumerate(y):
                now.append(max(0, last[j] + (2 if a == b else -1), last[j + 1] - 1, now[j] - 1))
            last, top = now, max(top, *now)
        return top

    bare = lambda t: [w.strip(".,") for w in t.split()]
    want = {(d, i): best(bare(item), bare(t)) for d, t in enumerate(docs) for i, item in enumerate(items)}
    want = {(d, i): s for (d, i), s in want.items() if s >= decontaminate.LEAST * 2 * len(bare(items[i]))}
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert set(found) <= set(want) and all(found[k] == want[k] for k in found)
    for share, least in ((0.0, 1.0), (0.1, 1.0), (0.2, 0.9), (0.3, 0.8)):
        true = [k for k in want if rate.get(k[0]) == (share, k[1])]
        assert sum(k in found for k in true) >= least * len(true), share
    assert len([k for k in found if k[0] < 60]) == 0


def test_leaks_of_blocks_and_nothing(spark, docs, nothing, monkeypatch):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8"), (2, "a b c d e f g h")], "item_id long, text string")
    some = spark.createDataFrame([(1, "x w1 w2 w3 w4 w5 w6 w7 w8 y"), (2, "a b c d e f g h")], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 8)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(some, bench).collect()} == {(1, 1), (2, 2)}
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(some, bench.limit(0)).count() == 0


def test_smith_waterman():
    a = np.array([1, 2, 3, 4, 5], dtype=np.uint64)
    score, end = decontaminate.smith_waterman([a, a, a], [np.array([9, 1, 2, 3, 4, 5, 9], np.uint64), np.array([1, 2, 7, 3, 4, 5], np.uint64), np.array([8, 8], np.uint64)])
    assert score.tolist() == [10, 9, 0] and end[0] == 6


# 3 near-duplicates


def test_near_duplicates(docs, rows):
    want = plain.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()}
    assert got == want


def test_near_kept_and_odd_rows(odd, nothing):
    found = near.near_duplicates(odd).collect()
    assert len(found) == 6
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id is not None} == {(1, 1), (2, 1), (2, 2)}
    assert near.near_duplicates(nothing).count() == 0


def test_blocks_find_what_the_centre_does_not(spark):
    """A centre that links with nobody must not hide the links among the rest."""
    import random

    rng = random.Random(11)
    base = [f"t{i}" for i in range(100)]

    def edited(n, tag):
        w = list(base)
        for j in rng.sample(range(0, 100, 6), n):
            w[j] = f"{tag}{j}"
        return " ".join(w)

    rows = [(i, edited(n, f"x{i}")) for i, n in enumerate([6, 3, 1, 0, 2, 5, 4, 1, 6, 6])]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in plain.near(rows).items()}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 600).astype(np.uint64), rng.integers(0, 1 << 63, 600).astype(np.uint64)
    ra, rb = near.registers(a, np.array([0, 600]))[0], near.registers(b, np.array([0, 600]))[0]
    both = near.registers(np.concatenate([a, b]), np.array([0, 1200]))[0]
    assert (np.maximum(ra, rb) == both).all()
    close = np.concatenate([a[:540], b[:60]])
    rc = near.registers(close, np.array([0, 600]))[0]
    n = np.array([600.0])
    test = lambda x, y: bool(near.may_be_similar(np.array([(x > y).sum()]), np.array([(x < y).sum()]), n, n)[0])
    assert test(ra, rc) and not test(ra, rb)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == 0 and {got[100], got[101], got[103]} == {100}


# 4 suffix-array deduplication


@pytest.mark.parametrize("length", [400, 120])
def test_repeats(docs, rows, length):
    want = {d: w for (d, _), w in zip(rows, plain.repeats(rows, length), strict=True)}
    found = repeats.remove_repeats(docs, length, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found if r.n_removed)


def test_repeats_across_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 2000)
    want = {d: w[:3] for (d, _), w in zip(rows, plain.repeats(rows, 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs, 200).collect()} == want


def test_repeats_of_odd_rows(spark, odd, nothing):
    assert repeats.remove_repeats(nothing).count() == 0
    assert repeats.remove_repeats(odd).count() == 6
    long = prose(__import__("random").Random(1), 100)
    twins = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string")
    assert {r.n_removed for r in repeats.remove_repeats(twins).collect()} == {len(long)}


# 5 url reputation


def test_hosts_and_paths(spark):
    urls = ["http://WWW.Example.NET/en/x?q#f", "https://a.b.org?x=/fr/", "x://h", "no scheme", None, "http:///path", "ftp://ü.NET/É#", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {r.page_id: (r.host, r.path) for r in pages.select("page_id", *[c.alias(n) for c, n in zip(reputation.host_and_path(F.col("url")), ("host", "path"), strict=True)]).collect()}
    assert found == {i: plain.host_path(u) for i, u in enumerate(urls)}


def test_rules_and_posterior(spark):
    bad = [(i, f"http://spam.bad.net2/{i}") for i in range(60)]
    good = [(100 + i, f"http://a{i % 4}.good.org/{i}") for i in range(60)]
    other = [(200, "http://x.example.net/en/1"), (201, "http://x.example.net/de/1"), (202, "http://org/fr/9"), (203, "http://notorg/fr/"), (204, None), (205, "http://new.bad.net2/")]
    pages = spark.createDataFrame(bad + good + other, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i, _ in good] + [(0, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.rule, r.verdict) for r in reputation.judge_urls(pages, labels).collect()}
    assert all(got[i] == (None, "block") for i, _ in bad) and all(got[i] == (None, "allow") for i, _ in good)
    assert got[200] == ("example.net/en/", "allow") and got[201] == ("net/", "block") and got[202] == ("org/fr/", "allow") and got[203][0] is None and got[204] == (None, "allow")
    assert {r.verdict for r in reputation.judge_urls(pages, labels.limit(0), rules={}).collect()} == {"allow"}
    assert reputation.judge_urls(pages.limit(0), labels).count() == 0


def test_suffixes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.y.net",), ("net",), ("",)], "host string")
    s, d = reputation.suffix_and_domain(F.col("host"))
    assert [(r.s, r.d) for r in hosts.select(s.alias("s"), d.alias("d")).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("net", "y.net"), ("net", "net"), ("", "")]


# 6 fingerprints


def test_edited_fingerprints(docs, rows):
    found = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    line = sorted((d, t or "") for d, t in rows)
    for (d, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = plain.shingles(t), plain.shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - exact) <= (0.0 if len(a | b) <= fingerprint.K else 0.2)
    same = {}
    for d, t in line:
        same.setdefault(t, set()).add(found[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_merge_and_estimate():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    a, b = fingerprint.sketch(h[:3000]), fingerprint.sketch(h[2000:])
    assert (fingerprint.merge(a, b) == fingerprint.sketch(h)).all()
    assert (fingerprint.decode(fingerprint.encode(a)) == a).all()
    assert abs(fingerprint.resemblance(a, b) - 0.2) < 0.12
    assert abs(fingerprint.distinct_count(a) / 3000 - 1) < 0.25 and abs(fingerprint.containment(a, b) - 1 / 3) < 0.2


def edited(line):
    """[(doc_id, edited text)] of (doc_id, text) rows in order."""
    return [(d, t[: len(t) - len(t) // 2] + after[: len(t) // 2]) for (d, t), (_, after) in zip(line, line[1:] + line[:1], strict=True)]


@pytest.mark.parametrize("size", [300, 5000])
def test_edited_fingerprints_over_many_buckets(docs, rows, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", size)
    line = sorted((d, t or "") for d, t in rows)
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.edited_fingerprints(docs).collect()}
    assert got == {d: hashlib.sha256(e.encode()).hexdigest() for d, e in edited(line)}


def test_fingerprints_of_odd_rows(odd, nothing):
    line = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edited_fingerprints(odd).collect()]
    assert sorted(got, key=str) == sorted([(d, len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, t), (_, e) in zip(line, edited(line), strict=True)], key=str)
    assert fingerprint.edited_fingerprints(nothing).count() == 0
    assert [r.fingerprint for r in fingerprint.fingerprints(odd).where("n_shingles = 0").collect()] == [""]


# 7 prediction by partial matching


def test_base_scores(docs, rows):
    want = {d: w for (d, _), w in zip(rows, plain.base_scores(rows), strict=True)}
    for r in ppm.score(docs, head=50).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == plain.held(r.doc_id)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)


def test_trie_is_a_distribution(spark):
    trie = ppm.train_trie(spark.createDataFrame([("the cat sat on the mat " * 3,), ("a dog and a cat",)], "text string"), order=3, most=10_000)
    for context in (b"the", b" ca", b"xyz", b"\n\n\n", b"at "):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert 0.7 < (10 ** trie.code_lengths(np.sort(grams))).sum() <= 1.0 + 1e-6


def test_model_beats_the_base_line_on_held_out_text(spark):
    import random

    rng = random.Random(9)
    phrases = [" ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(6)) for _ in range(40)]
    text = lambda: " ".join(rng.choice(phrases) for _ in range(15))
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    held = ppm.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_pruned_trie_and_odd_rows(spark, docs, odd, nothing):
    small = ppm.train_trie(docs.select("text"), most=500)
    assert sum(len(x[0]) for x in small.levels if x) <= 500
    assert np.isfinite(small.code_lengths(np.arange(1000, dtype=np.uint64))).all()
    assert ppm.score(odd).count() == 6 and ppm.score(nothing).count() == 0


def test_scores_are_of_the_whole_trie_whatever_is_cached(spark, docs):
    whole = ppm.train_trie(docs.where(~ppm.held_out(F.col("doc_id"))).select("text"), most=1 << 40)
    found = [{r.doc_id: r.score for r in ppm.score(docs, cache=n).collect()} for n in (0, 300, 1 << 40)]
    for r in docs.collect():
        buf, offs = kernel.encode_spans_as_text([r.text or ""])
        grams, _ = ppm.line_of(buf, *kernel.words(buf, offs))
        want = whole.code_lengths(grams).sum()
        assert all(f[r.doc_id] == pytest.approx(want, rel=1e-5) for f in found), r.doc_id


# 8 secrets


def test_secrets(docs, rows):
    for r in secrets.report(docs).collect():
        spans = plain.base_spans(dict(rows)[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(plain.listed(spans).encode()).hexdigest()
        base = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert ",".join(base) == plain.listed(spans)


def test_many_secrets_and_markov(spark):
    rows = [(1, " ".join(f"token={i:08d} ü" for i in range(300))), (2, "key Zx8Kq2Lm9Vt4Rw7Yp3Nc6Hb1Jd5Gf0S end"), (3, "get_user_name_from_database_server"), (4, None)]
    found = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].spans == plain.listed(plain.base_spans(rows[0][1])) and found[1].n_assign == 300
    assert found[2].spans == "markov:4:35" and found[3].spans == "" and found[4].spans == ""


def test_redaction(spark):
    rows = [(1, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b'), (2, "plain"), (3, None), (4, "x deadbeefdeadbeefdeadbeefdeadbeef y deadbeefdeadbeefdeadbeefdeadbeef")]
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(spark.createDataFrame([(d, t, 99) for d, t in rows], "doc_id long, text string, n_chars long")).collect()}
    assert out[1] == (f'a {secrets.MARK}" b', 13) and out[2] == ("plain", 99) and out[3] == (None, 99) and out[4][0] == f"x {secrets.MARK} y {secrets.MARK}"


def test_secrets_of_odd_rows(odd, nothing):
    assert [(r.doc_id, r.spans) for r in secrets.report(odd).collect()].count((1, "")) == 2 and secrets.report(nothing).count() == 0
    assert sorted(map(str, secrets.redact(odd).collect())) == sorted(map(str, odd.collect()))


def test_redaction_leaves_columns_whose_names_clash(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    names = ["kept", "found", "hex", "assign", "access", "markov", "m", "g", "t", "o", "row", "clean", "value"]
    docs = spark.createDataFrame([(1, f'token = "{key}"', *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert out[1].text == f'{secrets.MARK}"' and out[2].text is None
    for r in out.values():
        assert key not in str(r) and [r[n] for n in names] == names


def test_markov_finds_keys_inside_longer_runs(spark):
    key = "Zx8Kq2Lm9Vt4Rw7Yp3Nc6Hb1Jd5Gf0S"
    texts = [f"see config/service/database/connection={key}", f"api/client/session/request/{key}/list", key, "config/service/database/connection=value/get_user_name", "internationalization_of_distributed_configuration_management"]
    rows = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts[:3]):
        assert rows[i] == f"markov:{t.index(key)}:{t.index(key) + len(key)}"
    assert rows[3] == rows[4] == ""


def test_markov_error_rates_on_samples_kept_aside(spark):
    """Labelled strings from another source than the training samples: a seeded generator and this package's own identifiers."""
    import random
    import string

    model = secrets.train(secrets.default_samples(spark))
    assert model.found > 0.95 and model.alarms < 0.01
    rng = random.Random(17)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/"]
    keys = ["".join(rng.choice(alphabets[i % 4]) for _ in range(rng.randrange(28, 48))) for i in range(400)]
    names = sorted({n for m in (np, np.linalg, np.random, string, random, zlib, hashlib, secrets, kernel, F) for n in dir(m) if len(n) >= 6})
    plain_ones = ["_".join(rng.sample(names, 3)).lower() for _ in range(400)]
    rows = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(keys + plain_ones)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.report(rows, model).collect() if "markov" in r.spans}
    assert len([i for i in hit if i < 400]) >= 0.95 * 400
    assert len([i for i in hit if i >= 400]) <= 0.03 * 400


# 9 quality


def plain_kneser_ney(texts, order):
    """{context: {byte: log p}} as a function of (context bytes, byte), counted with dictionaries."""
    import collections
    import math

    counts = collections.Counter()
    for t in texts:
        padded = b"\0" * (order - 1) + t.encode()
        counts.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    levels = [counts]
    while len(levels) < order:
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    tables = []
    for c in reversed(levels):
        d = quality.discounts([sum(v == i for v in c.values()) for i in range(1, 5)])
        total, spare = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            spare[g[:-1]] += d[min(n, 3) - 1]
        tables.append((c, d, total, spare))

    def p(gram, size):
        if not size:
            return 1 / 256
        c, d, total, spare = tables[size - 1]
        low, ctx = p(gram, size - 1), gram[len(gram) - size : -1]
        if not total[ctx]:
            return low
        n = c[gram[len(gram) - size :]]
        return (n - (d[min(n, 3) - 1] if n else 0)) / total[ctx] + spare[ctx] / total[ctx] * low

    return lambda gram: math.log(p(gram, order))


@pytest.mark.parametrize("cache", [0, 200, 1 << 40])
def test_kneser_ney_against_dictionaries(spark, cache):
    texts = ["the cat sat on the mat", "a dog and a cat sat", "", "äöü the end", "the the the"]
    others = [*texts[:2], "zebra quartz ß", None, "the dog sat on a mat", "日本"]
    model = quality.Model(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(others)], "doc_id long, text string, lang string")
    code = plain_kneser_ney(texts, quality.ORDER)
    found = {r.doc_id: r for r in quality.surprise(docs, model, cache).collect()}
    for i, t in enumerate(others):
        raw = b"\0" * (quality.ORDER - 1) + (t or "").encode()
        want = -sum(code(raw[j : j + quality.ORDER]) for j in range(len(raw) - quality.ORDER + 1))
        assert found[i].surprise == pytest.approx(want, abs=1e-9) and found[i].n_symbols == len((t or "").encode())
    assert sum(np.exp(code(b"the" + bytes([b]))) for b in range(256)) == pytest.approx(1.0)


def _labelled(spark):
    import random

    rng = random.Random(2)
    good = [(i, prose(rng, 60, 200), "en") for i in range(80)]
    bad = [(100 + i, " ".join(w.upper() + rng.choice(["!!", "$$$", "|"]) for w in prose(rng, 60, 200).split()), "en") for i in range(30)]
    docs = spark.createDataFrame([*good, *bad, (200, None, "en"), (201, "", None), (202, good[0][1], "xx"), (202, good[0][1], "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(100, 0, 0), (3, 1, 0), (3, 0, 0), (5, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = _labelled(spark)
    kept = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[100 + i] for i in range(30)) and kept[200] and kept[201] and kept[202]
    rows = quality.keep_good(docs, labels)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == {d for d, k in kept.items() if k} and rows.count() == 84
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == set(range(0, 80, 2))


def test_thresholds_are_quantiles_on_both_sides(spark):
    import random

    rng = random.Random(4)
    good = [(i, prose(rng, 60, 200), "en") for i in range(1200)]
    bad = [(3000, "w1 " * 100, "en"), (3001, "|$ " * 150, "en")]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [r["doc_id"] for r in spark.range(1200).select(F.col("id").alias("doc_id")).where("pmod(xxhash64(doc_id), 5) = 0").collect()]
    scores = [found[i].score for i in held]
    assert found[0].threshold == pytest.approx(max(scores) + quality.MARGIN, abs=2 * quality.GRID) and min(scores) - quality.MARGIN - 0.1 < found[0].lowest < min(scores) - quality.MARGIN + 2 * quality.GRID
    assert not found[3000].kept and not found[3001].kept and sum(found[i].kept for i in range(1200)) > 1190
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {d for d, r in found.items() if r.kept}


@pytest.mark.parametrize("rows", [0, 10_000])
def test_rows_are_judged_by_themselves(spark, monkeypatch, rows):
    """Ids that are null or shared, however many rows go."""
    docs, labels = _labelled(spark)
    monkeypatch.setattr(quality, "FEW_ROWS", rows)
    assert quality.keep_good(docs, labels).count() == 84
    junk, clean = (docs.where(F.col("doc_id") == i).first().text for i in (100, 5))
    more = docs.unionByName(spark.createDataFrame([(5, junk, "en"), (None, junk, "en"), (None, clean, "en")], docs.schema))
    more = more.select("*", *[F.lit("x").alias(c) for c in ("mean", "lowest", "threshold", "l", "c0", "language")])
    kept = quality.keep_good(more, labels)
    assert kept.columns == more.columns
    assert sorted((r.doc_id is None, r.text == junk) for r in kept.where("doc_id is null or doc_id = 5").collect()) == [(False, False), (True, False)]


def test_quality_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).where("not kept").count() == 0
    assert quality.classify(nothing, labels).count() == 0


# 10 packing


def check_packing(found, texts, limit):
    used = {}
    for d, t in texts.items():
        ids, mine = ids_of(t), sorted((r for r in found if r.doc_id == d), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(i, i * limit, min(limit, len(ids) - i * limit)) for i in range(-(-len(ids) // limit))]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(len(ids_of(t)) for t in texts.values())
    return len(used), -(-total // limit)


@pytest.mark.parametrize("limit", [4096, 256])
def test_packing(docs, rows, limit):
    n, least = check_packing(packing.pack(docs, limit).collect(), dict(rows), limit)
    assert n <= least * 1.1 + 1


def test_plan_is_complete_and_tight():
    rng = np.random.default_rng(6)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(np.clip(rng.lognormal(6.5, 1.0, 20000).astype(int), 1, 4096), return_counts=True), strict=True)}
    steps, n = packing.plan(histogram)
    placed, filled = {}, {}
    for length, first, count, sequence, offset in steps:
        placed.setdefault(length, []).append((first, count))
        for s in range(sequence, sequence + count):
            filled.setdefault(s, []).append((offset, length))
    for length, runs in placed.items():
        at = 0
        for first, count in sorted(runs):
            assert first == at
            at += count
        assert at == histogram[length]
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) == n and n <= -(-sum(k * v for k, v in histogram.items()) // 4096) * 1.01
    assert packing.fit_patterns(np.bincount(list(histogram), weights=list(histogram.values()), minlength=4097), 4096)


def test_nnls():
    rng = np.random.default_rng(3)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_packing_of_odd_rows(odd, nothing):
    assert packing.pack(odd).count() == 6 and packing.pack(nothing).count() == 0
