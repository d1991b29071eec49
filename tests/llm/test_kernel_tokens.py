from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import idset, kernel, packing, repeats, suffix, tokens
from tests.llm import plain

TEXT = st.text(alphabet="ab AB.,!\n\té\u00a0日'x9#|", max_size=60)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_and_shingles(texts):
    buf, offs = kernel.column_bytes(pa.array(texts, pa.string()))
    start, end, first = kernel.words(buf, offs)
    raw = bytes(buf)
    for d, t in enumerate(texts):
        assert [raw[s:e].decode().translate(plain.UPPER) for s, e in zip(start[first[d] : first[d + 1]], end[first[d] : first[d + 1]], strict=True)] == plain.words(t)
    h, at = kernel.document_shingles(buf, offs)
    assert [len(set(h[a:b].tolist())) for a, b in zip(at, at[1:], strict=False)] == [len(plain.shingles(t)) for t in texts]


def test_equal_words_have_equal_hashes():
    buf, offs = kernel.column_bytes(pa.array(["The cat", "x the", None], pa.string()))
    start, end, _ = kernel.words(buf, offs)
    h = kernel.span_hashes(buf, start, end)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_tokens_are_the_tokenizers(texts):
    tok = tokens.tokenizer()
    buf, offs = kernel.column_bytes(pa.array(texts, pa.string()))
    ids, cuts = tok.encode(buf, offs)
    assert (tok.count(buf, offs) == cuts).all()
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == tok.model.encode(t, add_special_tokens=False).ids + [tokens.END_ID]


def test_word_cache_survives_its_limits(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_LATEST", 3)
    monkeypatch.setattr(tokens, "MOST_WORDS", 10)
    tok = tokens.WordTokenizer(public_tokenizers.path(tokens.TOKENIZER))
    for texts in (["a b c d e", "f g. h!"], ["i j k l m n o p q r s"], ["a z b."]):
        buf, offs = kernel.column_bytes(pa.array(texts, pa.string()))
        ids, cuts = tok.encode(buf, offs, None)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [tok.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_cache_keeps_words_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 200)
    tok = tokens.WordTokenizer(public_tokenizers.path(tokens.TOKENIZER))
    learnt, learn = [], tok._learn
    monkeypatch.setattr(tok, "_learn", lambda words: learnt.extend(words) or learn(words))
    common = [f"common{i}" for i in range(20)]
    for block in range(12):
        text = " ".join([*common, *(f"b{block}x{i}" for i in range(90))])
        ids, _ = tok.encode(*kernel.column_bytes(pa.array([text])), None)
        assert ids.tolist() == tok.model.encode(text, add_special_tokens=False).ids
        assert tok.met <= 200 + 110
    assert sorted(w.decode() for w in learnt if w.startswith(b"common")) == sorted(common)


def test_word_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 1 << 20)
    tok = tokens.WordTokenizer(public_tokenizers.path(tokens.TOKENIZER))
    for block in range(12):
        text = f"{block}" + "ab" * 100_000
        assert tok.encode(*kernel.column_bytes(pa.array([text])), None)[0].tolist() == tok.model.encode(text, add_special_tokens=False).ids
    assert tok.written < 3 << 20


def test_word_cache_does_not_grow_with_the_corpus():
    tok = tokens.WordTokenizer(public_tokenizers.path(tokens.TOKENIZER), packing.CACHE_SHARE)
    for block in range(24):
        tok.encode(*kernel.column_bytes(pa.array([" ".join(f"{i:x}" for i in range(block * 25_000, block * 25_000 + 25_000))])), None)
    assert sum(v.nbytes for v in vars(tok).values() if isinstance(v, np.ndarray)) < 40 << 20


@given(st.lists(st.integers(1, 3), min_size=1, max_size=120))
@settings(max_examples=80, deadline=None)
def test_suffix_order(values):
    text = np.array(values, dtype=np.uint16)
    raw = text.astype(np.uint8).tobytes()
    assert suffix.suffix_order(text, 1 << 20).tolist() == sorted(range(len(values)), key=lambda i: raw[i:])


def test_queues_spill_to_disk(monkeypatch):
    monkeypatch.setattr(suffix, "RUN", 8)
    q = suffix.Queues(4, run=8)
    rng = np.random.default_rng(0)
    sent = [[], [], [], []]
    for _ in range(20):
        c, p = rng.integers(0, 4, 5).astype(np.uint16), rng.integers(0, 1000, 5).astype(np.int32)
        q.push(c, p)
        for x, y in zip(c.tolist(), p.tolist(), strict=True):
            sent[x].append(y)
    assert q.file is not None
    assert [q.pop(c).tolist() for c in range(4)] == sent


@given(st.lists(st.integers(1, 3), min_size=1, max_size=200))
@settings(max_examples=40, deadline=None)
def test_suffix_order_with_queues_on_disk(values):
    text = np.array(values, dtype=np.uint16)
    raw, whole = text.astype(np.uint8).tobytes(), suffix.Queues.__init__
    suffix.Queues.__init__ = lambda self, priorities, run=3: whole(self, priorities, 3)
    try:
        assert suffix.suffix_order(text, 1 << 20).tolist() == sorted(range(len(values)), key=lambda i: raw[i:])
    finally:
        suffix.Queues.__init__ = whole


def test_repeated_starts():
    texts = [b"abcdefgh" * 3, b"zzabcdefghzz", b"unique-text"]
    found = repeats.repeated_starts([(t, len(t) - 5) for t in texts], 6)
    count = {}
    for t in texts:
        for i in range(len(t) - 5):
            count[t[i : i + 6]] = count.get(t[i : i + 6], 0) + 1
    assert [f.tolist() for f in found] == [[count[t[i : i + 6]] > 1 for i in range(len(t) - 5)] for t in texts]


def test_words_that_share_a_hash_keep_their_ids(monkeypatch):
    honest = kernel.line_hashes
    monkeypatch.setattr(kernel, "line_hashes", lambda line, start, end: np.where(end - start > 8, (end - start).astype(np.uint64) % np.uint64(3), honest(line, start, end)))
    tok = tokens.WordTokenizer(public_tokenizers.path(tokens.TOKENIZER))
    for texts in (["abc abd extraordinary extraordinarz tokenization", "of Of the"], ["extraordinarz abc x internationally"]):
        buf, offs = kernel.column_bytes(pa.array(texts, pa.string()))
        ids, cuts = tok.encode(buf, offs, None)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [tok.model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("size", [16, 64, 1024, 4096])
def test_thue_morse_words_differ(size):
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    buf, offs = kernel.column_bytes(pa.array([word, other, word], pa.string()))
    start, end, _ = kernel.words(buf, offs)
    hashes = kernel.span_hashes(buf, start, end)
    sums = kernel.span_hashes_of(buf, start, end)
    assert hashes[0] == hashes[2] != hashes[1] and sums[0] == sums[2] != sums[1]
    tok = tokens.tokenizer()
    ids, cuts = tok.encode(buf, offs)
    for i, t in enumerate((word, other, word)):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == [*tok.model.encode(t, add_special_tokens=False).ids, tokens.END_ID]


@given(st.binary(max_size=200), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_rolling_hashes_follow_content(raw, width):
    twice = np.frombuffer(raw + b"-" + raw, dtype=np.uint8)
    found = kernel.rolling(twice, width)
    assert len(found) == max(len(twice) - width + 1, 0)
    inside = max(len(raw) - width + 1, 0)
    assert (found[:inside] == found[len(raw) + 1 : len(raw) + 1 + inside]).all()


def test_ids_of_the_bitmap(spark):
    ids = [0, 1, 5, (3 << 40) + 7, -9]
    found = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(idset.place()).collect()]
    assert found == repeats._place(np.array(ids)).tolist()
    bits = idset.bitmap(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert idset.passes(bits, np.array(found)).all() and not idset.passes(bits, np.array([17])).any()
