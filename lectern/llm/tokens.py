"""Block-wise tokenization with a word cache.

``word_bpe_49k.json`` lower-cases and never merges across white space, nor across
the border from a letter to punctuation, so a text's ids are its words' ids in
order, and a word's are those of what precedes its closing punctuation and of
that punctuation. A block's words are hashed, each distinct word is looked up
(or tokenized once) and the ids are gathered by numpy. Words that share a hash
are told apart by their bytes. The cache is bounded, however many words the
corpus has, and only a cache: when it is full, words that no second block had
leave it, which costs time, never results.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

from lectern.llm import kernel

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bounds of the cache: its words, their bytes and ids, and words in the dictionary of the latest.
MOST_WORDS, MOST_BYTES, MOST_LATEST = 2_000_000, 128 << 20, 50_000
#: Words that are tokenized at once.
AT_ONCE = 4096

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[list(b".,!?;:*$%&#")] = True

_OPEN: dict[tuple[str, int], "WordTokenizer"] = {}


def without_closing(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with up to three closing punctuation marks after an ASCII letter as words of their own."""
    tail, open_ = np.zeros(len(end), np.int64), np.ones(len(end), bool)
    for _ in range(3):
        at = end - tail - 1
        open_ &= (at > start) & _CLOSING[buf[np.maximum(at, 0)]]
        tail += open_
    tail[~_LETTER[buf[np.maximum(end - tail - 1, 0)]]] = 0
    split = tail > 0
    slot = np.arange(len(end)) + np.cumsum(split) - split
    many = len(end) + int(split.sum())
    starts, ends = np.empty(many, np.int64), np.empty(many, np.int64)
    starts[slot], ends[slot] = start, end - tail
    starts[slot[split] + 1], ends[slot[split] + 1] = (end - tail)[split], end[split]
    return starts, ends, np.append(slot, many)[first]


class WordTokenizer:
    """Ids of words by their hashes: sorted arrays of most words met so far, and a dictionary of the latest."""

    def __init__(self, path: str, share: int = 1):
        """share: the cache has a ``share``-th of its bounds."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.share = Tokenizer.from_file(path), share
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.latest: dict[int, int] = {}
        self.met = 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.letters, self.written = np.zeros(1 << 20, np.uint8), 0
        self.places, self.spans = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)

    def _make_room(self) -> None:
        """Keep the words that were met in a second block; where they are more than half of what may be kept, none."""
        self._merge()
        kept = self.again[self.slots]
        hashes, slots = self.hashes[kept], self.slots[kept]
        places, spans, starts, lengths = self.places[slots], self.spans[slots], self.starts[slots], self.lengths[slots]
        letters, ids = self.letters[kernel.ragged(places, spans)], self.ids[kernel.ragged(starts, lengths)]
        self._reset()
        if 2 * len(slots) <= MOST_WORDS // self.share and 2 * (len(letters) + ids.nbytes) <= MOST_BYTES // self.share:
            self._keep(letters, spans, ids, lengths)
            self.hashes, self.slots = hashes, np.arange(len(slots))

    def _merge(self) -> None:
        """The latest words go to the sorted arrays."""
        h = np.concatenate([self.hashes, np.fromiter(self.latest, np.uint64, len(self.latest))])
        found = np.concatenate([self.slots, np.fromiter(self.latest.values(), np.int64, len(self.latest))])
        order = np.argsort(h)
        self.hashes, self.slots, self.latest = h[order], found[order], {}

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Tokenize words not met before; their places among the words met."""
        found = [e.ids for e in self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        raw = kernel.LOWER[np.frombuffer(b"".join(words), dtype=np.uint8)]
        spans = np.fromiter(map(len, words), np.int64, len(words))
        return self._keep(raw, spans, flat, sizes)

    def _keep(self, raw: np.ndarray, spans: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append words (``raw`` letters of ``spans`` bytes each, ``flat`` ids of ``sizes`` each); their places among the words met."""
        while self.met + len(sizes) > len(self.starts):
            self.starts, self.lengths, self.places, self.spans, self.again = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths, self.places, self.spans, self.again))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        while self.written + len(raw) + 8 > len(self.letters):
            self.letters = np.concatenate([self.letters, self.letters])
        new = slice(self.met, self.met + len(sizes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.letters[self.written : self.written + len(raw)] = raw
        self.starts[new], self.lengths[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.places[new], self.spans[new] = self.written + np.cumsum(spans) - spans, spans
        self.met, self.used, self.written = new.stop, self.used + len(flat), self.written + len(raw)
        return np.arange(new.start, new.stop)

    def _slots(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's place among the words met."""
        if self.met > MOST_WORDS // self.share or self.written + self.ids.itemsize * self.used > MOST_BYTES // self.share:
            self._make_room()
        line, size, met = kernel.folded(buf), end - start, self.met
        hashes, at, each = np.unique(kernel.line_hashes(line, start, end), return_index=True, return_inverse=True)
        slot = np.full(len(hashes), -1, np.int64)
        if len(self.hashes) and len(hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[place] == hashes
            slot[known] = self.slots[place[known]]
        rest = np.flatnonzero(slot < 0)
        keys = hashes[rest].tolist()
        new = [i for i, h in enumerate(keys) if h not in self.latest]
        whole = memoryview(np.ascontiguousarray(buf))
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            s, e = start[at[rest[part]]].tolist(), end[at[rest[part]]].tolist()
            learnt = self._learn([bytes(whole[a:b]) for a, b in zip(s, e, strict=True)])
            self.latest.update(zip((keys[k] for k in part), learnt.tolist(), strict=True))
        slot[rest] = np.fromiter((self.latest[h] for h in keys), np.int64, len(keys))
        self.again[slot[slot < met]] = True
        if len(self.latest) > MOST_LATEST:
            self._merge()
        out = slot[each]
        same = self.spans[out] == size  # words of up to eight bytes with equal hash and size are equal
        wide = np.flatnonzero(same & (size > 8))
        same[wide] = kernel.same_spans(line, start[wide], size[wide], self.letters, self.places[out[wide]])
        for i in np.flatnonzero(~same).tolist():  # another word has this one's hash
            out[i] = self._learn([bytes(whole[start[i] : end[i]])])[0]
        return out

    def count(self, buf: np.ndarray, offs: np.ndarray, end_id: int | None = END_ID) -> np.ndarray:
        """Offsets of each document's ids, as ``encode`` has them."""
        start, end, first = without_closing(buf, *kernel.words(buf, offs))
        slot = self._slots(buf, start, end)
        sums = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(self.lengths[slot], out=sums[1:])
        return sums[first] + (np.arange(len(offs)) if end_id is not None else 0)

    def encode(self, buf: np.ndarray, offs: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of documents, each ended by ``end_id`` if given."""
        start, end, first = without_closing(buf, *kernel.words(buf, offs))
        slot = self._slots(buf, start, end)
        starts, lengths = self.starts[slot], self.lengths[slot]
        if end_id is not None:  # a document's end is a word of one id, kept behind all others
            ends = first[1:] + np.arange(len(offs) - 1)
            mine = np.ones(len(slot) + len(ends), dtype=bool)
            mine[ends] = False
            starts, lengths = _spread(mine, starts, self.used), _spread(mine, lengths, 1)
            first = first + np.arange(len(offs))
            if self.used == len(self.ids):
                self.ids = np.concatenate([self.ids, self.ids])
            self.ids[self.used] = end_id
        sums = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        return self.ids[kernel.ragged(starts, lengths)], sums[first]


def _spread(mine: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    out = np.full(len(mine), other, np.int64)
    out[mine] = values
    return out


def tokenizer(path: str | None = None, share: int = 1) -> WordTokenizer:
    """This process's tokenizer for a vocabulary file (by default the public one, wherever this machine has it)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if (path, share) not in _OPEN:
        _OPEN[path, share] = WordTokenizer(path, share)
    return _OPEN[path, share]
