"""Suffix order of a shard by induced sorting.

The suffixes that begin a rise after a fall (LMS) are sorted first: their
substrings are sorted by one induction and named, and the order of the reduced
string, a third as long or less, comes from ranks of doubling depth. From it,
two inductions put all suffixes in order: a sweep over the sorted suffixes sends
each one's predecessor to the queue of its first character, so the queues are a
priority queue of suffix tuples by (character, order of arrival) and each
character's queue is already sorted when its turn comes. Queues, the sorted falls among them, keep runs of
tuples in memory up to a budget and then on disk. The text and the order that
comes out stay in memory, so a shard has to fit there.

Order is exact to ``depth`` characters; suffixes that agree so far are
neighbours in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

from lectern.llm import kernel

RUN = 1 << 22


class Queues:
    """A monotone priority queue of text positions: priority is a character, ties leave in order of arrival."""

    def __init__(self, priorities: int, run: int = RUN):
        self.runs: list[list] = [[] for _ in range(priorities)]
        self.held, self.run, self.file, self.end = 0, run, None, 0

    def push(self, priority: np.ndarray, position: np.ndarray) -> None:
        if not len(position):
            return
        order = np.argsort(priority, kind="stable")
        position = position[order]
        many = np.bincount(priority, minlength=len(self.runs))
        end = many.cumsum().tolist()
        for c in many.nonzero()[0].tolist():
            self.runs[c].append(position[end[c - 1] if c else 0 : end[c]])
        self.held += len(position)
        if self.held > self.run:
            self._spill()

    def append(self, priority: int, position: np.ndarray) -> None:
        """Push positions of one priority."""
        self.runs[priority].append(position)
        self.held += len(position)
        if self.held > self.run:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for c, runs in enumerate(self.runs):
            for i, r in enumerate(runs):
                if isinstance(r, np.ndarray):
                    self.file.write(r.tobytes())
                    runs[i] = (self.end, len(r), r.dtype)
                    self.end += r.nbytes
        self.held = 0

    def pop(self, priority: int) -> np.ndarray:
        """All positions of a priority, in order of arrival."""
        out = []
        for r in self.runs[priority]:
            if isinstance(r, tuple):
                self.file.seek(r[0])
                r = np.frombuffer(self.file.read(r[1] * r[2].itemsize), dtype=r[2])
            else:
                self.held -= len(r)
            out.append(r)
        self.runs[priority] = []
        return np.concatenate(out) if len(out) > 1 else out[0] if out else _NONE


_NONE = np.zeros(0, dtype=np.int32)


def types_of(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor (S), with an end below all characters."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.searchsorted(differs, np.arange(n))  # first place at or after i where the next character differs
    rises = np.zeros(n, dtype=bool)
    inside = nearest < len(differs)
    rises[inside] = text[differs[nearest[inside]]] < text[differs[nearest[inside]] + 1]
    return rises


def induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, priorities: int) -> np.ndarray:
    """Order of all suffixes from LMS positions that are sorted (or, to sort their substrings, only grouped) by character."""
    n = len(text)
    stars, falls, rises = Queues(priorities), Queues(priorities), Queues(priorities)
    stars.push(text[lms], lms)
    if n and not s_type[n - 1]:
        falls.push(text[n - 1 : n], np.array([n - 1], dtype=lms.dtype))  # the end precedes all and induces the last suffix
    sorted_falls = Queues(priorities)

    def sweep(run: np.ndarray, c: int, queue: Queues, wanted: bool) -> np.ndarray:
        """Send the predecessors of the wanted type on; those that begin with c as well come back, to be swept next."""
        before = run[run > 0] - 1
        before = before[s_type[before] == wanted]
        first = text[before]
        same = first == c
        queue.push(first[~same], before[~same])
        return before[same]

    for c in range(priorities):
        todo = falls.pop(c)
        while len(todo):
            sorted_falls.append(c, todo)
            todo = sweep(todo, c, falls, False)
        last = stars.pop(c)
        if len(last):
            sweep(last, c, falls, False)
    out: list[np.ndarray] = []
    for c in range(priorities - 1, -1, -1):
        todo = rises.pop(c)
        while len(todo):
            out.append(todo)
            todo = sweep(todo, c, rises, True)
        low = sorted_falls.pop(c)[::-1]
        if len(low):
            out.append(low)
            sweep(low, c, rises, True)
    return np.concatenate(out)[::-1] if out else np.zeros(0, dtype=lms.dtype)


def _ranks(order: np.ndarray, same_as_previous: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(~same_as_previous)
    return rank


def suffix_order(text: np.ndarray, depth: int, priorities: int = 257) -> np.ndarray:
    """Positions of all suffixes of ``text`` (values below ``priorities``), in order to ``depth`` characters."""
    n = len(text)
    s_type = types_of(text)
    star = np.zeros(n, dtype=bool)
    star[1:] = s_type[1:] & ~s_type[:-1]
    kind = np.int32 if n < 1 << 31 else np.int64
    lms = np.flatnonzero(star).astype(kind)
    if len(lms) > 1:
        rough = induce(text, s_type, lms, priorities)
        rough = rough[star[rough]]
        after = np.append(lms[1:], n)
        length = np.zeros(n, dtype=np.int64)
        length[lms] = np.minimum(after + 1, n) - lms
        whole = kernel.span_hashes_of(text, lms, np.minimum(after + 1, n))
        number = np.zeros(n, dtype=np.int64)
        number[lms] = np.arange(len(lms))
        at = number[rough]
        same = np.zeros(len(rough), dtype=bool)
        same[1:] = (whole[at[1:]] == whole[at[:-1]]) & (length[rough[1:]] == length[rough[:-1]])
        rank = _ranks(at, same)
        step = 1
        while step < depth and rank.max() < len(rank):
            follow = np.zeros(len(rank), dtype=np.int64)
            follow[:-step] = rank[step:]
            pair = rank * (len(rank) + 1) + follow
            order = np.argsort(pair, kind="stable")
            same = np.append(False, pair[order][1:] == pair[order][:-1])
            rank = _ranks(order, same)
            step *= 2
        lms = lms[np.argsort(rank, kind="stable")]
    return induce(text, s_type, lms, priorities)
