"""License scans: a positional index of licence wordings, looked up by their rarest words.

Words are runs of digits, letters a to z (A to Z folded) and non-ASCII characters.
Exact phrases (``PHRASES``) are found wherever their words stand consecutively.
Beyond them, each wording of ``WORDINGS`` is indexed by position:

1. How many texts have each licence word is counted over the whole corpus; the
   ``SEEDS`` rarest words of a wording are its postings. So a file is looked up by
   those of its licence words that have the highest inverse document frequency
   for some wording, however many there are.
2. Each occurrence minus the word's place in the wording is where the wording
   would begin. Places that at least ``AGREE`` postings agree on are candidates.
3. A candidate's score is the share, weighted by inverse document frequency, of
   the wording's words that stand in their places. From ``LEAST`` on, and with all
   of the wording's key phrases inside it, word by word, it is a match.

The index has a few hundred words and is part of every task; the corpus sends a
count a licence word and task. Texts are neither shuffled nor cut.

Defined cases: null text counts as empty; an empty text has no words, no labels
and the score 0; ties of rarity go by the word, equal matches are all returned;
overlapping matches all count; repeated rows and null ids are scanned row by row;
an empty table gives no rows; other columns are returned by ``scan``, whatever
their names, and ignored by ``report``; a very long text is scanned whole, in
space that grows with its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernel

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: label, wording, key phrases of the wording
WORDINGS = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "released under the creative commons zero cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("affero general public license version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
SEEDS, AGREE, LEAST = 3, 2, 0.6
VOCABULARY = sorted({w for phrase, _ in PHRASES for w in phrase.split()} | {w for _, text, keys in WORDINGS for part in (text, *keys) for w in part.split()})
ROWS = 1 << 16  # candidates held against a wording at once

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True
_PLACES = "array<struct<label:string,start:long,words:int,score:double>>"


class Vocabulary:
    """Licence words of a block by number: hashes found by binary search, words told apart by their bytes."""

    def __init__(self) -> None:
        self.line = kernel.folded(np.frombuffer("".join(VOCABULARY).encode(), np.uint8))
        size = np.array([len(w) for w in VOCABULARY])
        self.place, self.size = np.cumsum(size) - size, size
        hashes = kernel.line_hashes(self.line, self.place, self.place + size)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word or -1, with a -2 behind each text; first[d]:first[d + 1] - 1 are text d's)."""
        inside = _IS_WORD[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offs] = True
        before, after = np.zeros(len(buf), dtype=bool), np.zeros(len(buf), dtype=bool)
        if len(buf):
            before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        line = kernel.folded(buf)
        hashes = kernel.line_hashes(line, start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == hashes)
        number = self.order[at[known]]
        same = (self.size[number] == (end - start)[known]) & kernel.same_spans(line, start[known], self.size[number], self.line, self.place[number])
        first = np.searchsorted(start, offs)
        out = np.full(len(start) + len(offs) - 1, -1, np.int32)
        slot = np.arange(len(start)) + np.repeat(np.arange(len(offs) - 1), np.diff(first))
        out[slot[known[same]]] = number[same]
        first = first + np.arange(len(offs))
        out[first[1:] - 1] = -2
        return out, first


def _numbered(text: str) -> np.ndarray:
    return np.array([VOCABULARY.index(w) for w in text.split()], dtype=np.int32)


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively."""
    found = np.flatnonzero(ids[: max(len(ids) - len(phrase) + 1, 0)] == phrase[0])
    for i, w in enumerate(phrase[1:], 1):
        found = found[ids[found + i] == w]
    return found


class Index:
    """Postings and weights of the wordings, by the corpus's counts of their words."""

    def __init__(self, texts: int, having: dict[str, int]):
        self.weight = np.array([math.log((texts + 1) / (having.get(w, 0) + 1)) + 1 for w in VOCABULARY])
        self.wordings = []
        for label, text, keys in WORDINGS:
            words = text.split()
            seeds = sorted(set(words), key=lambda w: (having.get(w, 0), w))[:SEEDS]
            self.wordings.append((label, _numbered(text), [(VOCABULARY.index(w), q) for q, w in enumerate(words) if w in seeds], [_numbered(k) for k in keys]))

    def matches(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(label, words, text, start among the block's words, score) of each wording's matches."""
        at = {w: np.flatnonzero(ids == w) for w in {w for _, _, seeds, _ in self.wordings for w, _ in seeds}}
        for label, words, seeds, keys in self.wordings:
            hits = [at[w] for w, _ in seeds]
            here = np.concatenate(hits)
            if not len(here):
                continue
            begin = here - np.repeat([q for _, q in seeds], [len(h) for h in hits])
            doc = np.searchsorted(first, here, side="right") - 1
            span = len(ids) + 2 * len(words)
            pair, agree = np.unique(doc * span + begin + len(words), return_counts=True)
            pair = pair[agree >= AGREE]
            doc, begin = pair // span, pair % span - len(words)
            score = np.concatenate([np.zeros(0), *[self._score(ids, first, words, doc[i : i + ROWS], begin[i : i + ROWS]) for i in range(0, len(doc), ROWS)]])
            good = score >= LEAST
            for key in keys:
                counted = np.zeros(len(ids) + 1, np.int64)
                counted[places(ids, key) + 1] = 1
                counted = np.cumsum(counted)
                low = np.maximum(begin, first[doc])
                high = np.minimum(begin + len(words), first[doc + 1] - 1) - len(key) + 1
                good &= (high > low) & (counted[np.maximum(high, 0)] > counted[low])
            yield label, len(words), doc[good], begin[good], score[good]

    def _score(self, ids: np.ndarray, first: np.ndarray, words: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
        got = np.zeros(len(doc))
        for q, w in enumerate(words.tolist()):
            at = begin + q
            inside = (at >= first[doc]) & (at < first[doc + 1] - 1)
            got += self.weight[w] * (inside & (ids[np.clip(at, 0, len(ids) - 1)] == w))
        return got / self.weight[words].sum()


def index(docs: DataFrame, text_col: str = "text") -> Index:
    """The index by the words of all texts; a count a licence word and task is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, having, texts = Vocabulary(), np.zeros(len(VOCABULARY), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, buf, offs in kernel.blocks(batch, "text"):
                ids, first = known.numbers(buf, offs)
                at = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(first, at, side="right") - 1
                having += np.bincount(np.unique(doc * len(VOCABULARY) + ids[at]) % len(VOCABULARY), minlength=len(VOCABULARY))
        yield pa.RecordBatch.from_arrays([pa.array([*VOCABULARY, ""]), pa.array([*having.tolist(), texts])], ["word", "n"])

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    found = {r.word: r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a licence word
    return Index(found.pop("", 0), found)


def scan(docs: DataFrame, known: Index | None = None, text_col: str = "text") -> DataFrame:
    """(row, n_words, base, found): the row of ``docs``, its number of words, the places of phrases and the matches of wordings (label, start, words, score), in order."""
    known = index(docs, text_col) if known is None else known
    phrases = [(_numbered(p), label) for p, label in PHRASES]
    rest = [f.name for f in docs.schema.fields]

    def listed(n: int, parts: list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
        doc = np.concatenate([np.zeros(0, np.int64), *[p[2] for p in parts]])
        start = np.concatenate([np.zeros(0, np.int64), *[p[3] for p in parts]])
        kind = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]).astype(np.int64)
        order = np.lexsort((kind, start, doc))
        labels = pa.array([p[0] for p in parts], pa.string()).take(pa.array(kind[order])) if parts else pa.array([], pa.string())
        sizes = np.array([p[1] for p in parts], np.int32)[kind[order]] if parts else np.zeros(0, np.int32)
        scores = np.concatenate([np.zeros(0), *[p[4] for p in parts]])[order]
        rows = pa.StructArray.from_arrays([labels, pa.array(start[order]), pa.array(sizes), pa.array(scores)], ["label", "start", "words", "score"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        for batch in batches:
            for rows, buf, offs in kernel.blocks(batch, "text"):
                ids, first = words.numbers(buf, offs)
                exact = []
                for phrase, label in phrases:
                    at = places(ids, phrase)
                    doc = np.searchsorted(first, at, side="right") - 1
                    exact.append((label, len(phrase), doc, at - first[doc], np.ones(len(at))))
                near = [(label, n, doc, begin - first[doc], score) for label, n, doc, begin, score in known.matches(ids, first)]
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first) - 1), listed(n, exact), listed(n, near)], ["row", "n_words", "base", "found"])

    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest if c != text_col]).alias("row") if len(rest) > 1 else F.struct(F.lit(None).cast("int").alias("none")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, n_words long, base {_PLACES}, found {_PLACES}")


def _labels(*arrays: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda p: p["label"]) for a in arrays]))), ",")


def report(docs: DataFrame, known: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document: places of the exact phrases, labels of both kinds, and the best match's score (1 for a phrase, 0 for nothing)."""
    starts = F.transform("base", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform(F.concat("base", "found"), lambda p: p["score"])), F.lit(0.0))
    return scan(docs.select("doc_id", "text"), known).select("row.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _labels("base").alias("base_labels"), _labels("base", "found").alias("labels"), F.round(best, 6).alias("score"))


def report_sql() -> str:
    """DuckDB SQL of ``report``: a row a word, joined with the postings."""
    quoted = lambda t: "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"
    wordings = ", ".join(f"({i}, '{label}', {quoted(text)})" for i, (label, text, _) in enumerate(WORDINGS))
    keys = ", ".join(f"({i}, '{k}', {quoted(k)})" for i, (_, _, keys) in enumerate(WORDINGS) for k in keys)
    exact = "(values ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc']))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""with d as materialized (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from documents),
w as materialized (select row, unnest(ws) as word, generate_subscripts(ws, 1) as nth from d),
l as (select * from (values {wordings}) t(wording, label, words)), k as (select * from (values {keys}) t(wording, phrase, words)),
t as (select wording, unnest(words) as word, generate_subscripts(words, 1) as q from l),
idf as materialized (select word, coalesce(n, 0) as n, ln(((select count(*) from documents) + 1) / (coalesce(n, 0) + 1)) + 1 as idf from (select distinct word from t) left join (select word, count(distinct row) as n from w group by word) using (word)),
seeds as (select wording, word from (select wording, word, row_number() over (partition by wording order by n, word) as r from (select distinct wording, word from t) join idf using (word)) where r <= {SEEDS}),
c as materialized (select row, wording, nth - q as begin, from w join (select * from t semi join seeds using (wording, word)) using (word) group by all having count(*) >= {AGREE}),
s as (select c.row, c.wording, begin, sum(idf) / any_value(whole) as score from c join t using (wording) join w on w.row = c.row and w.nth = begin + q and w.word = t.word join idf on idf.word = t.word join (select wording, sum(idf) as whole from t join idf using (word) group by wording) using (wording) group by all),
kp as (select distinct w.row, phrase, nth, len(words) as size from (select distinct phrase, words from k) k join w on w.word = words[1] join d on d.row = w.row where ws[nth:nth + len(words) - 1] = words),
m as (select s.row, label, score from s join l using (wording) where score >= {LEAST} and not exists (from k where k.wording = s.wording and not exists (from kp where kp.row = s.row and kp.phrase = k.phrase and kp.nth > s.begin and kp.nth + kp.size - 1 <= s.begin + len(l.words)))),
b as (select w.row, label, nth - 1 as at_word from {exact} e(label, words) join w on w.word = words[1] join d on d.row = w.row where ws[nth:nth + len(words) - 1] = words),
bb as (select row, count(*) as n, min(at_word) as first_word, max(at_word) as last_word, string_agg(distinct label, ',' order by label) as labels from b group by row),
al as (select row, string_agg(distinct label, ',' order by label) as labels, max(score) as score from (select row, label, 1.0::double as score from b union all select row, label, score from m) group by row)
select doc_id, len(ws) as n_words, coalesce(n, 0) as n_base, first_word, last_word, coalesce(bb.labels, '') as base_labels, coalesce(al.labels, '') as labels, round(coalesce(score, 0.0), 6) as score from d left join bb using (row) left join al using (row)"""
