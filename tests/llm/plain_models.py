"""Plain versions of the models that score text: partial matching with dictionaries, key characters by all stretches."""

from __future__ import annotations

import collections
import math
import re

from tests.llm import plain

ROWS, COLUMNS = 56, 33  # classes of counts and of numbers of symbols


def line(text, order):
    return b"\n" * order + " ".join(plain.words(text)).encode() + b"\n"


def count_class(n):
    return int(n) if n < 16 else min(int(8 + 2 * math.log2(n) + 1e-9), ROWS - 1)


def escape_shares(contexts):
    """{(class of n, q): share} from [(n, q, counted once)] of a level: in a context of n + 1 counts, take one away and see whether it was new."""
    alike = collections.defaultdict(list)
    for n, q, once in contexts:
        alike[(n if n <= 16 else 16 + math.floor(2 * math.log2(n)), min(q, COLUMNS))].append((n, once))
    new, old = collections.Counter(), collections.Counter()
    for (_, q), members in alike.items():
        row = count_class(sum(n for n, _ in members) / len(members) - 1)
        new[row, q - 1] += sum(once for _, once in members)
        old[row, min(q, COLUMNS - 1)] += sum(n - once for n, once in members)
    out = {}
    for row in range(ROWS):
        n = row if row < 16 else 2 ** ((row - 8) / 2)
        for q in range(COLUMNS):
            prior = min(max(q / (2 * max(n, 1)), 0.0005), 0.9)
            share = (new[row, q] + 4 * prior) / (new[row, q] + old[row, q] + 4)
            out[row, q] = min(max(share, 1e-5), 1.0) if q else 1.0
    return out


class PartialMatching:
    """Counts of order + 1 bytes; a shorter context counts the longer ones in which its symbol was seen."""

    def __init__(self, texts, order):
        self.order = order
        level = collections.Counter()
        for text in texts:
            b = line(text, order)
            level.update(b[i - order : i + 1] for i in range(order, len(b)))
        nodes = [level]
        for _ in range(order):
            nodes.insert(0, collections.Counter(gram[1:] for gram in nodes[0]))
        self.levels, self.escapes = [], []
        for level in nodes:
            contexts = collections.defaultdict(dict)
            for gram, n in level.items():
                contexts[gram[:-1]][gram[-1]] = n
            self.levels.append(contexts)
            self.escapes.append(escape_shares([(sum(c.values()), len(c), sum(n == 1 for n in c.values())) for c in contexts.values()]))

    def symbol(self, gram):
        total, excluded, ruled_out = 0.0, 0, 0
        for o in range(self.order, -1, -1):
            context = gram[len(gram) - 1 - o : -1]
            seen = self.levels[o].get(context)
            if not seen:
                continue
            rest = max(sum(seen.values()) - excluded, 0)
            left = min(max(len(seen) - ruled_out, 0), COLUMNS - 1)
            escape = self.escapes[o][count_class(rest), left] if rest else 1.0
            hit = seen.get(gram[-1])
            p = escape if hit is None else (1 - escape) * hit / max(rest, 1)
            total += math.log10(min(max(p, 1e-9), 1.0))
            if hit is not None:
                return total
            if o:
                excluded = sum(self.levels[o - 1][context[1:]][s] for s in seen)
            ruled_out = len(seen)
        return total - math.log10(max(256 - ruled_out, 1))

    def score(self, text):
        b = line(text, self.order)
        return sum(self.symbol(b[i - self.order : i + 1]) for i in range(self.order, len(b)))


def best_stretch(token, weights):
    """(sum, first, last) in thousandths: of all stretches of greatest sum the one that ends first, then the shortest; characters from 0, last included."""
    best = (0, 0, -1)
    for last in range(1, len(token)):
        total = 0
        for first in range(last - 1, -1, -1):
            total += weights[token[first], token[first + 1]]
            if total > best[0]:
                best = (total, first, last)
    return best


def markov_spans(text, weights, threshold, least):
    """(start, end) of stretches drawn out to the next mark that no base span meets."""
    out = []
    base = plain.base_spans(text)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, text or ""):
        token = m.group()
        total, first, last = best_stretch(token, weights)
        end = last + 1
        if token[first] in "/=_-":
            while first < len(token) and token[first] in "/=_-":
                first += 1
        else:
            while first and re.match("[A-Za-z0-9+]", token[first - 1]):
                first -= 1
        if end and token[end - 1] in "/_-":
            while end and token[end - 1] in "/_-":
                end -= 1
        else:
            while end < len(token) and re.match("[A-Za-z0-9+]", token[end]):
                end += 1
        start, end = m.start() + first, m.start() + end
        if total / 1000 >= threshold and end - start >= least and not any(a < end and start < b for a, _, b in base):
            out.append((start, end))
    return out
