"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def near(docs):
    """{doc_id: (size, component)} for unique ids."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, length):
    """[(n_bytes, n_removed, n_spans, sha256)] in order."""
    texts = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def any_case(word):
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([any_case(w) for w in ("password", "passwd", "secret", "token")] + [any_case("api") + "_?" + any_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(found)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(docs):
    """[(n_tokens, n_known, train_tokens, base_score)] in order."""
    count, ends = collections.Counter(), 0
    for d, t in docs:
        if not held(d):
            count.update(words(t))
            ends += 1
    total, types = sum(count.values()) + ends, len(count) + (ends > 0)
    lp = lambda c: math.log10((c + 1) / (total + types + 1))
    return [(len(words(t)) + 1, sum(w in count for w in words(t)) + (ends > 0), total, sum(lp(count[w]) for w in words(t)) + lp(ends)) for _, t in docs]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :]).group()
