"""Columnar text kernel: whole Arrow string columns to word and shingle hashes.

Every Python-side operator of this subpackage reads its texts through here. A
batch of documents is one byte buffer plus offsets, and words, word hashes and
shingle hashes of all its documents come from a handful of numpy passes, so no
per-word Python code runs. Work is cut into blocks of a few MB (whole documents
only), which bounds the scratch memory; a longer document is a block alone.

Hashes depend on nothing but the bytes, so any two tasks, runs and machines
agree. There are two kinds:

* ``span_hashes`` (words): eight bytes at a time through an invertible mixer, so
  words of up to eight bytes are told apart by construction; spans of more than
  ``LONG`` bytes are hashed by xxh3. ``same_spans`` compares bytes where a result
  depends on identity.
* ``prefix_sums`` and ``span_sums`` (any span of a long line): polynomials modulo
  two 31-bit primes. Modulo a power of two, such polynomials give
  some strings and their complements equal values whatever the base (the
  Thue-Morse word); modulo a prime they don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (an invertible avalanche)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``most`` bytes of ``column`` each, with its bytes and offsets."""
    buf, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at), buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of maximal runs of non-space bytes; first[d]:first[d+1] are document d's words."""
    inside = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    before, after = np.zeros(len(buf), dtype=bool), np.zeros(len(buf), dtype=bool)
    if len(buf):
        before[1:], after[:-1] = inside[:-1], inside[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
_ODD, _SIZE = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)


def chunks(line: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``line`` but the last eight as one value."""
    return np.ndarray(max(len(line) - 7, 0), dtype="<u8", buffer=line.data, strides=(1,))


def folded(buf: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """``buf`` through ``fold``, with eight more bytes behind it."""
    line = np.zeros(len(buf) + 8, dtype=np.uint8)
    np.take(fold, buf, out=line[: len(buf)])
    return line


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hash of each buf[start:end], bytes taken through ``fold``."""
    return line_hashes(folded(buf, fold), start, end)


def line_hashes(line: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``span_hashes`` of a folded line."""
    eight, size = chunks(line), end - start
    out = mix64((eight[start] & _KEEP[np.minimum(size, 8)]) * _ODD + size.astype(_U) * _SIZE)
    todo, at = np.flatnonzero(size > 8), 8
    while len(todo) and at < LONG:
        chunk = eight[start[todo] + at] & _KEEP[np.minimum(size[todo] - at, 8)]
        out[todo] = mix64((out[todo] ^ chunk) * _ODD + _SIZE)
        at += 8
        todo = todo[size[todo] > at]
    for i in todo.tolist():
        out[i] = xxhash.xxh3_64_intdigest(line[start[i] : end[i]])
    return out


def same_spans(line: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether line[start:start + size] has the bytes of other[place:place + size]; both lines have eight more bytes behind their spans."""
    eight, eight2 = chunks(line), chunks(other)
    same = np.ones(len(size), dtype=bool)
    todo, at = np.flatnonzero(size > 0), 0
    while len(todo) and at < LONG:
        equal = (eight[start[todo] + at] ^ eight2[place[todo] + at]) & _KEEP[np.minimum(size[todo] - at, 8)] == 0
        same[todo[~equal]] = False
        at += 8
        todo = todo[equal]
        todo = todo[size[todo] > at]
    for i in todo.tolist():
        same[i] = line[start[i] : start[i] + size[i]].tobytes() == other[place[i] : place[i] + size[i]].tobytes()
    return same


_STEP = stream64(64, 23) | _U(1)


def shingle_hashes(word: np.ndarray, first: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of each document's k-word shingles in order; a shorter document has its whole sequence as one."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_first = np.zeros(len(first), dtype=np.int64)
    np.cumsum(many, out=out_first[1:])
    full = max(len(word) - k + 1, 0)
    rolled = np.full(full, _U(k), dtype=_U)
    for j in range(k):
        rolled += word[j : j + full] * _STEP[j]
    rolled = mix64(rolled)
    at = np.arange(out_first[-1], dtype=np.int64) + np.repeat(first[:-1] - out_first[:-1], many)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return rolled[at], out_first
    out = rolled[np.minimum(at, max(full - 1, 0))] if full else np.zeros(len(at), dtype=_U)
    for d in short.tolist():
        w = word[first[d] : first[d + 1]]
        out[out_first[d]] = mix64(np.array([int((w * _STEP[: len(w)]).sum()) + len(w) & (1 << 64) - 1], dtype=_U))[0]
    return out, out_first


def document_shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased k-word shingle hashes of every document of a block."""
    start, end, first = words(buf, offs)
    return shingle_hashes(span_hashes(buf, start, end), first, k)


def least(values: np.ndarray, first: np.ndarray, empty: int = (1 << 64) - 1) -> np.ndarray:
    """Minimum of values[first[d]:first[d+1]] for each d."""
    out = np.full(len(first) - 1, _U(empty), dtype=_U)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, first[:-1][full])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start+length)."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def encode_spans_as_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of Python strings."""
    return column_bytes(pa.array(texts, type=pa.large_string()))


_PRIMES = (_U(2147483647), _U(2147483629))
_WIDE = [stream64(1 << 10, 13) % p for p in _PRIMES]
_BASES = (1103515245, 1220703125)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, n at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS.clear()
        many = 1 << max(n - 1, 1).bit_length()
        for base, p in zip(_BASES, _PRIMES, strict=True):
            both = []
            for b in (base, pow(base, -1, int(p))):
                out = np.ones(many, dtype=_U)
                done, step = 1, b
                while done < many:  # the powers so far, moved on by as many
                    out[done : 2 * done] = out[:done] * _U(step) % p
                    done, step = 2 * done, step * step % int(p)
                both.append(out)
            _POWERS.append((both[0], both[1]))
    return _POWERS


def prefix_sums(values: np.ndarray) -> list[np.ndarray]:
    """Polynomial prefix sums of small integers modulo each prime, for ``span_sums``."""
    out = []
    for (up, _), wide, p in zip(_powers(len(values) + 1), _WIDE, _PRIMES, strict=True):
        sums = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(wide[values] * up[: len(values)] % p, out=sums[1:])
        out.append(sums % p)
    return out


def span_sums(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end] from their prefix sums."""
    one, two = ((s[end] + p - s[start]) * down[start] % p for s, (_, down), p in zip(sums, _powers(len(sums[0])), _PRIMES, strict=True))
    return mix64(one << _U(32) | two)


def span_hashes_of(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_sums(prefix_sums(values), start, end)


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` successive bytes, for choosing places only (a sum of multiples of eight-byte values)."""
    n = max(len(buf) - width + 1, 0)
    eight = chunks(folded(buf, IDENTITY))
    out = np.zeros(n, dtype=_U)
    for i, at in enumerate([*range(0, width - 7, 8), *([max(width - 8, 0)] if width % 8 else [])]):
        part = eight[at : at + n]
        out += (part if width >= 8 else part & _KEEP[width]) * _STEP[i % 64]
    return mix64(out)
