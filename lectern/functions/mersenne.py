"""Jumping ahead in the Mersenne Twister's stream (MT19937).

The sequence of untempered words obeys a linear recurrence over GF(2), so the
window of words that lies n words on is a sum of windows near the beginning, by
the coefficients of x**n modulo the recurrence's characteristic polynomial. That
polynomial is found from the generator's own bits (Berlekamp-Massey), n's binary
digits give the power by squaring, and both cost the same wherever the jump goes.

Polynomials are Python integers, a bit a coefficient.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Fixed values of the generator: words of state, its degree, the offset of the recurrence and its matrix.
WORDS, DEGREE, OFFSET, MATRIX = 624, 19937, 397, 0x9908B0DF
HIGH, LOW = np.uint32(0x80000000), np.uint32(0x7FFFFFFF)


def sequence(state: np.ndarray, n: int) -> np.ndarray:
    """The window ``state`` and the n untempered words behind it."""
    x = np.concatenate([state.astype(np.uint32), np.zeros(n, np.uint32)])
    at = WORDS
    while at < len(x):
        k = min(WORDS - OFFSET, len(x) - at)
        mixed = (x[at - WORDS : at - WORDS + k] & HIGH) | (x[at - WORDS + 1 : at - WORDS + 1 + k] & LOW)
        x[at : at + k] = x[at - WORDS + OFFSET : at - WORDS + OFFSET + k] ^ (mixed >> np.uint32(1)) ^ np.where(mixed & np.uint32(1), np.uint32(MATRIX), np.uint32(0))
        at += k
    return x


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The characteristic polynomial: the shortest recurrence of one bit of 2 * DEGREE successive words."""
    bits = sequence(np.array(random.Random(1).getstate()[1][:-1], dtype=np.uint32), 2 * DEGREE + 64)[WORDS:] & np.uint32(1)
    recurrence, before, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits[: 2 * DEGREE].tolist()):
        seen = (seen << 1) | bit  # the latest bit lowest, as the recurrence's first coefficient
        if (recurrence & seen).bit_count() & 1:
            changed = recurrence ^ (before << since)
            if 2 * length <= n:
                length, before, since = n + 1 - length, recurrence, 0
            recurrence = changed
        since += 1
    if length != DEGREE:
        raise ArithmeticError(f"recurrence of length {length}")
    return int(format(recurrence, f"0{DEGREE + 1}b")[::-1], 2)  # reversed: highest power first


def power(n: int) -> int:
    """x**n modulo the characteristic polynomial."""
    modulus = characteristic()
    terms = [i for i in range(DEGREE) if modulus >> i & 1]
    gap, mask = DEGREE - terms[-1], (1 << DEGREE) - 1
    out = 1
    for digit in format(n, "b"):
        out = int(format(out, "b"), 4)  # squared: a zero between coefficients
        if digit == "1":
            out <<= 1
        while out.bit_length() > DEGREE:  # the highest ``gap`` coefficients at a time
            shift = max(out.bit_length() - gap, DEGREE)
            high = out >> shift
            out &= (1 << shift) - 1
            for t in terms:
                out ^= high << (shift - DEGREE + t)
    return out & mask


def jump(state: np.ndarray, n: int) -> np.ndarray:
    """The window that lies n words behind ``state``."""
    if n < 4 * DEGREE:
        return sequence(state, n)[n:]
    bits = np.array([c == "1" for c in reversed(format(power(n), "b"))])
    windows = np.lib.stride_tricks.sliding_window_view(sequence(state, len(bits)), WORDS)
    out = np.zeros(WORDS, np.uint32)
    for at in range(0, len(bits), 4096):
        out ^= np.bitwise_xor.reduce(windows[at : at + 4096][: len(bits) - at][bits[at : at + 4096]], axis=0, initial=np.uint32(0))
    return out


class Stream:
    """Python's ``random.Random(seed)``: its numbers from any place on."""

    def __init__(self, seed: int):
        self.first = np.array(random.Random(seed).getstate()[1][:-1], dtype=np.uint32)
        self.own, self.at = np.random.RandomState(), -1

    def draw(self, start: int, n: int) -> np.ndarray:
        """Numbers start to start + n of the stream; goes on where the last draw ended, jumps elsewhere."""
        if start != self.at:
            self.own.set_state(("MT19937", jump(self.first, 2 * start), WORDS))  # two words a number
        self.at = start + n
        return self.own.random_sample(n)
