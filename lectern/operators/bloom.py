"""Bloom filters of keys as tables of words: built by aggregation, merged by union, applied inside a scan.

``words`` holds the bits that are set, 64 a row; two filters of one size merge by
the union of their rows. ``contains`` turns one into a condition of built-in
functions, so that it filters where rows are read, before anything is shuffled.
It never denies a key that was added; what it lets through besides is settled by
an exact join. The size follows the number of keys up to ``MOST_BITS``: beyond
about three million keys it lets more through, and stays right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, PROBES = 10, 4
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 25  # a filter is 4 MB at most


def size(keys: int) -> int:
    """Bits for so many keys, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (keys * BITS_A_KEY).bit_length()))


def _places(bits: int, *key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), *key).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def words(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """(at, word): the 64-bit words of the filter that aren't zero; set bits are combined before the shuffle."""
    place = F.explode(F.array(*_places(bits, *[F.col(c) for c in columns]))).alias("place")
    return keys.select(place).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("word"))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters of one size."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("at").agg(F.bit_or("word").alias("word"))


def contains(found: DataFrame, bits: int) -> Callable[..., Column]:
    """A condition of key columns: false only for keys that were never added. The words, ``MOST_BITS`` / 64 at most, become a constant of the plan."""
    held = [0] * (bits // 64)
    for r in found.collect():
        held[r["at"]] = r.word
    line = F.from_json(F.lit(f"[{','.join(map(str, held))}]"), "array<bigint>")

    def condition(*key: Column) -> Column:
        out = F.lit(True)
        for place in _places(bits, *key):
            out = out & (F.get(line, F.shiftright(place, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))) != 0)
        return out

    return condition
