"""Fields taken out of VARIANT values at any depth, and the paths where they were.

Records of unequal nesting have no schema to walk, so the binary values are
rewritten themselves, in Arrow batches: an object is rebuilt from the fields that
stay, its other values keep their bytes and thereby their types. A record whose
dictionary of names has none of the wanted ones is passed on as it is.

Defined cases: null stays null; a name inside a text is text; an object left
without fields is an empty object; paths are ``$.name`` and ``[index]``, in order
of the names; what lies inside a removed field is not looked into.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, VariantType

# Fixed values of the VARIANT encoding: basic types, bytes of primitives by their number (with the header).
PRIMITIVE, SHORT_TEXT, OBJECT, ARRAY = range(4)
WIDTH = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 5, 6: 9, 7: 9, 8: 6, 9: 10, 10: 18, 11: 5, 12: 9, 13: 9, 14: 5, 17: 9, 18: 9, 19: 9, 20: 17}
WITH_LENGTH = (15, 16)  # binary and text: four bytes of length
NULL = b"\0"


def names(metadata: bytes) -> list[str]:
    """The dictionary of a value's names."""
    width = (metadata[0] >> 6) + 1
    at = lambda i: int.from_bytes(metadata[1 + i * width : 1 + (i + 1) * width], "little")
    n = at(0)
    begin = 1 + (n + 2) * width
    return [metadata[begin + at(1 + i) : begin + at(2 + i)].decode() for i in range(n)]


def _parts(value: bytes, at: int) -> tuple[list[int], list[int], int, int]:
    """(name numbers, offsets, begin of the data, end) of an object or array."""
    info, is_object = value[at] >> 2, value[at] & 3 == OBJECT
    width, id_width, large = (info & 3) + 1, ((info >> 2) & 3) + 1 if is_object else 0, info >> (4 if is_object else 2) & 1
    number = lambda i, size: int.from_bytes(value[i : i + size], "little")
    n, at = number(at + 1, 4 if large else 1), at + (5 if large else 2)
    ids = [number(at + i * id_width, id_width) for i in range(n)] if is_object else []
    at += n * id_width
    offsets = [number(at + i * width, width) for i in range(n + 1)]
    data = at + (n + 1) * width
    return ids, offsets, data, data + offsets[n]


def _end(value: bytes, at: int) -> int:
    kind, info = value[at] & 3, value[at] >> 2
    if kind == SHORT_TEXT:
        return at + 1 + info
    if kind != PRIMITIVE:
        return _parts(value, at)[3]
    return at + (5 + int.from_bytes(value[at + 1 : at + 5], "little") if info in WITH_LENGTH else WIDTH[info])


def _packed(children: list[bytes], ids: list[int] | None) -> bytes:
    """An object (with name numbers) or array of the children."""
    n, total = len(children), sum(map(len, children))
    width = max(1, (total.bit_length() + 7) // 8)
    id_width = max(1, (max(ids, default=0).bit_length() + 7) // 8) if ids is not None else 0
    large = n > 255
    info = (width - 1) | ((id_width - 1) << 2 | large << 4 if ids is not None else large << 2)
    out = [bytes([info << 2 | (ARRAY if ids is None else OBJECT)]), n.to_bytes(4 if large else 1, "little")]
    out += [i.to_bytes(id_width, "little") for i in ids or []]
    at = 0
    for c in (*children, b""):
        out.append(at.to_bytes(width, "little"))
        at += len(c)
    return b"".join([*out, *children])


def rewritten(value: bytes, known: list[str], gone: Collection[str], drop_nulls: bool = False, at: int = 0, path: str = "$") -> tuple[bytes, list[str]]:
    """(value without the fields named in ``gone`` and, if asked, without null ones, paths of the former)."""
    kind = value[at] & 3
    if kind not in (OBJECT, ARRAY):
        return value[at : _end(value, at)], []
    ids, offsets, data, _ = _parts(value, at)
    children, left, found = [], [], []
    for i, offset in enumerate(offsets[:-1]):
        name = known[ids[i]] if kind == OBJECT else None
        here = f"{path}.{name}" if kind == OBJECT else f"{path}[{i}]"
        if name in gone:
            found.append(here)
            continue
        child, more = rewritten(value, known, gone, drop_nulls, data + offset, here)
        found += more
        if kind == ARRAY or not (drop_nulls and child == NULL):
            children.append(child)
            left.append(ids[i] if kind == OBJECT else 0)
    return _packed(children, left if kind == OBJECT else None), found


def _rows(v: pa.Array) -> Iterator[tuple[bytes, bytes, list[str]] | None]:
    dictionaries: dict[bytes, list[str]] = {}
    values, metadata = v.flatten()
    for ok, value, m in zip(v.is_valid().to_pylist(), values.to_pylist(), metadata.to_pylist(), strict=True):
        if ok and m not in dictionaries:
            dictionaries[m] = names(m)
        yield (value, m, dictionaries[m]) if ok else None


def without_fields(c: Column, gone: Collection[str], drop_nulls: bool = False) -> Column:
    """The VARIANT without the named fields, wherever they are, and without null fields if asked."""
    gone = frozenset(gone)

    @F.arrow_udf(VariantType())
    def strip(v: pa.Array) -> pa.Array:
        out = [(rewritten(r[0], r[2], gone, drop_nulls)[0] if drop_nulls or not gone.isdisjoint(r[2]) else r[0], r[1]) if r else (NULL, b"\x01\0\0") for r in _rows(v)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], fields=list(v.type), mask=v.is_null())

    return strip(c)


def field_paths(c: Column, wanted: Collection[str]) -> Column:
    """Array of the paths of the named fields in a VARIANT."""
    wanted = frozenset(wanted)

    @F.arrow_udf(ArrayType(StringType()))
    def paths(v: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [] if wanted.isdisjoint(r[2]) else rewritten(r[0], r[2], wanted)[1] for r in _rows(v)], pa.list_(pa.string()))

    return paths(c)


def asserted(c: Column, wanted: Collection[str], message: str = "forbidden input field at ") -> Column:
    """The VARIANT as it is; a row that has one of the named fields is an error that says where."""
    hits: Callable[[Column], Column] = lambda x: field_paths(x, wanted)
    return F.when(F.size(hits(c)) > 0, F.raise_error(F.concat(F.lit(message), F.array_join(hits(c), ", ")))).otherwise(c)
