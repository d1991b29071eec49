"""Balanced objects of texts, found for a whole Arrow column at once.

Whether a brace counts depends on the number of quotes since the object opened,
so braces fall into two classes, by the parity of the quotes before them. Inside
a class every brace changes a level by one, and an opening brace belongs to the
next closing one of its level. Two sorts answer this for all texts of a batch;
no text is scanned by itself. A quote behind an odd number of backslashes is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_and_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def balanced_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every balanced object, in order of start; positions are bytes of the batch."""
    quotes = np.flatnonzero(buf == 34)
    plain = np.maximum.accumulate(np.where(buf != 92, np.arange(len(buf)), -1)) if len(buf) else np.zeros(0, np.int64)
    before = np.where(quotes > 0, quotes - 1 - plain[np.maximum(quotes - 1, 0)], 0)
    quotes = quotes[before % 2 == 0]
    at = np.flatnonzero((buf == 123) | (buf == 125))
    opens = buf[at] == 123
    text = np.searchsorted(offs, at, side="right") - 1
    parity = (np.searchsorted(quotes, at) - np.searchsorted(quotes, offs[text])) % 2
    order = np.lexsort((at, parity, text))
    at, opens, text, parity = at[order], opens[order], text[order], parity[order]
    level = np.cumsum(np.where(opens, 1, -1)) + ~opens  # the level that a brace opens or closes
    order = np.lexsort((at, level, parity, text))
    after = order[1:]
    now = order[:-1]
    pair = opens[now] & ~opens[after] & (level[now] == level[after]) & (parity[now] == parity[after]) & (text[now] == text[after])
    start, end, owner = at[now[pair]], at[after[pair]] + 1, text[now[pair]]
    order = np.argsort(start, kind="stable")
    return owner[order], start[order], end[order]


def whole(col: pa.Array) -> np.ndarray:
    """Whether each text is one balanced object from its first byte to its last."""
    buf, offs = bytes_and_offsets(col)
    owner, start, end = balanced_spans(buf, offs)
    out = np.zeros(len(offs) - 1, dtype=bool)
    out[owner[(start == offs[owner]) & (end == offs[owner + 1])]] = True
    return out


def balanced_objects(col: pa.Array) -> pa.ListArray:
    """List of (position, object) of each text; the position is its byte in the text."""
    buf, offs = bytes_and_offsets(col)
    owner, start, end = balanced_spans(buf, offs)
    raw = memoryview(np.ascontiguousarray(buf))
    found = pa.StructArray.from_arrays([pa.array((start - offs[owner]).astype(np.int32)), pa.array([str(raw[a:b], "utf-8") for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.string())], ["position", "object"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(offs))).astype(np.int32)), found)
