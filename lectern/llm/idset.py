"""Rows whose id is in a table of ids, without shuffling the texts of all others.

A bitmap of fixed size (4 MB) of hashed ids is built in the cluster and sent to
the tasks; rows that it lacks are dropped where they are read, and a join
settles the rest exactly. With far more ids than bits it keeps every row and
the join does all the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def place(id_col: str = "doc_id") -> Column:
    """An id's bit."""
    return F.pmod(F.xxhash64(id_col), F.lit(BITS))


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bytes with the bits of ``ids`` (doc_id) set; at most BITS / 64 words reach the driver."""
    words = ids.select(place().alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def texts_of(docs: DataFrame, ids: DataFrame, through: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, schema: str = "doc_id long, text string") -> DataFrame:
    """(doc_id, text) of the documents with the given distinct ids, or what ``through`` makes of batches of them (a column doc_id included)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(passes(shared.value, batch.column(2).to_numpy()))).select([0, 1])
            yield from through(found) if through else [found]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.select("doc_id", "text", place().alias("at")).mapInArrow(run, schema).join(ids.hint("merge"), "doc_id", "left_semi")
