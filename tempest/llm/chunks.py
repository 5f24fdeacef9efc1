"""Chunks: many documents as one integer stream with a dictionary of its own.

A chunk row holds each distinct key once, so a key of any frequency meets a corpus-wide
table once per chunk instead of once per occurrence, and no corpus-wide table has to be
broadcast. ``entries`` lists the dictionaries as rows, ``with_found`` brings what a join
found for them back to their chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(chunks: DataFrame, key: str, *more: str) -> DataFrame:
    """(chunk, at, key, n, *more): one row per dictionary entry; ``at`` is its place."""
    zipped = F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("n"))
    return chunks.select("chunk", *more, F.posexplode(zipped).alias("at", "e")).select(
        "chunk", "at", F.col("e.key").alias(key), F.col("e.n").alias("n"), *more)


def with_found(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """``chunks`` with a column ``found`` of the rows' other columns, in no order; a chunk's
    rows are as many as its dictionary has entries, which its size bounds."""
    values = [c for c in rows.columns if c != "chunk"]
    found = rows.groupBy("chunk").agg(F.collect_list(F.struct(*values)).alias("found"))
    return chunks.join(found, "chunk", "left")


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes in four planes: the frequent small numbers leave
    the upper planes nearly empty."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def by_frequency(stream: np.ndarray, size: int, fixed: int = 0):
    """(renumbered stream, order, counts): keys numbered by falling count, the first ``fixed``
    left in place; ``order`` holds the former number of each new one."""
    counts = np.bincount(stream, minlength=size)
    order = np.r_[np.arange(fixed), fixed + np.argsort(-counts[fixed:], kind="stable")].astype(np.int64)
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return place[stream], order, counts[order]
