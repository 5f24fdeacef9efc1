"""Helpers shared by the operators: scratch tables, fixed text rules, salting."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest.session import checkpoint_dir

# fixed values: the white space of every text rule, \x20 and \x09 to \x0D
WHITE = " \t\n\x0b\x0c\r"

#: pieces into which rows of one key are spread when they meet a one-row-per-key table
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tempest-llm/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared checkpoint folder, computed once and
    read back. It outlives lost executors, unlike a cache or a local checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(docs: DataFrame, *kept: str) -> DataFrame:
    """The documents with every column but ``kept`` named by its place (``_0``, ``_1``, ...), so
    no column an operator adds can clash; ``toDF(*docs.columns)`` turns the names back."""
    return docs.toDF(*[c if c in kept else f"_{i}" for i, c in enumerate(docs.columns)])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without_white(c: Column) -> Column:
    """Delete every white-space character (byte-wise replaces, the commonest first)."""
    for ch in WHITE:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def salt(by: Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")


def all_salts(df: DataFrame, name: str, n: int = SALTS) -> DataFrame:
    """Every row once per salt: the small side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def unit_numbers(rows: pa.Table, keys: int) -> np.ndarray:
    """Running number of the unit of each row; units are runs of equal first ``keys`` columns."""
    change = np.zeros(len(rows), np.int64)
    for i in range(keys):
        k = rows.column(i).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def whole_units(batches, keys: int, rows: int):
    """Regroup sorted Arrow batches into tables of whole units, of ``rows`` rows or one unit
    at least: yields (table, unit number of each row)."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        unit = unit_numbers(table, keys)
        cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
        if cut:
            yield table.slice(0, cut), unit[:cut]
        held = table.slice(cut).to_batches()
    if held and sum(map(len, held)):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, unit_numbers(table, keys)
