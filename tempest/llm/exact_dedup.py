"""Exact deduplication with DataFrame functions only.

Documents are grouped by the 128-bit hash of their text without white space, and inside a
hash group by the bytes themselves: the grouping key is (hash, text), the hash decides the
partition and nearly every comparison, and texts that merely collide fall into different
classes. Copies are combined before the shuffle, so a class of any size sends one row per
map task. Of a class the row with the most code points stays, then the smallest id.

Defined results: a null text counts as empty; a null id ranks after all others; rows that
share id and text stand or fall together and each counts in the group size; an empty table
gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempest.llm.common import all_salts, renamed, salt, text_or_empty, without_white, write_table


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def text_classes(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct text of two or more rows: hash, text_sha256, group_size, keep_id."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", without_white(F.col("text")).alias("norm"),
                       F.char_length("text").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id"))
    return (rows.groupBy(hashed(F.col("norm")).alias("hash"), "norm")
            .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
            .filter("group_size > 1")
            .select("hash", F.sha2("norm", 256).alias("text_sha256"), "group_size",
                    F.col("best.doc_id").alias("keep_id")))


def exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    classes = write_table(text_classes(docs, hashed), "exact-classes")
    norm = without_white(text_or_empty())
    rows = docs.select("doc_id", F.sha2(norm, 256).alias("text_sha256"), hashed(norm).alias("hash"))
    # membership: a class may hold a third of all rows, so both sides carry a salt
    joined = (rows.withColumn("salt", salt(F.col("doc_id")))
              .join(all_salts(classes, "salt"), ["hash", "text_sha256", "salt"], "left"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Exactly one row of each class, columns unchanged: the representative, of several rows
    with its id and length the first. Rows are known by their number in a written table, as
    ids may be null or repeated."""
    own = renamed(docs, "doc_id", "text")
    norm = without_white(text_or_empty())
    rows = write_table(own.withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    keyed = rows.select(norm.alias("norm"), F.struct((-F.char_length(text_or_empty())).alias("n"), F.col("doc_id").isNull().alias("last"),
                                                     "doc_id", "row").alias("rank"))
    classes = (keyed.groupBy(hashed(F.col("norm")).alias("hash"), "norm").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
               .filter("n > 1").select("hash", F.sha2("norm", 256).alias("sha"), F.col("best.row").alias("stays")))
    classes = write_table(classes, "exact-classes")
    # a class may hold a third of all rows, so both sides carry a salt
    gone = (rows.select("row", hashed(norm).alias("hash"), F.sha2(norm, 256).alias("sha")).withColumn("salt", salt(F.col("row")))
            .join(all_salts(classes, "salt"), ["hash", "sha", "salt"]).filter("row != stays").select("row"))
    return rows.join(gone, "row", "left_anti").select(*own.columns).toDF(*docs.columns)
