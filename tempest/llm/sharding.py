"""Longest-processing-time sharding of groups that must stay together.

Groups (equal texts) are scheduled largest first, each to the least-loaded shard of a heap.
The schedule is bounded whatever the input: a group of at least 1/(shards * resolution) of
all bytes is an item of its own (there are at most shards * resolution of them), and all
smaller groups fall by the hash of their text into as many bundles, each scheduled as one
item. Shards then differ by about one bundle, a ten-thousandth of the bytes. A group larger
than a fair share keeps its shard to itself.

Defined results: a null text counts as empty and has size 1; a null id is an ordinary row
(slots count it); repeated rows each get a slot of the same shard, and however many rows
share an id or are equal, no task holds them all; an empty table gives an
empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.common import text_or_empty, write_table

#: scheduled items per shard and kind; spread of the shards is about 1 / RESOLUTION
RESOLUTION = 1024
#: ordered pieces per shard in which slots are counted
SLOT_BUCKETS = 4096
#: slots of equal rows that one task numbers at once
RUN = 65_536


def least_loaded(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Largest item first, ties by name, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        placed[name] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, resolution: int = RESOLUTION) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless per shard)."""
    spark = docs.sparkSession
    text = text_or_empty().cast("binary")
    rows = write_table(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = -(-total // (shards * resolution))
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("g"), F.lit(shards * resolution)).cast("string"))
    groups = write_table(rows.groupBy("g").agg(F.sum("size").alias("size"))
                         .withColumn("own", F.col("size") >= F.lit(large)), "shard-groups")
    items = (groups.groupBy(F.when(F.col("own"), F.col("g")).otherwise(bundle).alias("item"))
             .agg(F.sum("size").alias("size")))
    # at most 2 * shards * resolution rows, whatever the input
    placed = least_loaded([(r["item"], r["size"]) for r in items.collect()], shards)
    plan = spark.createDataFrame(sorted(placed.items()), "item string, shard int")
    own = groups.filter("own").select("g", F.lit(True).alias("own"))
    named = (rows.join(F.broadcast(own), "g", "left")
             .withColumn("item", F.when(F.col("own"), F.col("g")).otherwise(bundle))
             .join(F.broadcast(plan), "item")
             .select("doc_id", "size", "text_crc32", "shard",
                     F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLOT_BUCKETS)).alias("piece")))
    # slots: equal rows are counted first, counts are summed within (shard, piece) and pieces
    # shifted by those before them; the table of shifts has at most shards * SLOT_BUCKETS rows
    alike = write_table(named.groupBy("doc_id", "size", "text_crc32", "shard", "piece").agg(F.count(F.lit(1)).alias("n")), "shard-alike")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = alike.groupBy("shard", "piece").agg(F.sum("n").alias("n")).select(
        "shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed_rows = (alike.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
                   .join(F.broadcast(shift), ["shard", "piece"])
                   .withColumn("first", F.col("first") + F.col("shift")))
    return numbered(placed_rows)


def numbered(rows: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each of the ``n`` slots from ``first`` on; long runs of equal rows are cut into
    pieces of ``run`` slots that other tasks number."""
    keys = ["doc_id", "size", "text_crc32", "shard"]
    short = rows.filter(F.col("n") <= run).select(*keys, "first", "n")
    long_ = rows.filter(F.col("n") > run).select(*keys, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(run).cast("long"))).alias("first"),
                                                 (F.col("first") + F.col("n")).alias("end"))
    long_ = long_.select(*keys, "first", F.least(F.lit(run).cast("long"), F.col("end") - F.col("first")).alias("n")).repartition("first")
    slot = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot")
    return short.unionByName(long_).select(*keys, slot)
