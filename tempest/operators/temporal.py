"""Joins on time: the last observation at or before a moment, and days inside intervals.

Neither needs a sorted single stream of a key. The as-of join cuts each key's time into
periods: inside one, both sides are merged in one window; the last observation before a
period is carried over from one row per (key, period). The interval join gives every
interval the bins it touches and meets the points by equality of key and bin, so no side is
compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, key="city", time="time", right_time: str | None = None, tolerance: int | None = None,
              period: int = 30 * 86400, suffix: str = "_asof") -> DataFrame:
    """Every left row with the columns of the last right row of its key at or before its time,
    named with ``suffix`` (among right rows of one time the largest); null where there is
    none, or none within ``tolerance`` seconds. ``period`` (seconds) bounds what one window
    holds. A null key or time finds nothing."""
    right_time = right_time or time
    kept = [c for c in right.columns if c != key]
    row = F.struct(_micros(right_time).alias("_at"), *[F.col(c).alias(f"{c}{suffix}") for c in kept])
    seen = (right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
            .select(F.col(key).alias("_key"), row.alias("_row"), _micros(right_time).alias("_at")))
    asked = left.select(F.struct(*left.columns).alias("_left"), F.col(key).alias("_key"), _micros(time).alias("_at"))
    part = F.floor(F.col("_at") / (period * 1_000_000)).cast("long").alias("_period")
    a = seen.select("_key", "_at", part, F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_left"].dataType).alias("_left"), "_row")
    b = asked.select("_key", "_at", part, F.lit(1).alias("_side"), "_left", F.lit(None).cast(seen.schema["_row"].dataType).alias("_row"))
    inside = Window.partitionBy("_key", "_period").orderBy("_at", "_side", "_row").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("_last", F.last("_row", ignorenulls=True).over(inside)).filter("_side = 1")
    # one row per key and period, of either side
    ends = (a.groupBy("_key", "_period").agg(F.max("_row").alias("_end"))
            .unionByName(b.select("_key", "_period").distinct().withColumn("_end", F.lit(None).cast(seen.schema["_row"].dataType)))
            .groupBy("_key", "_period").agg(F.max("_end").alias("_end")))
    before = Window.partitionBy("_key").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_period", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = merged.join(carried, ["_key", "_period"], "left").withColumn("_found", F.coalesce("_last", "_carried"))
    if tolerance is not None:
        found = found.withColumn("_found", F.when(F.col("_at") - F.col("_found._at") <= tolerance * 1_000_000, F.col("_found")))
    return found.select("_left.*", *[F.col("_found").getField(f"{c}{suffix}").alias(f"{c}{suffix}") for c in kept])


def interval_join(points: DataFrame, intervals: DataFrame, key="city", time="time", start="start", end="end", days: int = 16) -> DataFrame:
    """Every point with every interval of its key that holds it (both ends included), the
    interval's other columns added; points in none are left out. Intervals are cut into bins
    of ``days`` days, so a point meets only those near it; an interval whose end precedes its
    start, or with a null end, holds nothing."""
    bins = lambda c: F.floor(F.unix_date(F.to_date(c)) / days).cast("long")
    others = [c for c in intervals.columns if c not in (key, start, end)]
    cut = (intervals.filter(F.col(start) <= F.col(end))
           .select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), *others,
                   F.explode(F.sequence(bins(start), bins(end))).alias("_bin")))
    met = points.withColumn("_pbin", bins(time)).join(cut, (F.col(key) == F.col("_key")) & (F.col("_pbin") == F.col("_bin")))
    inside = met.filter((F.col(time) >= F.col("_start")) & (F.col(time) <= F.col("_end")))
    return inside.select(*points.columns, F.col("_start").alias(start), F.col("_end").alias(end), *others)
