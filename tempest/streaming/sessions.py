"""Sessions of a keyed stream with late rows: hot runs and spells of reporting.

A session holds the events of a key that follow one another by less than the gap (at the gap exactly Spark joins them; choose one
that no two rows meet). State is one
row per open session, whatever its length. A session leaves once the watermark (the latest
event time seen less ``delay``) has reached its end, so rows that come late by up to ``delay``
still extend, join or start sessions; a later row is dropped, as every watermarked sum does.
Events of null time or key belong to no session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: two daily rows belong together when no day lies between them
DAY_GAP = "36 hours"


def event_sessions(events: DataFrame, ts: str, gap: str, delay: str, key: str = "city",
                   flag: Column | None = None, **measures: Column) -> DataFrame:
    """(key, first, last, events, measures...) of the sessions of the rows where ``flag`` holds.
    The watermark follows all rows, also those without the flag. Works on a batch as well."""
    rows = events.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, delay)
    # rows without the flag get an empty window, which Spark leaves out; a filter would move below
    # the watermark, which then would stand still while no row has the flag
    length = gap if flag is None else F.when(F.coalesce(flag, F.lit(False)), F.lit(gap)).otherwise(F.lit("0 seconds"))
    return (rows.groupBy(key, F.session_window(ts, length).alias("_session"))
            .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"),
                 *[c.alias(name) for name, c in measures.items()]).drop("_session"))


def hot_runs(daily: DataFrame, delay: str, hot: float = 35.0, tmax: str = "temperature_2m_max") -> DataFrame:
    """Runs of days hotter than ``hot`` per city: run_start, run_end, run_length, peak."""
    days = daily.select("city", F.col("time").cast("timestamp").alias("ts"), tmax)
    runs = event_sessions(days, "ts", DAY_GAP, delay, flag=F.col(tmax) > hot, peak=F.max(tmax))
    return runs.select("city", F.to_date("first").alias("run_start"), F.to_date("last").alias("run_end"),
                       F.col("events").alias("run_length"), "peak")


def sessions_available(spark: SparkSession, source: str, schema, build, sink: str, checkpoint: str,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Take up the files that are new under ``source``, append the sessions that have closed to
    ``sink`` and return all of them. ``build`` maps the rows to their sessions."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = build(reader.parquet(source))
    q = (out.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
