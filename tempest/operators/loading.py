"""Loading-side operators: city dimension, increments, reports."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_START = _dt.date(2020, 1, 1)


def city_dim(panel: DataFrame, key="city", order="time") -> DataFrame:
    """First (latitude, longitude) of each city by date (deterministic drop_duplicates)."""
    first = F.min_by(F.struct("latitude", "longitude"), F.col(order))
    return panel.groupBy(key).agg(first.alias("_c")).select(
        key, F.col("_c.latitude").alias("latitude"), F.col("_c.longitude").alias("longitude"))


def explode_districts(cities: DataFrame, col: str = "districts") -> DataFrame:
    """One row per (city, district); a city without districts keeps one row with null."""
    return cities.select(*[c for c in cities.columns if c != col],
                         F.explode_outer(col).alias("district"))


def select_increment(batch: DataFrame, latest: DataFrame, end=None,
                     default_start: _dt.date = DEFAULT_START, key="city",
                     order="time") -> DataFrame:
    """Rows newer than each city's last loaded date and not after ``end``; a city never
    seen starts at ``default_start``; up-to-date cities contribute nothing.

    ``latest`` has one row per city; Catalyst/AQE broadcast it when its measured size is
    under the threshold, otherwise the join shuffles both sides on ``city``."""
    start = F.coalesce(F.col("last_date"), F.date_sub(F.lit(default_start), 1))
    j = batch.join(latest.select(key, "last_date"), key, "left")
    cond = F.col(order) > start
    if end is not None:
        cond = cond & (F.col(order) <= F.lit(end))
    return j.filter(cond).drop("last_date")


def force_start(batch: DataFrame, start: _dt.date, end=None, order="time") -> DataFrame:
    """Treat every city as last loaded the day before ``start``."""
    cond = F.col(order) >= F.lit(start)
    if end is not None:
        cond = cond & (F.col(order) <= F.lit(end))
    return batch.filter(cond)


def filter_cities(df: DataFrame, names, key="city") -> DataFrame:
    """Case-insensitive city filter; ``None`` or empty keeps every city, and so does a list
    of which no name is known (the load rule; one probing job)."""
    if not names:
        return df
    chosen = df.filter(F.lower(F.col(key)).isin([n.lower() for n in names]))
    return chosen if chosen.limit(1).count() else df


def update_report(batch: DataFrame, as_of, key="city", order="time") -> DataFrame:
    """Per city: new rows, first and last new date, days behind ``as_of``; biggest first."""
    return (batch.groupBy(key)
            .agg(F.count(F.lit(1)).alias("new_rows"), F.min(order).alias("first_date"),
                 F.max(order).alias("last_date"))
            .withColumn("days_behind", F.datediff(F.lit(as_of), F.col("last_date")))
            .orderBy(F.col("new_rows").desc(), key))


def ingest_summary(all_cities: DataFrame, batch: DataFrame, key="city") -> DataFrame:
    """Status per known city: 'updated' when the batch holds rows for it, else 'skipped'."""
    updated = batch.select(key).distinct()
    return (all_cities.select(key).distinct()
            .join(updated.withColumn("_u", F.lit(True)), key, "left")
            .select(key, F.when(F.col("_u"), "updated").otherwise("skipped").alias("status")))


def ingest_status(source: DataFrame, latest: DataFrame, end=None, default_start: _dt.date = DEFAULT_START,
                  key="city", order="time") -> DataFrame:
    """The status ``ingest_summary`` gives to every city of ``source`` or ``latest`` for the rows
    ``select_increment`` would take, from one row per city: its newest date up to ``end`` is
    after the last one loaded, or not."""
    taken = F.col(order) if end is None else F.when(F.col(order) <= F.lit(end), F.col(order))
    newest = source.groupBy(key).agg(F.max(taken).alias("_newest"))
    start = F.coalesce(F.col("last_date"), F.date_sub(F.lit(default_start), 1))
    return (newest.join(latest.select(key, "last_date"), key, "full")
            .select(key, F.when(F.col("_newest") > start, "updated").otherwise("skipped").alias("status")))


def validate_range(start, end, as_of):
    """Argument check of a requested history range."""
    if start >= end:
        raise ValueError(f"start {start} must be before end {end}")
    if end > as_of:
        raise ValueError(f"history cannot end in the future: {end} > {as_of}")


def future_rows(df: DataFrame, as_of, key="city", order="time") -> DataFrame:
    """Rows dated after ``as_of`` per city (offending rows of a history load)."""
    return (df.filter(F.col(order) > F.lit(as_of)).groupBy(key)
            .agg(F.count(F.lit(1)).alias("future_rows"), F.min(order).alias("first_future")))
