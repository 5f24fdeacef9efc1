import datetime as dt

from pyspark.sql import functions as F

from tempest.operators.cleaning import handle_missing
from tempest.operators.features import compute_all_features
from tempest.sources import fixtures as fx
from tempest.streaming.refresh import refresh_features
from tempest.streaming.rollup import daily_rollup, rollup_available
from tempest.streaming.sessions import hot_runs, sessions_available
from tests.conftest import SMOKE


def test_refresh_equals_full_rebuild(spark):
    raw = fx.panel_with_nulls(spark, SMOKE, "region")
    cut = dt.date(1998, 6, 30)
    before, batch = raw.filter(F.col("time") <= cut), raw.filter(F.col("time") > cut)
    refreshed = refresh_features(before, compute_all_features(handle_missing(before)), batch)
    full = compute_all_features(handle_missing(raw))
    cols = full.columns
    a = refreshed.select(*cols).exceptAll(full.select(*cols)).count()
    b = full.select(*cols).exceptAll(refreshed.select(*cols)).count()
    assert a == 0 and b == 0


def test_stream_rollup_equals_batch_for_closed_days(spark, scratch):
    h = fx.hourly_panel(spark, SMOKE)
    h.write.parquet(f"{scratch}/hourly")
    out = rollup_available(spark, f"{scratch}/hourly", f"{scratch}/daily", f"{scratch}/ck")
    wm = h.select(F.max("ts")).first()[0] - dt.timedelta(days=2)
    batch = (h.groupBy("city", F.to_date("ts").alias("time"))
             .agg(F.count(F.lit(1)).alias("hours"), F.max("wind_speed_10m").alias("w"))
             .filter(F.col("time") + F.expr("interval 1 day") <= F.lit(wm)))
    got = sorted((r["city"], r["time"], r["hours"], r["wind_speed_10m_max"]) for r in out.collect())
    want = sorted((r["city"], r["time"], r["hours"], r["w"]) for r in batch.collect())
    assert got == want and len(got) > 0


def test_late_days_join_open_runs_and_too_late_ones_are_dropped(spark, scratch):
    schema = "city string, time date, temperature_2m_max double"

    def take(days):
        rows = [(c, dt.date(2024, 1, d), t) for c, d, t in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/land")
        out = sessions_available(spark, f"{scratch}/land", schema, lambda x: hot_runs(x, "5 days"), f"{scratch}/runs", f"{scratch}/ck")
        return sorted((r["city"], r["run_start"].day, r["run_end"].day, r["run_length"], r["peak"]) for r in out.collect())

    assert take([("a", 1, 40.0), ("a", 3, 36.0), ("a", 4, 35.0), ("b", 9, 10.0)]) == [("a", 1, 1, 1, 40.0)]
    # the second of January closes no gap any more: it lies before the watermark; the fifth joins nothing closed
    assert take([("a", 2, 50.0), ("a", 5, 37.0), ("b", 31, 10.0), (None, 5, 40.0)]) == [
        ("a", 1, 1, 1, 40.0), ("a", 3, 3, 1, 36.0), ("a", 5, 5, 1, 37.0)]


def test_runs_of_a_batch_equal_gaps_and_islands(spark):
    days = fx.panel(spark, SMOKE, "nation").select("city", "time", "temperature_2m_max")
    hot = days.filter("temperature_2m_max > 35").select("city", "time").collect()
    seen, runs = {(r["city"], r["time"]) for r in hot}, set()
    for city, day in seen:
        if (city, day - dt.timedelta(days=1)) not in seen:
            end = day
            while (city, end + dt.timedelta(days=1)) in seen:
                end += dt.timedelta(days=1)
            runs.add((city, day, end, (end - day).days + 1))
    got = {tuple(r) for r in hot_runs(days, "1 day").drop("peak").collect()}
    assert got == runs and runs
