"""Registered queries: streaming ingestion, roll-up, incremental refresh, layer runs (M*, R*)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from tempest import schemas as S
from tempest.operators.cleaning import handle_missing
from tempest.operators.features import compute_all_features
from tempest.plans import oracle as o
from tempest.plans.catalog import query, round_doubles
from tempest.plans.runner import run_layers
from tempest.session import checkpoint_dir
from tempest.sources import files
from tempest.sources import fixtures as fx
from tempest.streaming.ingest import ingest_available
from tempest.streaming.refresh import refresh_features
from tempest.streaming.rollup import rollup_available
from tempest.streaming.sessions import event_sessions, hot_runs, sessions_available

RAW_D = o.DOUBLE_RAW


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query("m01_stream_ingest_upsert", o.with_panels(
    o.rounded_select(RAW_D, ["city", "time", "weather_code"], "p"),
    p=o.panel("nation").replace("n_name AS city", "lower(n_name) AS city")))
def q_ingest(spark, sf_dir):
    """Land the panel as CSV files (one folder per city), stream them in a few files per
    micro-batch into the keyed store."""
    base = _scratch(spark, "ingest")
    p = fx.panel(spark, sf_dir, "nation")
    (p.withColumn("time", F.date_format("time", "yyyy-MM-dd"))
     .select(*S.DAILY_CSV.fieldNames(), F.lower("city").alias("landing_city"))
     .write.partitionBy("landing_city").option("header", True).csv(f"{base}/landing"))
    st = ingest_available(spark, f"{base}/landing", f"{base}/store", f"{base}/ck",
                          max_files_per_trigger=8, dir_key="landing_city", layout="folders")
    return round_doubles(st.select(*S.RAW_COLUMNS))


@query("m01_stream_ingest_kinds", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean + 1, 6) AS temperature_2m_mean, 0 AS batch_id FROM p",
    p=o.panel("region").replace("r_name AS city", "lower(r_name) AS city")))
def q_ingest_kinds(spark, sf_dir):
    """One folder with historical and forecast files per city, every historical day landed in
    two files of one micro-batch: the later file wins, forecast files stay out."""
    base = _scratch(spark, "ingest")
    p = fx.panel(spark, sf_dir, "region")
    rows = p.withColumn("time", F.date_format("time", "yyyy-MM-dd")).select(*S.DAILY_CSV.fieldNames())
    older = rows
    later = rows.withColumn("temperature_2m_mean", F.col("temperature_2m_mean") + 1)
    forecast = rows.withColumn("temperature_2m_mean", F.lit(-99.0))
    cities = [r["city"] for r in p.select("city").distinct().collect()]  # five regions
    for folder, df, kind in (("a", older, "historical"), ("b", later, "historical"), ("b", forecast, "forecast")):
        for c in cities:
            files.write_single_csv(df.filter(F.col("city") == c), f"{base}/landing/{folder}/{c.lower()}_{kind}.csv")
    st = ingest_available(spark, f"{base}/landing", f"{base}/store", f"{base}/ck")
    return round_doubles(st.select("city", "time", "temperature_2m_mean", F.col("batch_id").cast("int").alias("batch_id")))


@query("a15_audit_log", "SELECT * FROM (VALUES (1, 'incremental', 'ABORTED'), (2, 'full', 'SUCCESS'), (3, 'incremental', 'UP_TO_DATE'), "
       "(4, 'full', 'ABORTED'), (5, 'incremental', 'SUCCESS')) t(run_id, mode, status), "
       "(SELECT COUNT(*) AS stored FROM (" + o.panel("region") + ") p)")
def q_audit(spark, sf_dir):
    """The audit table over runs of every outcome; the layers hold all rows at the end,
    although an empty source was loaded in full mode on the way."""
    base, raw = _scratch(spark, "layers"), fx.panel(spark, sf_dir, "region")
    nothing = raw.filter("false")
    for mode, source in (("incremental", nothing), ("full", raw.filter(F.col("time") <= F.lit(_CUT))), ("incremental", nothing),
                         ("full", nothing), ("incremental", raw)):
        res = run_layers(spark, source, base, mode, as_of=_dt.date(2001, 11, 5), default_start=_dt.date(1990, 1, 1))
    stored = res["raw"].select(F.count(F.lit(1))).scalar().alias("stored")
    return spark.read.parquet(f"{base}/pipeline_runs").select("run_id", "mode", "status", stored)


@query("m03_stream_daily_rollup", o.with_panels(
    "SELECT city, CAST(date_trunc('day', ts) AS DATE) AS time, ROUND(AVG(temperature_2m), 6) AS temperature_2m_mean, "
    "ROUND(MAX(temperature_2m), 6) AS temperature_2m_max, ROUND(MIN(temperature_2m), 6) AS temperature_2m_min, "
    "ROUND(MAX(wind_speed_10m), 6) AS wind_speed_10m_max, ROUND(SUM(shortwave_radiation), 6) AS shortwave_radiation_sum, "
    "COUNT(*) AS hours FROM h GROUP BY 1, 2 "
    "HAVING CAST(date_trunc('day', ts) AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM h) - INTERVAL 2 DAY",
    h=fx.hourly_sql()))
def q_rollup(spark, sf_dir):
    base = _scratch(spark, "rollup")
    fx.hourly_panel(spark, sf_dir).write.parquet(f"{base}/hourly")
    out = rollup_available(spark, f"{base}/hourly", f"{base}/daily", f"{base}/ck")
    return round_doubles(out)


def _closed_sql(events, gap, limit, delay, measures=""):
    """Sessions of (city, ts, ...) in ``events`` by gaps and islands; those the watermark reached."""
    return (f"SELECT city, MIN(ts) AS first, MAX(ts) AS last, COUNT(*) AS events{measures} FROM "
            f"(SELECT *, SUM(fresh) OVER (PARTITION BY city ORDER BY ts) AS session FROM "
            f"(SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY city ORDER BY ts) < INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM {events}) a) b "
            f"GROUP BY city, session HAVING MAX(ts) + INTERVAL '{gap}' <= (SELECT MAX(ts) FROM {limit}) - INTERVAL '{delay}'")


@query("m04_stream_hot_runs", o.with_panels(
    "SELECT city, CAST(first AS DATE) AS run_start, CAST(last AS DATE) AS run_end, events AS run_length, ROUND(peak, 6) AS peak FROM s",
    p=o.panel("nation"), e="SELECT city, CAST(time AS TIMESTAMP) AS ts, temperature_2m_max FROM p",
    h="SELECT * FROM e WHERE temperature_2m_max > 35", s=_closed_sql("h", "36 hours", "e", "60 days", ", MAX(temperature_2m_max) AS peak")))
def q_stream_runs(spark, sf_dir):
    """Hot runs from a stream that is taken up twice: the second time six late weeks arrive
    together with the years after them, and extend or join the runs that are still open."""
    base, p = _scratch(spark, "runs"), fx.panel(spark, sf_dir, "nation")
    late = F.col("time").between(F.lit(_dt.date(1996, 11, 10)), F.lit(_dt.date(1996, 12, 20)))
    first = (F.col("time") < F.lit(_dt.date(1997, 1, 1))) & ~late
    for part in (first, ~first):
        p.filter(part).select("city", "time", "temperature_2m_max").write.mode("append").parquet(f"{base}/landing")
        out = sessions_available(spark, f"{base}/landing", "city string, time date, temperature_2m_max double",
                                 lambda days: hot_runs(days, "60 days"), f"{base}/runs", f"{base}/ck")
    return round_doubles(out)


@query("m05_stream_report_sessions", o.with_panels(
    "SELECT city, first, last, events, ROUND(strongest, 6) AS strongest FROM s", h=fx.hourly_sql(),
    s=_closed_sql("h", "90 minutes", "h", "2 days", ", MAX(wind_speed_10m) AS strongest")))
def q_stream_sessions(spark, sf_dir):
    """Spells of reporting of each series: an hour without a report ends one."""
    base = _scratch(spark, "sessions")
    fx.hourly_panel(spark, sf_dir).write.parquet(f"{base}/hourly")
    return round_doubles(sessions_available(
        spark, f"{base}/hourly", S.HOURLY,
        lambda h: event_sessions(h, "ts", "90 minutes", "2 days", strongest=F.max("wind_speed_10m")), f"{base}/spells", f"{base}/ck"))


_CUT = _dt.date(2001, 6, 30)


@query("m02_incremental_refresh", o.with_panels(
    o.rounded_select(RAW_D + o.FEATURE_DOUBLES, ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_refresh(spark, sf_dir):
    """Features refreshed after the last months arrive equal a full rebuild."""
    raw = fx.panel_with_nulls(spark, sf_dir, "region")
    before = raw.filter(F.col("time") <= F.lit(_CUT))
    batch = raw.filter(F.col("time") > F.lit(_CUT))
    analytics_before = compute_all_features(handle_missing(before))
    return round_doubles(refresh_features(before, analytics_before, batch))


@query("r01_full_layer_run", o.with_panels(
    o.rounded_select(RAW_D + o.FEATURE_DOUBLES, ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_full_run(spark, sf_dir):
    res = run_layers(spark, fx.panel_with_nulls(spark, sf_dir, "region"), _scratch(spark, "layers"),
                     "full", as_of=_dt.date(2001, 11, 5))
    cols = [c for c in res["analytics"].columns if not c.endswith("_outlier_flag")]
    return round_doubles(res["analytics"].select(*cols))


@query("r02_incremental_layer_run", o.with_panels(
    o.rounded_select(RAW_D + o.FEATURE_DOUBLES, ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_incremental_run(spark, sf_dir):
    """Full run on history up to the cut, then an incremental run with everything: the
    analytics layer equals one full run."""
    base = _scratch(spark, "layers")
    raw = fx.panel_with_nulls(spark, sf_dir, "region")
    run_layers(spark, raw.filter(F.col("time") <= F.lit(_CUT)), base, "full", as_of=_dt.date(2001, 11, 5))
    res = run_layers(spark, raw, base, "incremental", as_of=_dt.date(2001, 11, 5),
                     default_start=_dt.date(1990, 1, 1))
    cols = [c for c in res["analytics"].columns if not c.endswith("_outlier_flag")]
    return round_doubles(res["analytics"].select(*cols))


_LATE = (_dt.date(2000, 3, 1), _dt.date(2000, 4, 15))


@query("m02_maintained_layers", o.with_panels(
    o.rounded_select(RAW_D + o.FEATURE_DOUBLES, ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_maintained(spark, sf_dir):
    """History without six weeks of 2000, then those late rows, then the last months: rows are
    derived from the first affected one and the history tables maintained; equal to one full run."""
    base, raw = _scratch(spark, "layers"), fx.panel_with_nulls(spark, sf_dir, "region")
    late = F.col("time").between(*map(F.lit, _LATE))
    options = {"as_of": _dt.date(2001, 11, 5), "default_start": _dt.date(1990, 1, 1)}
    run_layers(spark, raw.filter((F.col("time") <= F.lit(_CUT)) & ~late), base, "full", **options)
    run_layers(spark, raw, base, "incremental", start=_LATE[0], end=_LATE[1], force=True, **options)
    res = run_layers(spark, raw, base, "incremental", **options)
    cols = [c for c in res["analytics"].columns if not c.endswith("_outlier_flag")]
    return round_doubles(res["analytics"].select(*cols))


@query("r06_lost_layer_run", o.with_panels(
    o.rounded_select(RAW_D + o.FEATURE_DOUBLES, ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_lost_layer(spark, sf_dir):
    """An incremental run over a store whose analytics layer is gone keeps the stored raw rows."""
    base, raw = _scratch(spark, "layers"), fx.panel_with_nulls(spark, sf_dir, "region")
    run_layers(spark, raw.filter(F.col("time") <= F.lit(_CUT)), base, "full", as_of=_dt.date(2001, 11, 5))
    files.drop_version(spark, f"{base}/analytics_historical")
    res = run_layers(spark, raw.filter(F.col("time") > F.lit(_CUT)), base, "incremental", as_of=_dt.date(2001, 11, 5),
                     default_start=_dt.date(1990, 1, 1))
    cols = [c for c in res["analytics"].columns if not c.endswith("_outlier_flag")]
    return round_doubles(res["analytics"].select(*cols))


@query("r03_full_layer_run_chunked", o.with_panels(
    o.rounded_select(RAW_D + o.FEATURE_DOUBLES, ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_full_run_chunked(spark, sf_dir):
    res = run_layers(spark, fx.panel_with_nulls(spark, sf_dir, "region"), _scratch(spark, "layers"),
                     "full", as_of=_dt.date(2001, 11, 5), chunk_rows=500)
    cols = [c for c in res["analytics"].columns if not c.endswith("_outlier_flag")]
    return round_doubles(res["analytics"].select(*cols))
