"""Registered queries: window features, cleaning, series incidents (E*, I*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest.operators import cleaning as cl
from tempest.operators import features as fe
from tempest.plans import oracle as o
from tempest.plans.catalog import query, rnd, round_doubles
from tempest.sources import fixtures as fx

RAW_DOUBLES = o.DOUBLE_RAW


def feature_layer(spark, sf_dir):
    """Flagship: P_NULLS -> missing-value repair -> feature layer."""
    staged = cl.handle_missing(fx.panel_with_nulls(spark, sf_dir, "region"))
    return fe.compute_all_features(staged)


@query("e01_feature_layer", o.with_panels(
    o.rounded_select(RAW_DOUBLES + o.FEATURE_DOUBLES,
                     ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_feature_layer(spark, sf_dir):
    return round_doubles(feature_layer(spark, sf_dir))


W = o.W_CITY
NAT = o.panel("nation")


def _nation(spark, sf_dir):
    return fx.panel(spark, sf_dir, "nation")


@query("i01_missing_repair", o.with_panels(
    o.rounded_select(RAW_DOUBLES, ["city", "time", "weather_code"], "r"),
    p=o.nulls("region"), r=o.repaired_sql("p")))
def q_missing_repair(spark, sf_dir):
    return round_doubles(cl.handle_missing(fx.panel_with_nulls(spark, sf_dir, "region")))


@query("e02_rolling_full_window", o.with_panels(
    "SELECT city, time, ROUND(CASE WHEN COUNT(temperature_2m_max) OVER (" + W + " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 "
    "THEN AVG(temperature_2m_max) OVER (" + W + " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 6) AS tmax_7d_full, "
    "ROUND(AVG(temperature_2m_max) OVER (PARTITION BY city ORDER BY time RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) AS tmax_7cal FROM p",
    p=NAT))
def q_rolling_full(spark, sf_dir):
    p = _nation(spark, sf_dir)
    return p.select("city", "time",
                    rnd(fe.rolling_mean("temperature_2m_max", 7, min_periods=7)).alias("tmax_7d_full"),
                    rnd(fe.calendar_rolling_mean("temperature_2m_max", 7)).alias("tmax_7cal"))


_FB = ["temperature_2m_mean_7d", "temperature_2m_mean_30d", "anomaly_score",
       "temperature_2m_mean_lag1", "temperature_2m_mean_lag2", "HDD", "CDD",
       "precipitation_sum_7d", "precipitation_sum_30d", "precipitation_sum_lag1",
       "precipitation_sum_lag2"]


@query("e03_fallback_features", o.with_panels(
    o.rounded_select(_FB, ["city", "time"], "f"), p=o.panel("region"),
    f="SELECT city, time, "
      "AVG(temperature_2m_mean) OVER (" + W + " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS temperature_2m_mean_7d, "
      "AVG(temperature_2m_mean) OVER (" + W + " ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS temperature_2m_mean_30d, "
      "temperature_2m_mean - AVG(temperature_2m_mean) OVER (" + W + " ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS anomaly_score, "
      "LAG(temperature_2m_mean, 1) OVER (" + W + ") AS temperature_2m_mean_lag1, "
      "LAG(temperature_2m_mean, 2) OVER (" + W + ") AS temperature_2m_mean_lag2, "
      "GREATEST(18.0 - temperature_2m_mean, 0.0) AS HDD, GREATEST(temperature_2m_mean - 18.0, 0.0) AS CDD, "
      "SUM(precipitation_sum) OVER (" + W + " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS precipitation_sum_7d, "
      "SUM(precipitation_sum) OVER (" + W + " ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS precipitation_sum_30d, "
      "LAG(precipitation_sum, 1) OVER (" + W + ") AS precipitation_sum_lag1, "
      "LAG(precipitation_sum, 2) OVER (" + W + ") AS precipitation_sum_lag2 FROM p"))
def q_fallback_features(spark, sf_dir):
    f = fe.fallback_features(fx.panel(spark, sf_dir, "region"))
    return round_doubles(f.select("city", "time", *_FB))


@query("e08_city_anomaly", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean - AVG(temperature_2m_mean) OVER (PARTITION BY city), 6) AS temp_anomaly FROM p",
    p=NAT))
def q_city_anomaly(spark, sf_dir):
    return _nation(spark, sf_dir).select(
        "city", "time", rnd(fe.city_anomaly("temperature_2m_mean")).alias("temp_anomaly"))


@query("e09_persistence_alert", o.with_panels(
    "SELECT city, time, CAST(CASE WHEN ROW_NUMBER() OVER (" + W + ") >= 3 THEN "
    "SUM(CASE WHEN temperature_2m_max > 35 THEN 1 ELSE 0 END) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS persistence_alert_level, "
    "CAST(CASE WHEN ROW_NUMBER() OVER (" + W + ") >= 3 THEN "
    "SUM(CASE WHEN temperature_2m_max > 35 THEN 1 WHEN temperature_2m_max < 10 THEN -1 ELSE 0 END) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS signed_alert_level "
    "FROM p", p=NAT))
def q_persistence(spark, sf_dir):
    return _nation(spark, sf_dir).select(
        "city", "time", fe.persistence_alert_level().alias("persistence_alert_level"),
        fe.persistence_alert_level(cold=10.0).alias("signed_alert_level"))


@query("e10_extreme_runs", o.with_panels(
    "SELECT city, MIN(time) AS run_start, MAX(time) AS run_end, COUNT(*) AS run_length "
    "FROM (SELECT city, time, rn - ROW_NUMBER() OVER (PARTITION BY city ORDER BY rn) AS grp FROM "
    "(SELECT city, time, temperature_2m_max > 35 AS f, ROW_NUMBER() OVER (" + W + ") AS rn FROM p) a WHERE f) b "
    "GROUP BY city, grp", p=NAT))
def q_extreme_runs(spark, sf_dir):
    return fe.extreme_runs(_nation(spark, sf_dir), F.col("temperature_2m_max") > 35)


@query("i08_sensor_artefacts", o.with_panels(
    "SELECT city, time, stuck, ROUND(jump, 6) AS jump FROM ("
    "SELECT city, time, COALESCE(COUNT(*) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND "
    "SUM(same) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2, false) AS stuck, jump FROM ("
    "SELECT city, time, CASE WHEN COALESCE(temperature_2m_mean - LAG(temperature_2m_mean) OVER (" + W + "), 0) = 0 THEN 1 ELSE 0 END AS same, "
    "ABS(temperature_2m_mean - LAG(temperature_2m_mean) OVER (" + W + ")) AS jump FROM p) d) s "
    "WHERE stuck OR jump > 15", p=NAT))
def q_sensor(spark, sf_dir):
    p = _nation(spark, sf_dir)
    s = p.select("city", "time", fe.stuck_sensor_flag().alias("stuck"), fe.jump_size().alias("jump"))
    return s.filter(F.col("stuck") | (F.col("jump") > 15)).select(
        "city", "time", "stuck", rnd("jump").alias("jump"))


_FLAG_COLS = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum",
              "wind_speed_10m_max", "pressure_msl_mean", "shortwave_radiation_sum"]


def _iqr_sql(cols):
    items = []
    for c in cols:
        q1 = f"quantile_cont({c}, 0.25) OVER (PARTITION BY city)"
        q3 = f"quantile_cont({c}, 0.75) OVER (PARTITION BY city)"
        items.append(f"COALESCE({c} < {q1} - 1.5 * ({q3} - {q1}) OR {c} > {q3} + 1.5 * ({q3} - {q1}), false) AS {c}_outlier_flag")
    return "SELECT city, time, " + ", ".join(items) + " FROM p"


def _z_sql(cols, k=2.0):
    items = []
    for c in cols:
        sd = f"STDDEV_SAMP({c}) OVER (PARTITION BY city)"
        items.append(f"COALESCE(CASE WHEN {sd} <> 0 THEN ABS({c} - AVG({c}) OVER (PARTITION BY city)) / {sd} > {k} END, false) AS {c}_outlier_flag")
    return "SELECT city, time, " + ", ".join(items) + " FROM p"


@query("i02_outliers_iqr", o.with_panels(_iqr_sql(_FLAG_COLS), p=NAT))
def q_outliers_iqr(spark, sf_dir):
    f = cl.flag_outliers(_nation(spark, sf_dir), _FLAG_COLS, "iqr", 1.5)
    return f.select("city", "time", *[f"{c}_outlier_flag" for c in _FLAG_COLS])


@query("i03_outliers_zscore", o.with_panels(_z_sql(_FLAG_COLS), p=NAT))
def q_outliers_z(spark, sf_dir):
    f = cl.flag_outliers(_nation(spark, sf_dir), _FLAG_COLS, "zscore", 2.0)
    return f.select("city", "time", *[f"{c}_outlier_flag" for c in _FLAG_COLS])


@query("i04_gap_report", o.with_panels(
    "SELECT city, MIN(time) AS start_date, MAX(time) AS end_date, "
    "CAST(date_diff('day', MIN(time), MAX(time)) + 1 AS INTEGER) AS expected_days, "
    "CAST(COUNT(DISTINCT time) AS INTEGER) AS actual_days, "
    "CAST(date_diff('day', MIN(time), MAX(time)) + 1 - COUNT(DISTINCT time) AS INTEGER) AS missing_count, "
    "CAST(len(list_filter(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY), lambda d: NOT list_contains(list(CAST(time AS TIMESTAMP)), d))) AS INTEGER) AS listed_missing "
    "FROM p GROUP BY city", p=NAT))
def q_gap_report(spark, sf_dir):
    g = cl.date_gaps(_nation(spark, sf_dir))
    return g.select("city", "start_date", "end_date", "expected_days", "actual_days",
                    "missing_count", F.size("missing_dates").cast("int").alias("listed_missing"))


@query("c06_missing_dates", o.with_panels(
    "SELECT city, CAST(d AS DATE) AS missing_date FROM (SELECT city, unnest(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS d "
    "FROM p GROUP BY city) s WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.city = s.city AND q.time = CAST(s.d AS DATE))",
    p=NAT))
def q_missing_dates(spark, sf_dir):
    return cl.missing_dates(_nation(spark, sf_dir))


_CLEAN_FLAGS = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum",
                "wind_speed_10m_max", "pressure_msl_mean"]


@query("i05_clean", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean, "
    "ROUND(wind_speed_10m_max, 6) AS wind_speed_10m_max, "
    + ", ".join(f"{c}_outlier_flag" for c in _CLEAN_FLAGS) + " FROM f",
    p=o.nulls("region"), r=o.repaired_sql("p"),
    f=_iqr_sql(_CLEAN_FLAGS).replace("SELECT city, time,", "SELECT city, time, temperature_2m_mean, wind_speed_10m_max,").replace("FROM p", "FROM r")))
def q_clean(spark, sf_dir):
    s = cl.clean(fx.panel_with_nulls(spark, sf_dir, "region"), outlier_columns=_CLEAN_FLAGS)
    return round_doubles(s.select("city", "time", "temperature_2m_mean", "wind_speed_10m_max",
                                  *[f"{c}_outlier_flag" for c in _CLEAN_FLAGS]))


def _fb_sql(cols):
    items = []
    for c in cols:
        items.append(
            f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"FIRST_VALUE({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")
    return "SELECT city, time, " + ", ".join(items) + " FROM p"


_FB_COLS = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum",
            "wind_speed_10m_max", "relative_humidity_2m_mean", "pressure_msl_mean"]


@query("i06_fallback_clean", o.with_panels(
    o.rounded_select(_FB_COLS, ["city", "time"], "f"), p=o.nulls("region"), f=_fb_sql(_FB_COLS)))
def q_fallback_clean(spark, sf_dir):
    f = cl.fallback_clean(fx.panel_with_nulls(spark, sf_dir, "region"))
    return round_doubles(f.select("city", "time", *_FB_COLS))


@query("i07_consistency", o.with_panels(
    "SELECT h.time, h.city, ROUND(h.temperature_2m_mean, 6) AS temperature_2m_mean_hist, "
    "ROUND(f.temperature_2m_mean, 6) AS temperature_2m_mean_fore, "
    "ROUND(ABS(h.temperature_2m_mean - f.temperature_2m_mean), 6) AS temp_diff, "
    "COALESCE(ABS(h.temperature_2m_mean - f.temperature_2m_mean) > 2.0, false) AS discrepancy "
    "FROM h JOIN f ON h.time = f.time AND h.city = f.city",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region")))
def q_consistency(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    return round_doubles(cl.consistency(h, f))


@query("e13_latest_per_city", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max, latitude, longitude FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY time DESC) AS rn FROM p) s WHERE rn = 1", p=NAT))
def q_latest(spark, sf_dir):
    l = fe.latest_per_key(_nation(spark, sf_dir))
    return l.select("city", "time", rnd("temperature_2m_max").alias("temperature_2m_max"),
                    "latitude", "longitude")


@query("e14_merge_dedup", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean, src FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY city, time ORDER BY prio DESC) AS rn FROM "
    "(SELECT city, time, temperature_2m_mean, 'hist' AS src, 1 AS prio FROM h UNION ALL "
    " SELECT city, time, temperature_2m_mean, 'fcst' AS src, 0 AS prio FROM f) u) s WHERE rn = 1",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region")))
def q_merge_dedup(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    m = fe.merge_prefer(h.select("city", "time", "temperature_2m_mean", F.lit("hist").alias("src")),
                        f.select("city", "time", "temperature_2m_mean", F.lit("fcst").alias("src")))
    return round_doubles(m)


@query("e15_centred_mean", o.with_panels(
    "SELECT city, time, ROUND(AVG(temperature_2m_max) OVER (" + W + " ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 6) AS tmax_c31 FROM p",
    p=NAT))
def q_centred(spark, sf_dir):
    return _nation(spark, sf_dir).select(
        "city", "time", rnd(fe.centred_mean("temperature_2m_max", 15)).alias("tmax_c31"))


@query("e21_date_gap_days", o.with_panels(
    "SELECT * FROM (SELECT city, time, CAST(date_diff('day', LAG(time) OVER (" + W + "), time) AS INTEGER) AS gap_days FROM p) g "
    "WHERE gap_days IS NOT NULL",
    p=NAT))
def q_date_gap(spark, sf_dir):
    g = _nation(spark, sf_dir).select("city", "time", fe.date_gap_days().alias("gap_days"))
    return g.filter(F.col("gap_days").isNotNull())


_HCOLS = ("wind_speed_10m", "temperature_2m", "shortwave_radiation")
_HLAGS = (1, 2, 3, 6, 12, 24, 48)
_HWIN = (6, 12, 24)


def _hourly_sql():
    w = "PARTITION BY city ORDER BY ts"
    items = ["city", "ts"]
    for c in _HCOLS:
        for k in _HLAGS:
            items.append(f"ROUND(LAG({c}, {k}) OVER ({w}), 6) AS {c}_lag{k}")
        for n in _HWIN:
            items.append(f"ROUND(AVG({c}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS {c}_roll{n}")
    return "SELECT " + ", ".join(items) + " FROM h"


@query("e22_hourly_features", o.with_panels(_hourly_sql(), h=fx.hourly_sql()))
def q_hourly(spark, sf_dir):
    h = fe.hourly_features(fx.hourly_panel(spark, sf_dir), columns=_HCOLS, lags=_HLAGS, windows=_HWIN)
    return round_doubles(h.drop(*_HCOLS, "is_day"))


@query("e23_every_kth_row", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max FROM "
    "(SELECT *, ROW_NUMBER() OVER (" + W + ") AS rn, GREATEST(COUNT(*) OVER (PARTITION BY city) // 300, 1) AS k FROM p) s "
    "WHERE (rn - 1) % k = 0", p=NAT))
def q_every_kth(spark, sf_dir):
    p = _nation(spark, sf_dir)
    k = F.greatest(F.floor(F.count(F.lit(1)).over(fe.Window.partitionBy("city")) / 300), F.lit(1))
    return (fe.every_kth(p.withColumn("_k", k), F.col("_k"))
            .select("city", "time", rnd("temperature_2m_max").alias("temperature_2m_max")))


def acf_sql(max_lag=40, src="p", col="temperature_2m_mean", where=""):
    lags = ", ".join(f"LAG(d, {k}) OVER (" + W + f") AS l{k}" for k in range(1, max_lag + 1))
    sums = ", ".join(f"SUM(d * l{k}) AS p{k}" for k in range(1, max_lag + 1))
    arr = ", ".join(f"p{k} / ss" for k in range(1, max_lag + 1))
    return ("SELECT city, CAST(generate_subscripts(a, 1) AS INTEGER) AS lag, ROUND(unnest(a), 6) AS acf, ROUND(1.96 / sqrt(n), 6) AS band FROM ("
            f"SELECT city, n, [{arr}] AS a FROM (SELECT city, SUM(d * d) AS ss, COUNT(d) AS n, {sums} FROM "
            f"(SELECT city, d, {lags} FROM (SELECT city, time, {col} - AVG({col}) OVER (PARTITION BY city) AS d FROM {src} {where}) c) l "
            "GROUP BY city) g) x")


@query("e24_autocorrelation", o.with_panels(acf_sql(), p=o.panel("region")))
def q_acf(spark, sf_dir):
    return round_doubles(fe.autocorrelation(fx.panel(spark, sf_dir, "region"), "temperature_2m_mean"))


# Chunked execution of the same layers: every window partition is (city, chunk) or
# (city, year), so a city holding a large share of all rows is spread over many tasks.
CHUNK_ROWS = 500


@query("e01_feature_layer_chunked", o.with_panels(
    o.rounded_select(RAW_DOUBLES + o.FEATURE_DOUBLES,
                     ["city", "time", "weather_code"] + o.FEATURE_OTHER, "f"),
    p=o.nulls("region"), r=o.repaired_sql("p"), f=o.features_sql("r")))
def q_feature_layer_chunked(spark, sf_dir):
    from tempest.operators import chunked as ch

    from tempest.session import materialize

    # as in a layer run, each layer is written before the next one reads it more than once
    raw = materialize(fx.panel_with_nulls(spark, sf_dir, "region"))
    staged = materialize(ch.handle_missing_chunked(raw, chunk_rows=CHUNK_ROWS))
    return round_doubles(ch.compute_all_features_chunked(staged, chunk_rows=CHUNK_ROWS))


@query("i01_missing_repair_chunked", o.with_panels(
    o.rounded_select(RAW_DOUBLES, ["city", "time", "weather_code"], "r"),
    p=o.nulls("region"), r=o.repaired_sql("p")))
def q_missing_repair_chunked(spark, sf_dir):
    from tempest.operators import chunked as ch

    return round_doubles(ch.handle_missing_chunked(fx.panel_with_nulls(spark, sf_dir, "region"),
                                                   chunk_rows=CHUNK_ROWS))


@query("e09_persistence_alert_chunked", o.with_panels(
    "SELECT city, time, CAST(CASE WHEN ROW_NUMBER() OVER (" + W + ") >= 3 THEN "
    "SUM(CASE WHEN temperature_2m_max > 35 THEN 1 ELSE 0 END) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS persistence_alert_level "
    "FROM p", p=NAT))
def q_persistence_chunked(spark, sf_dir):
    from tempest.operators import chunked as ch

    p = _nation(spark, sf_dir).select("city", "time", "temperature_2m_max")
    return ch.chunked_apply(p, ch.persistence_alert_level(), 2, 0, CHUNK_ROWS).select(
        "city", "time", "persistence_alert_level")


@query("i08_sensor_artefacts_chunked", o.with_panels(
    "SELECT city, time, stuck, ROUND(jump, 6) AS jump FROM ("
    "SELECT city, time, COALESCE(COUNT(*) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND "
    "SUM(same) OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2, false) AS stuck, jump FROM ("
    "SELECT city, time, CASE WHEN COALESCE(temperature_2m_mean - LAG(temperature_2m_mean) OVER (" + W + "), 0) = 0 THEN 1 ELSE 0 END AS same, "
    "ABS(temperature_2m_mean - LAG(temperature_2m_mean) OVER (" + W + ")) AS jump FROM p) d) s "
    "WHERE stuck OR jump > 15", p=NAT))
def q_sensor_chunked(spark, sf_dir):
    from tempest.operators import chunked as ch

    p = _nation(spark, sf_dir).select("city", "time", "temperature_2m_mean")
    s = ch.chunked_apply(p, ch.sensor_artefacts(), 3, 0, CHUNK_ROWS)
    return s.filter(F.col("stuck") | (F.col("jump") > 15)).select("city", "time", "stuck", rnd("jump").alias("jump"))


@query("e15_centred_mean_chunked", o.with_panels(
    "SELECT city, time, ROUND(AVG(temperature_2m_max) OVER (" + W + " ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 6) AS tmax_c31 FROM p",
    p=NAT))
def q_centred_chunked(spark, sf_dir):
    from tempest.operators import chunked as ch

    p = _nation(spark, sf_dir).select("city", "time", "temperature_2m_max")
    c = ch.chunked_apply(p, ch.centred_mean("temperature_2m_max", 15, "tmax_c31"), 15, 15, CHUNK_ROWS)
    return c.select("city", "time", rnd("tmax_c31").alias("tmax_c31"))


def _asof_sql(tolerance=None):
    near = f"a.ts - b.ts <= INTERVAL {tolerance} SECOND" if tolerance else "TRUE"
    return ("SELECT a.event_id, a.event_type, COALESCE(CASE WHEN " + near + " THEN b.event_id END, -1) AS event_id_asof, "
            "CASE WHEN " + near + " THEN ROUND(b.value, 6) END AS value_asof FROM "
            "(SELECT * FROM events WHERE event_id % 2 = 0) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 1) b "
            "ON a.event_type = b.event_type AND a.ts >= b.ts")


def _asof(spark, sf_dir, **options):
    from tempest.operators.temporal import asof_join

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", "value")
    out = asof_join(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), key="event_type", time="ts", **options)
    return round_doubles(out.select("event_id", "event_type", F.coalesce("event_id_asof", F.lit(-1)).alias("event_id_asof"), "value_asof"))


@query("t01_asof_join", _asof_sql())
def q_asof(spark, sf_dir):
    """Each even event with the last odd event of its type at or before it."""
    return _asof(spark, sf_dir, period=2 * 86400)


@query("t02_asof_join_tolerance", _asof_sql(1800))
def q_asof_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir, tolerance=1800, period=6 * 3600)


_RUNS = ("SELECT city, MIN(time) AS run_start, MAX(time) AS run_end, COUNT(*) AS run_length "
         "FROM (SELECT city, time, rn - ROW_NUMBER() OVER (PARTITION BY city ORDER BY rn) AS grp FROM "
         "(SELECT city, time, temperature_2m_max > 35 AS f, ROW_NUMBER() OVER (" + W + ") AS rn FROM p) a WHERE f) b "
         "GROUP BY city, grp HAVING COUNT(*) >= 3")


@query("t03_days_in_heat_waves", o.with_panels(
    "SELECT p.city, p.time, ROUND(p.temperature_2m_max, 6) AS temperature_2m_max, run_length FROM p JOIN w "
    "ON p.city = w.city AND p.time >= w.run_start AND p.time <= w.run_end", p=NAT, w=_RUNS))
def q_heat_wave_days(spark, sf_dir):
    """The days inside runs of three and more extreme days, with the run's length."""
    from tempest.operators.temporal import interval_join

    p = _nation(spark, sf_dir)
    runs = fe.extreme_runs(p, F.col("temperature_2m_max") > 35).filter("run_length >= 3")
    days = interval_join(p.select("city", "time", "temperature_2m_max"), runs, start="run_start", end="run_end")
    return round_doubles(days.select("city", "time", "temperature_2m_max", "run_length"))
