"""Registered queries: quality gates and structural validation (Q*)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from tempest.operators import cleaning as cl
from tempest.operators import features as fe
from tempest.operators import quality as qa
from tempest.plans import oracle as o
from tempest.plans.catalog import query, round_doubles
from tempest.sources import fixtures as fx

AS_OF = _dt.date(2001, 11, 5)
# written out so that the oracle stands on its own
NUMERIC_RAW = ["latitude", "longitude", "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "apparent_temperature_max",
               "precipitation_sum", "rain_sum", "snowfall_sum", "wind_speed_10m_max", "wind_gusts_10m_max", "relative_humidity_2m_mean",
               "cloud_cover_mean", "pressure_msl_mean", "shortwave_radiation_sum", "weather_code"]
REQUIRED_FEATURES = ["temperature_2m_mean_7d", "temperature_2m_mean_30d", "precipitation_sum_7d", "precipitation_sum_30d", "month", "quarter",
                     "day_of_year", "season", "temperature_range", "HDD", "CDD", "anomaly_score", "temperature_2m_mean_lag1",
                     "temperature_2m_mean_lag2", "precipitation_sum_lag1", "precipitation_sum_lag2"]
TEMPERATURE_COLUMNS = ["temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "apparent_temperature_max"]


def _row_count_sql(src, stage, seq):
    return (f"SELECT 'row_count' AS check_name, '{stage}' AS stage, CASE WHEN n = 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
            f"'rows=' || n AS details, {seq} AS seq "
            f"FROM (SELECT COUNT(*) AS n FROM {src}) c")


def _freshness_sql(src, stage, seq, as_of=AS_OF, max_lag=2):
    lag = f"date_diff('day', latest, DATE '{as_of}')"
    return (f"SELECT 'freshness' AS check_name, '{stage}' AS stage, "
            f"CASE WHEN latest IS NULL THEN 'WARN' WHEN {lag} > {max_lag} THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN latest IS NULL THEN 'nothing to check' "
            f"ELSE 'latest=' || strftime(latest, '%Y-%m-%d') || ' lag=' || {lag} || ' limit={max_lag}' END AS details, {seq} AS seq "
            f"FROM (SELECT MAX(time) AS latest FROM {src}) m")


def _null_ratio_sql(src, stage, seq, cols=NUMERIC_RAW, thr=0.05):
    ratios = ", ".join(f"AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in cols)
    items = ", ".join(f"CASE WHEN {c} > {thr} THEN printf('%s=%.1f%%', '{c}', {c} * 100) END" for c in cols)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return (f"SELECT 'null_ratio' AS check_name, '{stage}' AS stage, CASE WHEN len({lst}) > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
            f"'limit=5% ' || array_to_string({lst}, ' ') AS details, {seq} AS seq FROM (SELECT {ratios} FROM {src}) r")


def _continuity_sql(src, stage, seq, max_gap=3):
    gaps = (f"SELECT city, MAX(g) AS max_gap FROM (SELECT city, date_diff('day', LAG(d) OVER (PARTITION BY city ORDER BY d), d) AS g "
            f"FROM (SELECT DISTINCT city, time AS d FROM {src}) x) y GROUP BY city HAVING MAX(g) IS NOT NULL")
    return (f"SELECT 'date_continuity' AS check_name, '{stage}' AS stage, CASE WHEN rows = 0 OR bad > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN rows = 0 THEN 'nothing to check' WHEN bad > 0 THEN 'limit={max_gap} cities=' || bad || ' worst=' || worst || ' gap=' || gap "
            f"ELSE 'limit={max_gap} cities=0' END AS details, {seq} AS seq FROM (SELECT COUNT(*) FILTER (WHERE max_gap > {max_gap}) AS bad, MAX(max_gap) AS gap, "
            f"FIRST(city ORDER BY max_gap DESC, city) AS worst, (SELECT COUNT(*) FROM {src}) AS rows FROM ({gaps}) z) s")


def _ranges_sql(src, stage, seq, lo=-50.0, hi=60.0):
    cond = " OR ".join(f"COALESCE({c} < {lo} OR {c} > {hi}, false)" for c in TEMPERATURE_COLUMNS)
    return (f"SELECT 'value_ranges' AS check_name, '{stage}' AS stage, CASE WHEN n = 0 OR bad > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN n = 0 THEN 'nothing to check' ELSE 'range={lo}..{hi} outside=' || bad END AS details, {seq} AS seq "
            f"FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {cond}) AS bad FROM {src}) c")


def _completeness_sql(src, stage, seq):
    counts = ", ".join(f"COUNT({c}) AS {c}" for c in REQUIRED_FEATURES)
    items = ", ".join(f"CASE WHEN {c} = 0 THEN '{c}' END" for c in REQUIRED_FEATURES)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return (f"SELECT 'feature_completeness' AS check_name, '{stage}' AS stage, CASE WHEN len({lst}) > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
            f"'required={len(REQUIRED_FEATURES)} absent= empty=' || array_to_string({lst}, ',') AS details, {seq} AS seq "
            f"FROM (SELECT {counts} FROM {src}) c")


def _layers(spark, sf_dir):
    """The three layers, each materialised once (reliable checkpoints in the shared
    checkpoint folder, as a layer run writes them to Parquet) so the gates of a layer do
    not recompute its lineage."""
    from tempest.session import materialize

    raw = materialize(fx.panel_with_nulls(spark, sf_dir, "region"))
    staging = materialize(cl.handle_missing(raw))
    analytics = fe.compute_all_features(staging)
    return raw, staging, analytics


@query("q07_run_all_checks", o.with_panels(
    " UNION ALL ".join([
        _row_count_sql("r", "raw_historical", 0), _freshness_sql("r", "raw_historical", 1),
        _row_count_sql("s", "staging_historical", 2), _null_ratio_sql("s", "staging_historical", 3),
        _continuity_sql("s", "staging_historical", 4), _ranges_sql("s", "staging_historical", 5),
        _row_count_sql("a", "analytics_historical", 6), _completeness_sql("a", "analytics_historical", 7)]),
    r=o.nulls("region"), s=o.repaired_sql("r"), a=o.features_sql("s")))
def q_all_checks(spark, sf_dir):
    raw, staging, analytics = _layers(spark, sf_dir)
    return qa.run_all_checks(raw, staging, analytics, as_of=AS_OF)


@query("q02_null_ratio_raw", o.with_panels(_null_ratio_sql("r", "raw_historical", 0), r=o.nulls("region")))
def q_null_ratio(spark, sf_dir):
    return qa.check_null_ratio(fx.panel_with_nulls(spark, sf_dir, "region"), "raw_historical").withColumn("seq", F.lit(0))


@query("q03_date_continuity_gappy", o.with_panels(_continuity_sql("p", "staging_nation", 0), p=o.panel("nation")))
def q_continuity(spark, sf_dir):
    return qa.check_date_continuity(fx.panel(spark, sf_dir, "nation"), "staging_nation").withColumn("seq", F.lit(0))


@query("q04_value_ranges_narrow", o.with_panels(_ranges_sql("p", "staging_nation", 0, 0.0, 45.0), p=o.panel("nation")))
def q_ranges(spark, sf_dir):
    return qa.check_value_ranges(fx.panel(spark, sf_dir, "nation"), "staging_nation", 0.0, 45.0).withColumn("seq", F.lit(0))


@query("q06_freshness_stale", o.with_panels(_freshness_sql("p", "raw_nation", 0, _dt.date(2002, 3, 1)), p=o.panel("nation")))
def q_fresh(spark, sf_dir):
    return qa.check_freshness(fx.panel(spark, sf_dir, "nation"), "raw_nation", as_of=_dt.date(2002, 3, 1)).withColumn("seq", F.lit(0))


@query("q07_overall_status", o.with_panels(
    "SELECT CASE WHEN MAX(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) = 2 THEN 'FAIL' "
    "WHEN MAX(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) = 1 THEN 'WARN' ELSE 'PASS' END AS overall FROM c",
    p=o.panel("nation"), c=_continuity_sql("p", "staging_nation", 0) + " UNION ALL " + _row_count_sql("p", "staging_nation", 1)))
def q_overall(spark, sf_dir):
    p = fx.panel(spark, sf_dir, "nation")
    res = qa.check_date_continuity(p, "staging_nation").unionByName(qa.check_row_count(p, "staging_nation"))
    return qa.overall_status(res)


@query("q08_structural_validation", o.with_panels(
    "SELECT 'duplicate_keys' AS check_name, CASE WHEN v = 0 THEN 'PASS' ELSE 'WARN' END AS status, CAST(v AS VARCHAR) || ' duplicated (city, time) keys' AS details "
    "FROM (SELECT COUNT(*) AS v FROM (SELECT city, time FROM u GROUP BY 1, 2 HAVING COUNT(*) > 1) d) a UNION ALL "
    "SELECT 'date_gaps', CASE WHEN v = 0 THEN 'PASS' ELSE 'WARN' END, CAST(v AS VARCHAR) || ' cities with missing dates' "
    "FROM (SELECT COUNT(*) FILTER (WHERE d < e) AS v FROM (SELECT city, COUNT(DISTINCT time) AS d, date_diff('day', MIN(time), MAX(time)) + 1 AS e FROM u GROUP BY city) g) b UNION ALL "
    "SELECT 'coordinates_present', CASE WHEN v = 0 THEN 'PASS' ELSE 'WARN' END, CAST(v AS VARCHAR) || ' rows without latitude/longitude' "
    "FROM (SELECT COUNT(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS v FROM u) c",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), u="SELECT * FROM h UNION ALL SELECT * FROM f"))
def q_structural(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    return qa.structural_validation(h.unionByName(f))


@query("q09_report_rule_counts", o.with_panels(
    "SELECT rule, rows, ROUND(rows * 100.0 / n, 6) AS pct FROM (SELECT n, unnest([{'rule': 'extreme', 'rows': extreme}, "
    "{'rule': 'stuck', 'rows': stuck}, {'rule': 'jumps', 'rows': jumps}], recursive := true) FROM ("
    "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE COALESCE(temperature_2m_max > 40 OR temperature_2m_min < -25, false)) AS extreme, "
    "COUNT(*) FILTER (WHERE stuck) AS stuck, COUNT(*) FILTER (WHERE COALESCE(jump > 15, false)) AS jumps FROM ("
    "SELECT temperature_2m_max, temperature_2m_min, jump, COALESCE(COUNT(*) OVER (" + o.W_CITY + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND "
    "SUM(same) OVER (" + o.W_CITY + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2, false) AS stuck FROM ("
    "SELECT city, time, temperature_2m_max, temperature_2m_min, CASE WHEN COALESCE(temperature_2m_mean - LAG(temperature_2m_mean) OVER (" + o.W_CITY + "), 0) = 0 THEN 1 ELSE 0 END AS same, "
    "ABS(temperature_2m_mean - LAG(temperature_2m_mean) OVER (" + o.W_CITY + ")) AS jump FROM p) d) s) a) x",
    p=o.panel("nation")))
def q_rule_counts(spark, sf_dir):
    p = fx.panel(spark, sf_dir, "nation")
    return round_doubles(qa.report_rule_counts(p, fe.stuck_sensor_flag(), fe.jump_size()))
