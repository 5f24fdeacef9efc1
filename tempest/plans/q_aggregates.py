"""Registered queries: aggregations, top-k (D*, F*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx
from tempest.operators import aggregates as ag
from tempest.operators import sketches as sk
from tempest.operators import cleaning as cl
from tempest.plans import oracle as o
from tempest.plans.catalog import query, rnd, round_doubles
from tempest.session import scratch_root
from tempest.sources import fixtures as fx

NAT = o.panel("nation")
REG = o.panel("region")


def _nation(spark, sf_dir):
    return fx.panel(spark, sf_dir, "nation")


@query("d01_avg_tmax_city_year", o.with_panels(
    "SELECT city, CAST(year(time) AS INTEGER) AS year, ROUND(AVG(temperature_2m_max), 2) AS avg_tmax FROM p GROUP BY 1, 2",
    p=NAT))
def q_d01(spark, sf_dir):
    p = _nation(spark, sf_dir)
    return p.groupBy("city", F.year("time").alias("year")).agg(rnd(F.avg("temperature_2m_max"), 2).alias("avg_tmax"))


@query("d02_precip_variance", o.with_panels(
    "SELECT city, ROUND(v, 6) AS precip_var, v = (SELECT MAX(v) FROM g) AS is_highest FROM g",
    p=NAT, g="SELECT city, VAR_SAMP(precipitation_sum) AS v FROM p GROUP BY city"))
def q_d02(spark, sf_dir):
    g = _nation(spark, sf_dir).groupBy("city").agg(F.var_samp("precipitation_sum").alias("v"))
    top = g.select(F.max("v")).scalar()
    return g.select("city", rnd("v").alias("precip_var"), (F.col("v") == top).alias("is_highest"))


@query("d03_dry_days", o.with_panels(
    "SELECT city, CAST(year(time) AS INTEGER) AS year, COUNT(*) FILTER (WHERE precipitation_sum = 0) AS dry_days FROM p GROUP BY 1, 2",
    p=NAT))
def q_d03(spark, sf_dir):
    return (_nation(spark, sf_dir).groupBy("city", F.year("time").alias("year"))
            .agg(F.count_if(F.col("precipitation_sum") == 0).alias("dry_days")))


_DESC_VARS = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum", "wind_speed_10m_max"]


def _describe_sql():
    parts = []
    for v in _DESC_VARS:
        parts.append(
            f"SELECT city, '{v}' AS variable, COUNT({v}) AS count, ROUND(AVG({v}), 6) AS mean, "
            f"ROUND(STDDEV_SAMP({v}), 6) AS std, ROUND(MIN({v}), 6) AS min, ROUND(quantile_cont({v}, 0.25), 6) AS q1, "
            f"ROUND(quantile_cont({v}, 0.5), 6) AS median, ROUND(quantile_cont({v}, 0.75), 6) AS q3, ROUND(MAX({v}), 6) AS max, "
            f"ROUND(skewness({v}), 6) AS skew, ROUND(kurtosis({v}), 6) AS kurtosis FROM p GROUP BY city")
    return " UNION ALL ".join(parts)


@query("d04_describe", o.with_panels(_describe_sql(), p=NAT))
def q_d04(spark, sf_dir):
    return round_doubles(ag.describe(_nation(spark, sf_dir), _DESC_VARS))


@query("d05_yearly_summary_rollup", o.with_panels(
    "SELECT COALESCE(city, 'ALL') AS city, COALESCE(CAST(year(time) AS VARCHAR), 'ALL') AS year, ROUND(AVG(temperature_2m_mean), 6) AS avg_temp, "
    "ROUND(SUM(precipitation_sum), 6) AS total_precip, ROUND(MAX(wind_speed_10m_max), 6) AS max_wind "
    "FROM p GROUP BY ROLLUP (city, year(time))", p=NAT))
def q_d05(spark, sf_dir):
    s = ag.yearly_summary(_nation(spark, sf_dir), totals=True)
    s = s.select(F.coalesce("city", F.lit("ALL")).alias("city"),
                 F.coalesce(F.col("year").cast("string"), F.lit("ALL")).alias("year"),
                 "avg_temp", "total_precip", "max_wind")
    return round_doubles(s)


_PROFILE_VARS = ["temperature_2m_mean", "precipitation_sum", "relative_humidity_2m_mean"]


@query("d06_monthly_profile", o.with_panels(
    " UNION ALL ".join(
        f"SELECT city, CAST(month(time) AS INTEGER) AS month, '{v}' AS variable, ROUND(AVG({v}), 6) AS mean, "
        f"ROUND(STDDEV_SAMP({v}), 6) AS std FROM p GROUP BY 1, 2" for v in _PROFILE_VARS), p=NAT))
def q_d06(spark, sf_dir):
    return round_doubles(ag.monthly_profile(_nation(spark, sf_dir), _PROFILE_VARS))


_NULL_COLS = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum", "wind_speed_10m_max",
              "relative_humidity_2m_mean", "pressure_msl_mean", "rain_sum"]


@query("d07_null_percentages", o.with_panels(
    " UNION ALL ".join(
        f"SELECT city, '{c}' AS column, ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS null_pct FROM p GROUP BY city"
        for c in _NULL_COLS), p=o.nulls("region")))
def q_d07(spark, sf_dir):
    return round_doubles(ag.null_percentages(fx.panel_with_nulls(spark, sf_dir, "region"), _NULL_COLS))


@query("d08_duplicate_keys", o.with_panels(
    "SELECT city, time, COUNT(*) AS n_copies FROM (SELECT city, time FROM h UNION ALL SELECT city, time FROM f) u "
    "GROUP BY city, time HAVING COUNT(*) > 1", h=fx.hist_sql("region"), f=fx.forecast_sql("region")))
def q_d08(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    return ag.duplicate_keys(h.select("city", "time").union(f.select("city", "time")))


@query("d09_coverage", o.with_panels(
    "SELECT city, MIN(time) AS first_date, MAX(time) AS last_date, COUNT(DISTINCT time) AS distinct_days, "
    "CAST(date_diff('day', MIN(time), MAX(time)) + 1 AS INTEGER) AS expected_days, "
    "COUNT(DISTINCT time) < date_diff('day', MIN(time), MAX(time)) + 1 AS has_gaps FROM p GROUP BY city", p=NAT))
def q_d09(spark, sf_dir):
    return ag.coverage(_nation(spark, sf_dir))


_MISSING_SQL = ("SELECT city, CAST(d AS DATE) AS missing_date FROM (SELECT city, unnest(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS d "
                "FROM p GROUP BY city) s WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.city = s.city AND q.time = CAST(s.d AS DATE))")


@query("d10_gap_pattern", o.with_panels(
    "SELECT CAST(year(missing_date) AS INTEGER) AS year, "
    + ", ".join(f"COUNT(*) FILTER (WHERE month(missing_date) = {m}) AS m{m}" for m in range(1, 13))
    + " FROM m GROUP BY 1", p=NAT, m=_MISSING_SQL))
def q_d10(spark, sf_dir):
    return ag.gap_pattern(cl.missing_dates(_nation(spark, sf_dir)))


@query("d10_gap_per_city", o.with_panels(
    "SELECT city, COUNT(*) AS missing_days FROM m GROUP BY city", p=NAT, m=_MISSING_SQL))
def q_d10b(spark, sf_dir):
    return cl.missing_dates(_nation(spark, sf_dir)).groupBy("city").agg(F.count(F.lit(1)).alias("missing_days"))


_CLIM6 = ["temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "precipitation_sum",
          "relative_humidity_2m_mean", "wind_speed_10m_max"]


@query("d11_climatology", o.with_panels(
    "SELECT city, CAST(dayofyear(time) AS INTEGER) AS day_of_year, "
    + ", ".join(f"ROUND(AVG({v}), 6) AS clim_{v}" for v in _CLIM6)
    + " FROM p WHERE year(time) < 2000 GROUP BY 1, 2", p=REG))
def q_d11(spark, sf_dir):
    from tempest.operators.joins import climatology

    p = fx.panel(spark, sf_dir, "region").withColumn("day_of_year", F.dayofyear("time"))
    by_doy, _, _ = climatology(p.filter(F.year("time") < 2000), _CLIM6)
    return round_doubles(by_doy)


_ENERGY_SQL = ("SELECT city, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, "
               "CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, "
               "wind_speed_10m AS Envision_wind_kWh, temperature_2m AS Fuhrlander_wind_kWh, "
               "CASE WHEN is_day = 1 THEN shortwave_radiation END AS Jinko_Solar_kWh, "
               "CASE WHEN is_day = 1 THEN temperature_2m / 2 END AS Trina_Solar_kWh FROM h")


def energy_hourly(spark, sf_dir):
    """Hourly energy stand-in from P_HOURLY (no kWh formulas are invented: columns are the
    hourly series renamed; night hours leave the solar columns null)."""
    h = fx.hourly_panel(spark, sf_dir)
    day = F.col("is_day") == 1
    return h.select("city", F.year("ts").alias("year"), F.month("ts").alias("month"),
                    F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"),
                    F.col("wind_speed_10m").alias("Envision_wind_kWh"),
                    F.col("temperature_2m").alias("Fuhrlander_wind_kWh"),
                    F.when(day, F.col("shortwave_radiation")).alias("Jinko_Solar_kWh"),
                    F.when(day, F.col("temperature_2m") / 2).alias("Trina_Solar_kWh"))


_TARGETS = ("temperature_2m", "wind_speed_10m", "shortwave_radiation")


def energy_document(spark, sf_dir):
    """Energy documents, one per city, and one with the scores of an hour-ahead persistence
    forecast per target (derived from the hourly panel)."""
    hours = energy_hourly(spark, sf_dir)
    row = F.struct(*[c for c in hours.columns if c != "city"])
    cities = hours.groupBy("city").agg(F.collect_list(row).alias("rows")).select(
        F.create_map("city", "rows").alias("locations"))
    w = Window.partitionBy("city").orderBy("ts")
    lagged = fx.hourly_panel(spark, sf_dir).select(*[F.col(c) for c in _TARGETS], *[F.lag(c).over(w).alias(f"l_{c}") for c in _TARGETS])
    scores = []
    for c in _TARGETS:
        y = F.when(F.col(f"l_{c}").isNotNull(), F.col(c))
        sse = F.sum((y - F.col(f"l_{c}")) ** 2)
        scores.append(F.struct(F.lit(c).alias("target"), (1 - sse / (F.count(y) * F.var_pop(y))).alias("test_r2"),
                               F.sqrt(sse / F.count(y)).alias("test_rmse")))
    metrics = lagged.agg(F.array(*scores).alias("model_metrics"))
    return cities.unionByName(metrics, allowMissingColumns=True)


def _score_sql(c, what):
    y, d = f"CASE WHEN l_{c} IS NOT NULL THEN {c} END", f"pow({c} - l_{c}, 2)"
    return f"1 - SUM({d}) / (COUNT({y}) * VAR_POP({y}))" if what == "r2" else f"sqrt(SUM({d}) / COUNT({y}))"


@query("d16_model_metrics", o.with_panels(
    f"SELECT ROUND({_score_sql('temperature_2m', 'r2')}, 6) AS temp_r2, ROUND({_score_sql('temperature_2m', 'rmse')}, 6) AS temp_rmse, "
    f"ROUND({_score_sql('wind_speed_10m', 'r2')}, 6) AS wind_r2, ROUND({_score_sql('wind_speed_10m', 'rmse')}, 6) AS wind_rmse, "
    f"ROUND({_score_sql('shortwave_radiation', 'r2')}, 6) AS solar_r2 FROM l",
    h=fx.hourly_sql(), l="SELECT *, " + ", ".join(f"LAG({c}) OVER (PARTITION BY city ORDER BY ts) AS l_{c}" for c in _TARGETS) + " FROM h"))
def q_model_metrics(spark, sf_dir):
    """Scores read back from the energy documents, one row per document set."""
    from tempest.sources import files

    path = f"{scratch_root(spark)}/energy-{uuid.uuid4().hex[:12]}"
    energy_document(spark, sf_dir).write.json(path)
    _, metrics = files.read_energy_json(spark, path, multi_line=False)
    return round_doubles(ag.pick_model_metrics(metrics))


_ENERGY_DAILY_SQL = ("SELECT city, make_date(year, month, day) AS date, "
                     "ROUND(SUM(COALESCE(Envision_wind_kWh, 0) + COALESCE(Fuhrlander_wind_kWh, 0)), 2) AS wind, "
                     "ROUND(SUM(COALESCE(Jinko_Solar_kWh, 0) + COALESCE(Trina_Solar_kWh, 0)), 2) AS solar, "
                     "ROUND(SUM(COALESCE(Envision_wind_kWh, 0) + COALESCE(Fuhrlander_wind_kWh, 0)) + "
                     "SUM(COALESCE(Jinko_Solar_kWh, 0) + COALESCE(Trina_Solar_kWh, 0)), 2) AS total "
                     "FROM e WHERE year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL GROUP BY city, make_date(year, month, day)")


@query("d13_energy_daily", o.with_panels("SELECT * FROM d", h=fx.hourly_sql(), e=_ENERGY_SQL, d=_ENERGY_DAILY_SQL))
def q_d13(spark, sf_dir):
    return ag.energy_daily(energy_hourly(spark, sf_dir)).select(
        "city", "date", rnd("wind", 2).alias("wind"), rnd("solar", 2).alias("solar"), "total")


@query("d13_energy_totals", o.with_panels(
    "SELECT city, ROUND(SUM(wind), 2) AS total_wind, ROUND(SUM(solar), 2) AS total_solar FROM d GROUP BY city",
    h=fx.hourly_sql(), e=_ENERGY_SQL, d=_ENERGY_DAILY_SQL))
def q_d13b(spark, sf_dir):
    return ag.energy_totals(ag.energy_daily(energy_hourly(spark, sf_dir)))


@query("d14_heat_threshold", o.with_panels(
    "SELECT p.city, ROUND(t.threshold, 6) AS threshold, COUNT(*) FILTER (WHERE p.temperature_2m_max > t.threshold) AS days_above "
    "FROM p JOIN (SELECT city, quantile_cont(temperature_2m_max, 0.9) FILTER (WHERE month(time) IN (6, 7, 8)) AS threshold "
    "FROM p GROUP BY city) t ON p.city = t.city GROUP BY p.city, t.threshold", p=NAT))
def q_d14(spark, sf_dir):
    return round_doubles(ag.heat_threshold(_nation(spark, sf_dir)))


_OUT_COLS = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum", "wind_speed_10m_max"]


@query("d15_outlier_counts", o.with_panels(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT city, '{c}' AS variable, COUNT(*) FILTER (WHERE {c}_outlier_flag) AS outliers FROM f GROUP BY city"
        for c in _OUT_COLS) + ") u WHERE outliers > 0", p=NAT,
    f="SELECT city, " + ", ".join(
        f"COALESCE({c} < quantile_cont({c}, 0.25) OVER (PARTITION BY city) - 1.5 * (quantile_cont({c}, 0.75) OVER (PARTITION BY city) - quantile_cont({c}, 0.25) OVER (PARTITION BY city)) "
        f"OR {c} > quantile_cont({c}, 0.75) OVER (PARTITION BY city) + 1.5 * (quantile_cont({c}, 0.75) OVER (PARTITION BY city) - quantile_cont({c}, 0.25) OVER (PARTITION BY city)), false) AS {c}_outlier_flag"
        for c in _OUT_COLS) + " FROM p"))
def q_d15(spark, sf_dir):
    f = cl.flag_outliers(_nation(spark, sf_dir), _OUT_COLS)
    per = f.groupBy("city").agg(*[F.count_if(f"{c}_outlier_flag").alias(c) for c in _OUT_COLS])
    return (ag.unpivot(per, ["city"], _OUT_COLS, "variable", "outliers").filter(F.col("outliers") > 0))


@query("d17_overall_audit", o.with_panels(
    "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT city) AS cities, MIN(time) AS first_date, MAX(time) AS last_date, "
    "MIN(time) <= DATE '1995-01-01' AND MAX(time) >= DATE '2001-12-31' AS covers_requested, "
    "COUNT(*) - COUNT(temperature_2m_max) AS null_tmax, COUNT(*) - COUNT(precipitation_sum) AS null_precip FROM p",
    p=o.nulls("region")))
def q_d17(spark, sf_dir):
    p = fx.panel_with_nulls(spark, sf_dir, "region")
    return p.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("city").alias("cities"),
                 F.min("time").alias("first_date"), F.max("time").alias("last_date"),
                 ((F.min("time") <= F.lit("1995-01-01").cast("date")) & (F.max("time") >= F.lit("2001-12-31").cast("date")))
                 .alias("covers_requested"),
                 (F.count(F.lit(1)) - F.count("temperature_2m_max")).alias("null_tmax"),
                 (F.count(F.lit(1)) - F.count("precipitation_sum")).alias("null_precip"))


@query("d18_five_number", o.with_panels(
    "SELECT city, COUNT(temperature_2m_max) AS n, ROUND(COALESCE(MIN(temperature_2m_max) FILTER (WHERE temperature_2m_max >= q1 - 1.5 * (q3 - q1)), MIN(temperature_2m_max)), 6) AS whisker_low, "
    "ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(med), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3, "
    "ROUND(COALESCE(MAX(temperature_2m_max) FILTER (WHERE temperature_2m_max <= q3 + 1.5 * (q3 - q1)), MAX(temperature_2m_max)), 6) AS whisker_high "
    "FROM (SELECT city, temperature_2m_max, quantile_cont(temperature_2m_max, 0.25) OVER (PARTITION BY city) AS q1, "
    "quantile_cont(temperature_2m_max, 0.5) OVER (PARTITION BY city) AS med, quantile_cont(temperature_2m_max, 0.75) OVER (PARTITION BY city) AS q3 FROM p) s "
    "GROUP BY city", p=NAT))
def q_d18(spark, sf_dir):
    return round_doubles(ag.five_number(_nation(spark, sf_dir), "temperature_2m_max", "city"))


@query("d18_five_number_skewed", o.with_panels(
    "SELECT city, COUNT(precipitation_sum) AS n, ROUND(COALESCE(MIN(precipitation_sum) FILTER (WHERE precipitation_sum >= q1 - 1.5 * (q3 - q1)), MIN(precipitation_sum)), 6) AS whisker_low, "
    "ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(med), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3, "
    "ROUND(COALESCE(MAX(precipitation_sum) FILTER (WHERE precipitation_sum <= q3 + 1.5 * (q3 - q1)), MAX(precipitation_sum)), 6) AS whisker_high "
    "FROM (SELECT city, precipitation_sum, quantile_cont(precipitation_sum, 0.25) OVER (PARTITION BY city) AS q1, "
    "quantile_cont(precipitation_sum, 0.5) OVER (PARTITION BY city) AS med, quantile_cont(precipitation_sum, 0.75) OVER (PARTITION BY city) AS q3 FROM p) s "
    "GROUP BY city", p=NAT))
def q_d18b(spark, sf_dir):
    return round_doubles(ag.five_number(_nation(spark, sf_dir), "precipitation_sum", "city"))


@query("d19_histogram", o.with_panels(
    "SELECT g.city, CAST(g.bin AS INTEGER) AS bin, COALESCE(c.cnt, 0) AS count, "
    "ROUND(g.mn + (g.bin + 0.5) * ((g.mx - g.mn) / 10), 6) AS bin_centre, "
    "ROUND(CASE WHEN (g.mx - g.mn) / 10 > 0 THEN COALESCE(c.cnt, 0) / (g.n * ((g.mx - g.mn) / 10)) END, 6) AS density "
    "FROM (SELECT city, mn, mx, n, unnest(range(0, 10)) AS bin FROM s) g LEFT JOIN "
    "(SELECT p.city, CASE WHEN (mx - mn) / 10 > 0 THEN LEAST(FLOOR((temperature_2m_mean - mn) / ((mx - mn) / 10)), 9) ELSE 0 END AS bin, COUNT(*) AS cnt "
    "FROM p JOIN s ON p.city = s.city WHERE temperature_2m_mean IS NOT NULL GROUP BY 1, 2) c ON g.city = c.city AND g.bin = c.bin",
    p=NAT, s="SELECT city, MIN(temperature_2m_mean) AS mn, MAX(temperature_2m_mean) AS mx, COUNT(temperature_2m_mean) AS n FROM p GROUP BY city"))
def q_d19(spark, sf_dir):
    return round_doubles(ag.histogram(_nation(spark, sf_dir), "temperature_2m_mean", 10))


@query("d20_distribution_stats", o.with_panels(
    "SELECT city, ROUND(AVG(temperature_2m_mean), 6) AS mean, ROUND(STDDEV_POP(temperature_2m_mean), 6) AS std, "
    "ROUND(AVG(pow(temperature_2m_mean - m, 3)) / pow(STDDEV_POP(temperature_2m_mean), 3), 6) AS skew, COUNT(temperature_2m_mean) AS n, "
    "CASE WHEN ABS(AVG(pow(temperature_2m_mean - m, 3)) / pow(STDDEV_POP(temperature_2m_mean), 3)) < 0.5 THEN 'NORMAL' ELSE 'NOT NORMAL' END AS shape "
    "FROM (SELECT *, AVG(temperature_2m_mean) OVER (PARTITION BY city) AS m FROM p) s GROUP BY city", p=NAT))
def q_d20(spark, sf_dir):
    return round_doubles(ag.distribution_stats(_nation(spark, sf_dir), "temperature_2m_mean"))


def _wmo_case():
    arms = " ".join(f"WHEN weather_code IN ({', '.join(map(str, codes))}) THEN '{label}'"
                    for label, codes in wx.WMO_CATEGORIES)
    return f"CASE {arms} ELSE 'Cloudy' END"


@query("d21_season_category_crosstab", o.with_panels(
    "SELECT " + o.season_case() + " AS season, " + _wmo_case() + " AS weather_category, COUNT(*) AS n FROM p GROUP BY 1, 2",
    p=NAT))
def q_d21(spark, sf_dir):
    p = _nation(spark, sf_dir).select(cal.season(F.month("time")).alias("season"),
                                      wx.weather_category().alias("weather_category"))
    return ag.crosstab_long(p, "season", "weather_category")


@query("d22_extreme_with_date", o.with_panels(
    "SELECT city, ROUND(MAX(temperature_2m_mean), 6) AS max_temperature_2m_mean, "
    "first(time ORDER BY temperature_2m_mean DESC, time ASC) AS date_of_max FROM p GROUP BY city", p=NAT))
def q_d22(spark, sf_dir):
    return round_doubles(ag.extreme_with_date(_nation(spark, sf_dir), "temperature_2m_mean"))


@query("f01_top10_hottest", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean, latitude, longitude FROM p "
    "ORDER BY temperature_2m_mean DESC, city, time LIMIT 10", p=NAT))
def q_f01(spark, sf_dir):
    p = _nation(spark, sf_dir)
    t = ag.top_k(p, [F.col("temperature_2m_mean").desc(), "city", "time"], 10)
    return round_doubles(t.select("city", "time", "temperature_2m_mean", "latitude", "longitude"))


_METRICS = {"hottest": ("temperature_2m_mean", True), "coldest": ("temperature_2m_min", False),
            "wettest": ("precipitation_sum", True), "windiest": ("wind_speed_10m_max", True)}


@query("f02_top10_extremes", o.with_panels(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{lab}' AS metric, city, time, ROUND({c}, 6) AS value FROM p WHERE {c} IS NOT NULL "
        f"ORDER BY {c} {'DESC' if d else 'ASC'}, city, time LIMIT 10)" for lab, (c, d) in _METRICS.items()), p=NAT))
def q_f02(spark, sf_dir):
    return round_doubles(ag.top_k_per_metric(_nation(spark, sf_dir), _METRICS, 10))


@query("f04_last_four_seasons", o.with_panels(
    "SELECT city, season_year, season, CAST(recency AS INTEGER) AS recency FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY season_year DESC, si DESC) AS recency FROM "
    "(SELECT DISTINCT city, CAST(CASE WHEN month(time) IN (1, 2) THEN year(time) - 1 ELSE year(time) END AS INTEGER) AS season_year, "
    "CASE WHEN month(time) IN (12, 1, 2) THEN 'Winter' WHEN month(time) IN (3, 4, 5) THEN 'Spring' WHEN month(time) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, "
    "CASE WHEN month(time) IN (3, 4, 5) THEN 0 WHEN month(time) IN (6, 7, 8) THEN 1 WHEN month(time) IN (9, 10, 11) THEN 2 ELSE 3 END AS si FROM p) b) r "
    "WHERE recency <= 4", p=NAT))
def q_f04(spark, sf_dir):
    return ag.last_season_buckets(_nation(spark, sf_dir), 4)


@query("d07_null_top5", o.with_panels(
    "SELECT \"column\", ROUND(null_pct, 6) AS null_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS null_pct FROM p"
        for c in _NULL_COLS) + ") u ORDER BY null_pct DESC, \"column\" LIMIT 5", p=o.nulls("region")))
def q_d07_top(spark, sf_dir):
    """Overall null share per column, the five largest (the audit's top-5 list)."""
    p = fx.panel_with_nulls(spark, sf_dir, "region")
    overall = p.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in _NULL_COLS])
    long = overall.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_pct"))
                                              for c in _NULL_COLS])).alias("_r")).select("_r.*")
    return round_doubles(ag.top_k(long, [F.col("null_pct").desc(), "column"], 5))


_SKETCH_VARS = ["temperature_2m_max", "precipitation_sum", "wind_speed_10m_max"]


@query("d18_sketched_quartiles", o.with_panels(
    " UNION ALL ".join(
        f"SELECT city, '{c}' AS variable, COUNT({c}) AS n, ROUND(MIN({c}), 6) AS low, ROUND(quantile_disc({c}, 0.25), 6) AS q1, "
        f"ROUND(quantile_disc({c}, 0.5), 6) AS median, ROUND(quantile_disc({c}, 0.75), 6) AS q3, ROUND(quantile_disc({c}, 0.9), 6) AS p90, "
        f"ROUND(MAX({c}), 6) AS high FROM p GROUP BY city" for c in _SKETCH_VARS), p=NAT))
def q_sketched(spark, sf_dir):
    """Quartiles of all years from summaries per city and year, written once and merged; kept
    exact up to 8,192 values a city (``quantile_disc``)."""
    from tempest.session import materialize

    panel = _nation(spark, sf_dir).withColumn("year", F.year("time"))
    stored = materialize(sk.value_sketches(panel, _SKETCH_VARS, accuracy=8192))
    q = sk.quantiles(stored, (0.25, 0.5, 0.75, 0.9))
    return round_doubles(q.select("city", "variable", "n", "low", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("q1", "median", "q3", "p90"))], "high"))
