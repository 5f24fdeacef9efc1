"""Registered queries: serving marts and chart series (L*, E16-E19)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tempest.functions import weather as wx
from tempest.operators import features as fe
from tempest.operators import marts as mt
from tempest.plans import oracle as o
from tempest.plans.catalog import query, round_doubles
from tempest.session import checkpoint_dir
from tempest.sources import files
from tempest.sources import fixtures as fx

W = o.W_CITY
_HCOLS = mt.HISTORY_COLUMNS
_YEARS = list(range(1995, 2002))  # columns of the e18 view


def _hf(spark, sf_dir):
    return fx.hist_and_forecast(spark, sf_dir, "region")


@query("l01_city_latest", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max, latitude, longitude FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY time DESC) AS rn FROM f) s WHERE rn = 1",
    f=fx.forecast_sql("region")))
def q_latest(spark, sf_dir):
    _, f = _hf(spark, sf_dir)
    return round_doubles(mt.city_latest(f))


_HIST_SQL = ("SELECT city, time, " + ", ".join(c for c in _HCOLS if c != "temperature_2m_mean")
             + ", COALESCE(temperature_2m_mean, (temperature_2m_max + temperature_2m_min) / 2.0) AS temperature_2m_mean FROM "
             "(SELECT *, ROW_NUMBER() OVER (PARTITION BY city, time ORDER BY src) AS rn FROM "
             "(SELECT city, time, " + ", ".join(_HCOLS) + ", 1 AS src FROM h WHERE temperature_2m_max IS NOT NULL UNION ALL "
             "SELECT city, time, " + ", ".join(_HCOLS) + ", 2 AS src FROM f WHERE temperature_2m_max IS NOT NULL) u) d WHERE rn = 1")


@query("l02_city_history", o.with_panels(o.rounded_select(_HCOLS, ["city", "time"], "hh"),
                                          h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL))
def q_history(spark, sf_dir):
    h, f = _hf(spark, sf_dir)
    return round_doubles(mt.city_history(h, f).select("city", "time", *_HCOLS))


_IMPACT = ("LEAST(100.0, CASE WHEN temperature_2m_max > 30 THEN (temperature_2m_max - 30) * 3 ELSE 0.0 END "
           "+ CASE WHEN wind_speed_10m_max > 20 THEN (wind_speed_10m_max - 20) * 2 ELSE 0.0 END "
           "+ CASE WHEN relative_humidity_2m_mean > 70 THEN 10.0 ELSE 0.0 END)")


def _wmo_case():
    arms = " ".join(f"WHEN weather_code IN ({', '.join(map(str, codes))}) THEN '{label}'"
                    for label, codes in wx.WMO_CATEGORIES)
    return f"CASE {arms} ELSE 'Cloudy' END"


def forecast_days(spark, sf_dir):
    _, f = _hf(spark, sf_dir)
    return f.select("city", "time", "temperature_2m_max", "temperature_2m_min", "relative_humidity_2m_mean",
                    wx.weather_category().alias("weather_category"), wx.impact_score().alias("impact_score"),
                    fe.persistence_alert_level().alias("persistence_alert_level"))


@query("l03_city_forecast_json", o.with_panels(
    "SELECT city, time AS date, ROUND(temperature_2m_max, 6) AS temp_max, ROUND(temperature_2m_min, 6) AS temp_min, "
    "ROUND(relative_humidity_2m_mean, 6) AS humidity, " + _wmo_case() + " AS condition, ROUND(" + _IMPACT + ", 6) AS impact, "
    "CAST(CASE WHEN ROW_NUMBER() OVER (" + W + ") >= 3 THEN SUM(CASE WHEN temperature_2m_max > 35 THEN 1 ELSE 0 END) "
    "OVER (" + W + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS alert, "
    "ROW_NUMBER() OVER (" + W + ") = 1 AS is_headline FROM f", f=fx.forecast_sql("region")))
def q_forecast_json(spark, sf_dir):
    """Forecast documents written as JSON lines, read back with the document reader."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/forecast-json-{uuid.uuid4().hex[:12]}"
    mt.forecast_documents(forecast_days(spark, sf_dir)).write.json(path)
    days = files.read_forecast_json(spark, path, multi_line=False)
    return round_doubles(mt.city_forecast(days))


_NAT_FC = (f"SELECT * FROM ({o.panel('nation')}) n WHERE time >= (SELECT MAX(time) FROM ({o.panel('nation')}) m) "
           f"- INTERVAL {fx.FORECAST_DAYS - 1} DAY")


@query("l05_history_fallback", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean FROM hh "
    "UNION ALL SELECT city, time, ROUND(temperature_2m_max, 6), ROUND(CASE WHEN COALESCE(temperature_2m_max <> 0 AND temperature_2m_min <> 0, false) "
    "THEN ROUND((temperature_2m_max + temperature_2m_min) / 2, 1) END, 6) FROM nf WHERE city NOT IN (SELECT city FROM hh)",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL, nf=_NAT_FC))
def q_fallback(spark, sf_dir):
    h, f = _hf(spark, sf_dir)
    hist = mt.city_history(h, f)
    nat = fx.panel(spark, sf_dir, "nation")
    end = nat.select(F.max("time")).scalar()
    nf = nat.filter(F.col("time") >= F.date_sub(end, fx.FORECAST_DAYS - 1)).withColumnRenamed("time", "date")
    out = mt.history_fallback(hist, nf)
    return round_doubles(out.select("city", "time", "temperature_2m_max", "temperature_2m_mean"))


_BUCKETS = ("SELECT city, season_year, season, ROW_NUMBER() OVER (PARTITION BY city ORDER BY season_year DESC, si DESC) AS recency FROM "
            "(SELECT DISTINCT city, CAST(CASE WHEN month(time) IN (1, 2) THEN year(time) - 1 ELSE year(time) END AS INTEGER) AS season_year, "
            "CASE WHEN month(time) IN (12, 1, 2) THEN 'Winter' WHEN month(time) IN (3, 4, 5) THEN 'Spring' WHEN month(time) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, "
            "CASE WHEN month(time) IN (3, 4, 5) THEN 0 WHEN month(time) IN (6, 7, 8) THEN 1 WHEN month(time) IN (9, 10, 11) THEN 2 ELSE 3 END AS si FROM hh "
            "WHERE temperature_2m_max IS NOT NULL) b")
_KEPT = ("SELECT v.* FROM (SELECT city, temperature_2m_max AS x, CAST(CASE WHEN month(time) IN (1, 2) THEN year(time) - 1 ELSE year(time) END AS INTEGER) AS season_year, "
         "CASE WHEN month(time) IN (12, 1, 2) THEN 'Winter' WHEN month(time) IN (3, 4, 5) THEN 'Spring' WHEN month(time) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season "
         "FROM hh WHERE temperature_2m_max IS NOT NULL) v JOIN bk ON v.city = bk.city AND v.season_year = bk.season_year AND v.season = bk.season AND bk.recency <= 4")


@query("l06_seasonal_box", o.with_panels(
    "SELECT city, season_year, season, COUNT(x) AS n, ROUND(COALESCE(MIN(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), MIN(x)), 6) AS whisker_low, "
    "ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(med), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3, "
    "ROUND(COALESCE(MAX(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), MAX(x)), 6) AS whisker_high FROM "
    "(SELECT *, quantile_cont(x, 0.25) OVER g AS q1, quantile_cont(x, 0.5) OVER g AS med, quantile_cont(x, 0.75) OVER g AS q3 FROM kept "
    "WINDOW g AS (PARTITION BY city, season_year, season)) s GROUP BY city, season_year, season",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL, bk=_BUCKETS, kept=_KEPT))
def q_box(spark, sf_dir):
    h, f = _hf(spark, sf_dir)
    return round_doubles(mt.seasonal_box(mt.city_history(h, f)))


_BOX_KRUSKAL = (
    "SELECT city, N, k, ROUND(12.0 / (N * (N + 1)) * s - 3 * (N + 1), 6) AS H, k - 1 AS dof FROM "
    "(SELECT city, CAST(SUM(ng) AS BIGINT) AS N, SUM(R * R / ng) AS s, COUNT(*) AS k FROM (SELECT city, season_year, season, SUM(r) AS R, COUNT(*) AS ng FROM "
    "(SELECT *, RANK() OVER (PARTITION BY city ORDER BY x) + (COUNT(*) OVER (PARTITION BY city, x) - 1) / 2.0 AS r FROM kept) a "
    "GROUP BY 1, 2, 3) g GROUP BY city) t WHERE k >= 2")
_BOX_PANELS = dict(h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL, bk=_BUCKETS, kept=_KEPT)


@query("l06_seasonal_kruskal", o.with_panels(_BOX_KRUSKAL, **_BOX_PANELS))
def q_box_kw(spark, sf_dir):
    h, f = _hf(spark, sf_dir)
    return round_doubles(mt.seasonal_kruskal(mt.city_history(h, f)))


_DECOMP_SQL = (
    "SELECT city, time, ROUND(obs, 6) AS obs, ROUND(trend, 6) AS trend, ROUND(seasonal, 6) AS seasonal, "
    "ROUND(CASE WHEN obs IS NOT NULL AND trend IS NOT NULL AND seasonal IS NOT NULL THEN obs - trend - seasonal END, 6) AS residual FROM "
    "(SELECT *, AVG(obs - trend) OVER (PARTITION BY city, dayofyear(time)) AS seasonal FROM "
    "(SELECT b2.city, b2.time, b2.obs, CASE WHEN b2.i > half AND b2.i <= n - half AND hi.C - COALESCE(lo.C, 0) > 0 "
    "THEN (hi.S - COALESCE(lo.S, 0)) / (hi.C - COALESCE(lo.C, 0)) END AS trend FROM b2 "
    "LEFT JOIN pref hi ON hi.city = b2.city AND hi.j = b2.i + half LEFT JOIN pref lo ON lo.city = b2.city AND lo.j = b2.i - half - 1) t) s")


@query("e17_decomposition", o.with_panels(
    _DECOMP_SQL, p=o.panel("region"),
    base="SELECT city, time, COALESCE(temperature_2m_mean, temperature_2m_max) AS obs, ROW_NUMBER() OVER (" + W + ") AS i, "
         "COUNT(*) OVER (PARTITION BY city) AS n FROM p",
    b2="SELECT *, FLOOR(LEAST(365, GREATEST(7, FLOOR(n / 2))) / 2) AS half FROM base",
    pref="SELECT city, i AS j, SUM(obs) OVER (" + W + " ROWS UNBOUNDED PRECEDING) AS S, COUNT(obs) OVER (" + W + " ROWS UNBOUNDED PRECEDING) AS C FROM base"))
def q_decomp(spark, sf_dir):
    return round_doubles(mt.decomposition(fx.panel(spark, sf_dir, "region")))


@query("e17_decomposition_short_series", o.with_panels(
    _DECOMP_SQL, p="SELECT * FROM (" + o.panel("nation") + ") n WHERE time >= DATE '2001-01-01'",
    base="SELECT city, time, COALESCE(temperature_2m_mean, temperature_2m_max) AS obs, ROW_NUMBER() OVER (" + W + ") AS i, "
         "COUNT(*) OVER (PARTITION BY city) AS n FROM p",
    b2="SELECT *, FLOOR(LEAST(365, GREATEST(7, FLOOR(n / 2))) / 2) AS half FROM base",
    pref="SELECT city, i AS j, SUM(obs) OVER (" + W + " ROWS UNBOUNDED PRECEDING) AS S, COUNT(obs) OVER (" + W + " ROWS UNBOUNDED PRECEDING) AS C FROM base"))
def q_decomp_short(spark, sf_dir):
    """Series shorter than two years: the period shrinks to n // 2 per city."""
    p = fx.panel(spark, sf_dir, "nation").filter(F.col("time") >= F.lit("2001-01-01").cast("date"))
    return round_doubles(mt.decomposition(p))


@query("e18_year_over_year", o.with_panels(
    "SELECT city, CAST(dayofyear(time) AS INTEGER) AS day_of_year, "
    + ", ".join(f"ROUND(arg_max(COALESCE(temperature_2m_mean, temperature_2m_max), time) FILTER (WHERE year(time) = {y}), 6) AS y{y}"
                for y in _YEARS) + " FROM p WHERE dayofyear(time) <= 365 GROUP BY 1, 2", p=o.panel("nation")))
def q_yoy(spark, sf_dir):
    return round_doubles(mt.yoy_matrix(fx.panel(spark, sf_dir, "nation"), _YEARS))


@query("e18_year_over_year_long", o.with_panels(
    "SELECT city, CAST(dayofyear(time) AS INTEGER) AS day_of_year, CAST(year(time) AS INTEGER) AS year, "
    "ROUND(arg_max(COALESCE(temperature_2m_mean, temperature_2m_max), time), 6) AS value "
    "FROM p WHERE dayofyear(time) <= 365 GROUP BY 1, 2, 3", p=o.panel("nation")))
def q_yoy_long(spark, sf_dir):
    return round_doubles(mt.yoy_long(fx.panel(spark, sf_dir, "nation")))


@query("e19_calendar_heatmap", o.with_panels(
    "SELECT city, year, day_of_year, ROUND(value, 6) AS value, ROUND((value - MIN(value) OVER (PARTITION BY city)) / "
    "CASE WHEN MAX(value) OVER (PARTITION BY city) - MIN(value) OVER (PARTITION BY city) <> 0 THEN MAX(value) OVER (PARTITION BY city) - MIN(value) OVER (PARTITION BY city) ELSE 1.0 END, 6) AS scaled FROM "
    "(SELECT city, CAST(year(time) AS INTEGER) AS year, CAST(dayofyear(time) AS INTEGER) AS day_of_year, arg_max(temperature_2m_mean, time) AS value "
    "FROM p WHERE temperature_2m_mean IS NOT NULL GROUP BY 1, 2, 3) c", p=o.panel("nation")))
def q_heatmap(spark, sf_dir):
    return round_doubles(mt.calendar_heatmap(fx.panel(spark, sf_dir, "nation")))


@query("e16_doy_smoothing", o.with_panels(
    "SELECT g.city, g.year, g.day_of_year, ROUND(c.value, 6) AS value, ROUND(AVG(c.value) OVER (PARTITION BY g.city, g.year ORDER BY g.day_of_year "
    "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM "
    "(SELECT city, year, CAST(unnest(range(1, 366)) AS INTEGER) AS day_of_year FROM (SELECT DISTINCT city, year FROM v) y) g "
    "LEFT JOIN (SELECT city, year, day_of_year, arg_max(x, time) AS value FROM v GROUP BY 1, 2, 3) c "
    "ON g.city = c.city AND g.year = c.year AND g.day_of_year = c.day_of_year",
    p=o.panel("nation"),
    v="SELECT city, CAST(year(time) AS INTEGER) AS year, CAST(dayofyear(time) AS INTEGER) AS day_of_year, temperature_2m_max AS x, time "
      "FROM p WHERE dayofyear(time) <= 365"))
def q_smooth(spark, sf_dir):
    return round_doubles(mt.doy_smoothing(fx.panel(spark, sf_dir, "nation")))


@query("l08_recent_history", o.with_panels(
    o.rounded_select(_HCOLS, ["city", "time"], "hh") + " WHERE time >= DATE '2001-01-01'",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL))
def q_recent(spark, sf_dir):
    h, f = _hf(spark, sf_dir)
    hist = mt.city_history(h, f).filter(F.col("time") >= F.lit("2001-01-01").cast("date"))
    return round_doubles(hist.select("city", "time", *_HCOLS))


@query("l06_seasonal_kruskal_p_value", o.with_panels(
    f"SELECT city, N, k, H, dof, ROUND({o.gamma_q('dof / 2.0', 'H / 2.0')}, 6) AS p FROM kw", **_BOX_PANELS, kw=_BOX_KRUSKAL))
def q_box_kw_p(spark, sf_dir):
    from tempest.operators.stats import with_p_value

    h, f = _hf(spark, sf_dir)
    return round_doubles(with_p_value(mt.seasonal_kruskal(mt.city_history(h, f)), "kruskal"))


@query("r04_published_history_mart", o.with_panels(o.rounded_select(_HCOLS, ["city", "time"], "hh"),
                                                    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL))
def q_published(spark, sf_dir):
    """Store the raw layers, publish every mart from them, read the history mart back."""
    from tempest.plans.publish import publish_from_frames

    h, f = _hf(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/publish-{uuid.uuid4().hex[:12]}"
    paths = publish_from_frames(spark, base, h, f)
    return round_doubles(spark.read.parquet(paths["city_history"]).select("city", "time", *_HCOLS))


# every published mart against its own query's SQL, over the same raw layers
_PUBLISHED = {
    "city_latest": "SELECT COUNT(*) AS rows, ROUND(SUM(temperature_2m_max), 4) AS total FROM (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY city ORDER BY time DESC) = 1) x",
    "city_forecast": "SELECT COUNT(*), ROUND(SUM(temperature_2m_max), 4) FROM f",
    "city_history": "SELECT COUNT(*), ROUND(SUM(temperature_2m_max), 4) FROM hh",
    "city_history_or_forecast": "SELECT COUNT(*), ROUND(SUM(temperature_2m_max), 4) FROM hh",
    "qq_points": "SELECT COUNT(*), ROUND(SUM(temperature_2m_max), 4) FROM hh",
    "scatter_sample": "SELECT COUNT(*), ROUND(SUM(temperature_2m_max), 4) FROM (SELECT * FROM hh QUALIFY (ROW_NUMBER() OVER (PARTITION BY city ORDER BY time) - 1) % 5 = 0) x",
    "autocorrelation": "SELECT 40 * COUNT(DISTINCT city), ROUND(SUM(40 * n), 4) FROM (SELECT city, 1.96 / sqrt(COUNT(*)) AS n FROM hh GROUP BY city) x",
    "year_over_year": "SELECT COUNT(*), ROUND(SUM(v), 4) FROM (SELECT arg_max(COALESCE(temperature_2m_mean, temperature_2m_max), time) AS v FROM hh WHERE dayofyear(time) <= 365 GROUP BY city, year(time), dayofyear(time)) x",
    "calendar_heatmap": "SELECT COUNT(*), ROUND(SUM(v), 4) FROM (SELECT arg_max(temperature_2m_mean, time) AS v FROM hh WHERE temperature_2m_mean IS NOT NULL GROUP BY city, year(time), dayofyear(time)) x",
    "decomposition": "SELECT COUNT(*), ROUND(SUM(COALESCE(temperature_2m_mean, temperature_2m_max)), 4) FROM hh",
    "city_energy_totals": "SELECT COUNT(DISTINCT city), 0.0 FROM h2",
}
_SUM_OF = {"city_forecast": "temp_max", "qq_points": "sample", "autocorrelation": "band", "year_over_year": "value",
           "calendar_heatmap": "value", "decomposition": "obs"}


@query("r05_published_marts", o.with_panels(
    " UNION ALL ".join(f"SELECT '{name}' AS mart, rows, total FROM ({sql}) q_{name}(rows, total)" for name, sql in _PUBLISHED.items()),
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), hh=_HIST_SQL, h2=fx.hourly_sql()))
def q_all_published(spark, sf_dir):
    """Rows and a column total of every published mart, read back from its folder."""
    from tempest.plans.publish import publish_from_frames
    from tempest.plans.q_aggregates import energy_document

    h, f = _hf(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/publish-{uuid.uuid4().hex[:12]}"
    energy_document(spark, sf_dir).write.json(f"{base}/energy")
    paths, out = publish_from_frames(spark, base, h, f, f"{base}/energy"), None
    for name in _PUBLISHED:
        total = F.lit(0.0) if name == "city_energy_totals" else F.sum(_SUM_OF.get(name, "temperature_2m_max"))
        row = spark.read.parquet(paths[name]).agg(F.count(F.lit(1)).alias("rows"), total.alias("total")).select(F.lit(name).alias("mart"), "rows", "total")
        out = row if out is None else out.unionByName(row)
    return round_doubles(out, 4)
