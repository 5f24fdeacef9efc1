"""Registered queries: projections, filters and scalar derivations (B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx
from tempest.operators import features as fe
from tempest.plans import oracle as o
from tempest.plans.catalog import query, round_doubles
from tempest.sources import fixtures as fx

NAT = o.panel("nation")


def _nation(spark, sf_dir):
    return fx.panel(spark, sf_dir, "nation")


@query("b01_calendar", o.with_panels(
    "SELECT city, time, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, "
    "CAST(day(time) AS INTEGER) AS day, CAST(quarter(time) AS INTEGER) AS quarter, "
    "CAST(dayofyear(time) AS INTEGER) AS day_of_year, " + o.season_case() + " AS season, "
    "CASE WHEN month(time) IN (12, 1, 2) THEN 'Winter' WHEN month(time) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month(time) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season_us, "
    "CAST(CASE WHEN month(time) IN (1, 2) THEN year(time) - 1 ELSE year(time) END AS INTEGER) AS season_year, "
    "CAST(isodow(time) IN (6, 7) AS INTEGER) AS is_weekend, "
    "ROUND(sin(2 * pi() * dayofyear(time) / 365.25), 6) AS doy_sin, "
    "ROUND(cos(2 * pi() * dayofyear(time) / 365.25), 6) AS doy_cos, "
    "CAST(year(time) * 10000 + month(time) * 100 + day(time) AS INTEGER) AS date_ord FROM p", p=NAT))
def q_calendar(spark, sf_dir):
    p = _nation(spark, sf_dir)
    doy = F.dayofyear("time")
    return round_doubles(p.select(
        "city", "time", *cal.calendar_columns(),
        cal.season(F.month("time")).alias("season"),
        cal.season(F.month("time"), cal.LABELS_US).alias("season_us"),
        cal.season_year().alias("season_year"), cal.is_weekend().alias("is_weekend"),
        *cal.doy_harmonics(doy), cal.date_ord().alias("date_ord")))


def _pos(x):
    return f"CASE WHEN {x} IS NOT NULL THEN GREATEST({x}, 0.0) END"


@query("b07_weather_indices", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max - temperature_2m_min, 6) AS temperature_range, "
    f"ROUND({_pos('18.0 - temperature_2m_mean')}, 6) AS HDD, ROUND({_pos('temperature_2m_mean - 18.0')}, 6) AS CDD, "
    "COALESCE(CAST(precipitation_sum > 0 AS INTEGER), 0) AS is_rainy, "
    "COALESCE(CAST(snowfall_sum > 0 AS INTEGER), 0) AS is_snowy, "
    "COALESCE(CAST(weather_code = 0 AS INTEGER), 0) AS is_clear, "
    "COALESCE(CAST(precipitation_sum > 0 AS INTEGER), 0) AS will_rain, "
    "ROUND(CASE WHEN precipitation_sum <> 0 THEN rain_sum / precipitation_sum END, 6) AS rain_ratio, "
    "ROUND(CASE WHEN precipitation_sum <> 0 THEN snowfall_sum / precipitation_sum END, 6) AS snow_ratio, "
    "ROUND(temperature_2m_max * (relative_humidity_2m_mean / 100), 6) AS heat_stress_linear, "
    "ROUND(temperature_2m_mean * (1 + pow(relative_humidity_2m_mean / 100, 2)), 6) AS heat_stress_quadratic, "
    "ROUND(LEAST(100.0, CASE WHEN temperature_2m_max > 30 THEN (temperature_2m_max - 30) * 3 ELSE 0.0 END "
    "+ CASE WHEN wind_speed_10m_max > 20 THEN (wind_speed_10m_max - 20) * 2 ELSE 0.0 END "
    "+ CASE WHEN relative_humidity_2m_mean > 70 THEN 10.0 ELSE 0.0 END), 6) AS impact_score, "
    "ROUND(temperature_2m_max * wind_speed_10m_max, 6) AS wind_temp_interaction, "
    f"ROUND({_pos('temperature_2m_max - 35.0')}, 6) AS extreme_heat_excess FROM p", p=NAT))
def q_indices(spark, sf_dir):
    p = _nation(spark, sf_dir)
    return round_doubles(p.select(
        "city", "time", wx.temperature_range().alias("temperature_range"),
        wx.heating_degree_days().alias("HDD"), wx.cooling_degree_days().alias("CDD"),
        wx.flag_positive("precipitation_sum").alias("is_rainy"),
        wx.flag_positive("snowfall_sum").alias("is_snowy"),
        wx.flag_equals("weather_code", 0).alias("is_clear"),
        wx.flag_positive("precipitation_sum").alias("will_rain"),
        wx.safe_ratio("rain_sum", "precipitation_sum").alias("rain_ratio"),
        wx.safe_ratio("snowfall_sum", "precipitation_sum").alias("snow_ratio"),
        wx.heat_stress_linear().alias("heat_stress_linear"),
        wx.heat_stress_quadratic().alias("heat_stress_quadratic"),
        wx.impact_score().alias("impact_score"),
        wx.wind_temp_interaction().alias("wind_temp_interaction"),
        wx.extreme_heat_excess(threshold=35.0).alias("extreme_heat_excess")))


def _wmo_case(col="weather_code"):
    arms = " ".join(f"WHEN {col} IN ({', '.join(map(str, codes))}) THEN '{label}'"
                    for label, codes in wx.WMO_CATEGORIES)
    return f"CASE {arms} ELSE '{wx.WMO_DEFAULT}' END"


def _condition_case(col):
    labels = ", ".join(f"'{x}'" for x in wx.CONDITION_LABELS)
    arms = [f"WHEN {col} IS NULL THEN 'Cloudy'", f"WHEN {col} IN ({labels}) THEN {col}"]
    for subs, label in wx.CONDITION_RULES:
        cond = " OR ".join(f"contains(lower({col}), '{s}')" for s in subs)
        arms.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(arms) + " ELSE 'Cloudy' END"


_IMPACT_SQL = ("LEAST(100.0, CASE WHEN temperature_2m_max > 30 THEN (temperature_2m_max - 30) * 3 ELSE 0.0 END "
               "+ CASE WHEN wind_speed_10m_max > 20 THEN (wind_speed_10m_max - 20) * 2 ELSE 0.0 END "
               "+ CASE WHEN relative_humidity_2m_mean > 70 THEN 10.0 ELSE 0.0 END)")


@query("b16_labels", o.with_panels(
    "SELECT city, time, weather_category, " + _condition_case("weather_category") + " AS icon_group, "
    + _condition_case("'Heavy ' || weather_category") + " AS icon_group_free_text, "
    "CASE WHEN impact IS NULL THEN 'unknown' WHEN impact >= 70 THEN 'high' WHEN impact >= 40 THEN 'medium' ELSE 'low' END AS impact_band, "
    "COALESCE(level > 0, false) AS alert FROM (SELECT city, time, CASE WHEN ROW_NUMBER() OVER (PARTITION BY city ORDER BY time) >= 3 THEN "
    "SUM(CASE WHEN temperature_2m_max > 35 THEN 1 ELSE 0 END) OVER (PARTITION BY city ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS level, "
    + _wmo_case() + " AS weather_category, " + _IMPACT_SQL + " AS impact FROM p) s", p=NAT))
def q_labels(spark, sf_dir):
    p = _nation(spark, sf_dir).select(
        "city", "time", wx.weather_category().alias("weather_category"),
        wx.impact_score().alias("impact"), fe.persistence_alert_level().alias("persistence_alert_level"))
    return p.select("city", "time", "weather_category", wx.persistence_alert().alias("alert"),
                    wx.condition_group("weather_category").alias("icon_group"),
                    wx.condition_group(F.concat(F.lit("Heavy "), F.col("weather_category")))
                    .alias("icon_group_free_text"),
                    wx.impact_band("impact").alias("impact_band"))


@query("b19_column_aliases", o.with_panels(
    "SELECT city, time, weather_code AS weathercode, ROUND(wind_speed_10m_max, 6) AS windspeed_10m_max, "
    "ROUND(cloud_cover_mean, 6) AS cloudcover_mean FROM p", p=NAT))
def q_aliases(spark, sf_dir):
    p = wx.add_column_aliases(_nation(spark, sf_dir))
    return round_doubles(p.select("city", "time", "weathercode", "windspeed_10m_max", "cloudcover_mean"))


def _initcap_sql(x):
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


@query("b20_canonical_city", o.with_panels(
    "SELECT raw_name, city FROM (SELECT raw_name, " + _initcap_sql("trim(raw_name)") + " AS city FROM "
    "(SELECT DISTINCT '  ' || lower(r_name) || ' ' AS raw_name FROM region UNION ALL "
    " SELECT DISTINCT n_name AS raw_name FROM nation) n) s "
    "WHERE city IN (SELECT " + _initcap_sql("r_name") + " FROM region UNION ALL SELECT "
    + _initcap_sql("n_name") + " FROM nation)"))
def q_canonical(spark, sf_dir):
    reg = fx.table(spark, sf_dir, "region")
    nat = fx.table(spark, sf_dir, "nation")
    raw = (reg.select(F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")).alias("raw_name")).distinct()
           .unionByName(nat.select(F.col("n_name").alias("raw_name")).distinct()))
    known = (reg.select(F.initcap("r_name").alias("city"))
             .unionByName(nat.select(F.initcap("n_name").alias("city"))))
    named = raw.select("raw_name", wx.canonical_city("raw_name").alias("city"))
    return named.join(F.broadcast(known), "city", "left_semi").select("raw_name", "city")


@query("b21_numeric_coercion",
       "SELECT event_id, TRY_CAST(props AS DOUBLE) AS props_num, "
       "TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS user_num FROM events")
def q_coerce(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select("event_id", wx.coerce_double("props").alias("props_num"),
                     wx.coerce_double(F.col("user_id").cast("string")).alias("user_num"))


@query("b22_mean_fallback", o.with_panels(
    "SELECT city, time, ROUND(COALESCE(temperature_2m_mean, (temperature_2m_max + temperature_2m_min) / 2), 6) AS temp_mean FROM p",
    p=o.nulls("region")))
def q_mean_fallback(spark, sf_dir):
    p = fx.panel_with_nulls(spark, sf_dir, "region")
    return round_doubles(p.select("city", "time", wx.mean_temperature_fallback().alias("temp_mean")))


@query("b23_range_filters", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max FROM p "
    "WHERE year(time) BETWEEN 1996 AND 1998 AND month(time) IN (6, 7, 8) "
    "AND time BETWEEN DATE '1996-03-15' AND DATE '1998-09-20' AND lower(city) IN ('nation_1', 'nation_7', 'nation_19')",
    p=NAT))
def q_filters(spark, sf_dir):
    from tempest.operators.loading import filter_cities

    p = filter_cities(_nation(spark, sf_dir), ["NATION_1", "Nation_7", "nation_19"])
    p = p.filter(F.year("time").between(1996, 1998) & F.month("time").isin(6, 7, 8)
                 & F.col("time").between(F.lit("1996-03-15").cast("date"), F.lit("1998-09-20").cast("date")))
    return round_doubles(p.select("city", "time", "temperature_2m_max"))


@query("b24_extreme_rules", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max, temperature_2m_max > 38 AS hot_day, "
    "temperature_2m_max > 40 OR temperature_2m_min < -25 AS report_rule, "
    "CASE WHEN temperature_2m_max > 30 THEN 'High' ELSE 'Normal' END AS risk FROM p "
    "WHERE temperature_2m_max > 38 OR temperature_2m_max > 40 OR temperature_2m_min < -25", p=NAT))
def q_extremes(spark, sf_dir):
    p = _nation(spark, sf_dir)
    hot = F.col("temperature_2m_max") > 38
    rule = (F.col("temperature_2m_max") > 40) | (F.col("temperature_2m_min") < -25)
    return round_doubles(p.filter(hot | rule).select(
        "city", "time", "temperature_2m_max", hot.alias("hot_day"), rule.alias("report_rule"),
        F.when(F.col("temperature_2m_max") > 30, "High").otherwise("Normal").alias("risk")))


@query("b25_drop_null_rows", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean, "
    "ROUND(precipitation_sum, 6) AS precipitation_sum FROM p "
    "WHERE temperature_2m_mean IS NOT NULL AND precipitation_sum IS NOT NULL", p=o.nulls("region")))
def q_dropna(spark, sf_dir):
    p = fx.panel_with_nulls(spark, sf_dir, "region").na.drop(subset=["temperature_2m_mean", "precipitation_sum"])
    return round_doubles(p.select("city", "time", "temperature_2m_mean", "precipitation_sum"))


@query("b26_city_search", o.with_panels(
    "SELECT DISTINCT city FROM p WHERE contains(lower(city), 'ion_1')", p=NAT))
def q_search(spark, sf_dir):
    return _nation(spark, sf_dir).filter(wx.city_search("city", "ION_1")).select("city").distinct()
