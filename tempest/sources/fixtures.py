"""Weather-shaped panels derived from the driver's TPC-H-like tables.

Every measure is an integer sum with at most one division, so Spark and the SQL oracle
start from bit-equal doubles. Each panel has a Spark builder and the same definition as
SQL text (used by ``plans.catalog`` as a CTE for the oracle).

Scale notes: ``nation`` and ``region`` are fixed-size (25 / 5 rows) and broadcast;
``supplier`` grows with the scale factor and is joined without a hint, so Catalyst/AQE
pick broadcast only when its measured size is under the threshold. The daily group-by
does a partial aggregation before the shuffle, so a hot (city, day) key is combined
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The WMO codes that slots 0..8 of the fixture stand for.
WMO_CODE_BY_SLOT = [0, 2, 45, 53, 61, 71, 80, 95, 99]

# Synthetic coordinates of the fixture cities: key k -> (36 + k/4, 44 + k/2 + k^2/8) degrees
# (longitude not linear in latitude, so coordinates are not collinear model features).
LAT_BASE, LAT_STEP, LON_BASE, LON_STEP, LON_CURVE = 36.0, 0.25, 44.0, 0.5, 0.125


def lon_of(key):
    return F.lit(LON_BASE) + key * LON_STEP + key * key * LON_CURVE


def lon_sql(key: str) -> str:
    return f"{LON_BASE} + {key} * {LON_STEP} + {key} * {key} * {LON_CURVE}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _located_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus",
        "l_tax", "l_discount", "l_extendedprice", "l_linenumber")
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # fact x supplier first: the planner sizes supplier from its files (broadcast while small,
    # sort-merge beyond the threshold); nation and region are fixed-size and broadcast after.
    # Joining the dimensions first would make the planner multiply their size estimates.
    return (li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))


def _daily_measures():
    n = F.count(F.lit(1))
    ret = F.col("l_returnflag") == "R"
    tax_pct = F.round(F.col("l_tax") * 100).cast("int")
    return [
        F.max("l_quantity").alias("temperature_2m_max"),
        F.min("l_quantity").alias("temperature_2m_min"),
        (F.sum(F.col("l_quantity").cast("int")).cast("double") / n).alias("temperature_2m_mean"),
        F.sum(F.when(ret, tax_pct).otherwise(0)).cast("double").alias("precipitation_sum"),
        F.sum(F.when(ret & (F.col("l_linestatus") == "O"), tax_pct).otherwise(0))
         .cast("double").alias("rain_sum"),
        (F.max(F.round(F.col("l_discount") * 100).cast("int")) * 4).cast("double")
         .alias("wind_speed_10m_max"),
        (F.sum(F.round(F.col("l_tax") * 1250).cast("int")).cast("double") / n)
         .alias("relative_humidity_2m_mean"),
        (F.lit(1000) + F.sum(F.round(F.col("l_discount") * 300).cast("int")).cast("double") / n)
         .alias("pressure_msl_mean"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / 1000000)
         .alias("shortwave_radiation_sum"),
        (F.sum("l_linenumber") % 9).cast("int").alias("code_slot"),
    ]


def _complete(df: DataFrame, key: str) -> DataFrame:
    """Derive the remaining raw columns so the panel has the full 18-column schema."""
    code = F.lit(None).cast("int")
    for slot in reversed(range(len(WMO_CODE_BY_SLOT))):
        code = F.when(F.col("code_slot") == slot, F.lit(WMO_CODE_BY_SLOT[slot])).otherwise(code)
    winter = F.month("time").isin(12, 1, 2)
    return df.select(
        "city", "time",
        (F.lit(LAT_BASE) + F.col(key) * LAT_STEP).alias("latitude"),
        lon_of(F.col(key)).alias("longitude"),
        "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
        (F.col("temperature_2m_max") + (F.col("relative_humidity_2m_mean") - 50) / 20)
        .alias("apparent_temperature_max"),
        "precipitation_sum", "rain_sum",
        F.when(winter, F.col("precipitation_sum") - F.col("rain_sum")).otherwise(F.lit(0.0))
        .alias("snowfall_sum"),
        "wind_speed_10m_max",
        (F.col("wind_speed_10m_max") * 3 / 2).alias("wind_gusts_10m_max"),
        "relative_humidity_2m_mean",
        (F.lit(100) - F.col("relative_humidity_2m_mean")).alias("cloud_cover_mean"),
        "pressure_msl_mean", "shortwave_radiation_sum",
        code.alias("weather_code"),
    )


def panel(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    """Daily panel keyed (city, time). ``grain`` = 'region' (5 dense series) or 'nation' (25 gappy)."""
    name, key = {"region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_nationkey")}[grain]
    daily = (_located_lines(spark, sf_dir)
             .groupBy(F.col(name).alias("city"), F.col(key).alias("city_key"),
                      F.to_date("l_shipdate").alias("time"))
             .agg(*_daily_measures()))
    return _complete(daily, "city_key")


def panel_with_nulls(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """P_NULLS: temperature/pressure nulled on code 0 days, rain/wind/humidity on code 61 days."""
    p = panel(spark, sf_dir, grain)
    slot_a = F.col("weather_code") == 0
    slot_b = F.col("weather_code") == 61
    nulled_a = ["temperature_2m_max", "temperature_2m_mean", "pressure_msl_mean"]
    nulled_b = ["precipitation_sum", "wind_speed_10m_max", "relative_humidity_2m_mean"]
    cols = []
    for c in p.columns:
        if c in nulled_a:
            cols.append(F.when(slot_a, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c))
        elif c in nulled_b:
            cols.append(F.when(slot_b, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return p.select(*cols)


# Forecast stand-in: the last FORECAST_DAYS days of each city, historical copy ends
# OVERLAP_DAYS earlier than the forecast ends, temperatures shifted by 1..3 degrees.
FORECAST_DAYS, HIST_CUT_DAYS = 14, 7


def hist_and_forecast(spark: SparkSession, sf_dir: str, grain: str = "region", p: DataFrame | None = None):
    p = panel(spark, sf_dir, grain) if p is None else p
    end = p.select(F.max("time")).scalar()  # scalar subquery, evaluated once
    hist = p.filter(F.col("time") <= F.date_sub(end, HIST_CUT_DAYS))
    shift = (F.dayofmonth("time") % 3 + 1).cast("double")
    fc = p.filter(F.col("time") >= F.date_sub(end, FORECAST_DAYS - 1))
    fc = fc.select(*[
        (F.col(c) + shift).alias(c) if c in ("temperature_2m_max", "temperature_2m_min",
                                             "temperature_2m_mean") else F.col(c)
        for c in fc.columns])
    return hist, fc


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P_HOURLY: events by (event_type, hour) as an hourly weather series per 'city'."""
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    n = F.count(F.lit(1))
    return (ev.groupBy(F.col("event_type").alias("city"),
                       F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
            .agg(F.max("value").alias("wind_speed_10m"),
                 (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / (n * 100))
                 .alias("temperature_2m"),
                 F.min("value").alias("shortwave_radiation"))
            .withColumn("is_day", F.hour("ts").between(6, 18).cast("int"))
            .select("city", "ts", "wind_speed_10m", "temperature_2m", "shortwave_radiation",
                    "is_day"))


def event_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P_EVENTDAY: many short, skewed series: events by (user_id, day)."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return (ev.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("city"),
                       F.to_date("ts").alias("time"))
            .agg(F.max("value").alias("temperature_2m_max"),
                 F.count(F.lit(1)).cast("double").alias("precipitation_sum")))


def nation_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIM: nation as a city dimension with synthetic coordinates (fixed 25 rows)."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        (F.lit(LAT_BASE) + F.col("n_nationkey") * LAT_STEP).alias("lat"),
        lon_of(F.col("n_nationkey")).alias("lon"),
        F.col("n_nationkey").alias("map_order"))


# ---------------------------------------------------------------------------------
# The same panels as SQL text for the oracle (DuckDB, tables pre-registered).
# ---------------------------------------------------------------------------------

def _code_case() -> str:
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(WMO_CODE_BY_SLOT))
    return f"CAST(CASE code_slot {arms} END AS INTEGER)"


def panel_sql(grain: str = "nation") -> str:
    name, key = {"region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_nationkey")}[grain]
    return f"""
SELECT city, time,
       {LAT_BASE} + city_key * {LAT_STEP} AS latitude,
       {lon_sql("city_key")} AS longitude,
       temperature_2m_max, temperature_2m_min, temperature_2m_mean,
       temperature_2m_max + (relative_humidity_2m_mean - 50) / 20 AS apparent_temperature_max,
       precipitation_sum, rain_sum,
       CASE WHEN month(time) IN (12, 1, 2) THEN precipitation_sum - rain_sum ELSE 0.0 END AS snowfall_sum,
       wind_speed_10m_max, wind_speed_10m_max * 3 / 2 AS wind_gusts_10m_max,
       relative_humidity_2m_mean, 100 - relative_humidity_2m_mean AS cloud_cover_mean,
       pressure_msl_mean, shortwave_radiation_sum,
       {_code_case()} AS weather_code
FROM (
  SELECT {name} AS city, {key} AS city_key, CAST(l_shipdate AS DATE) AS time,
         MAX(l_quantity) AS temperature_2m_max,
         MIN(l_quantity) AS temperature_2m_min,
         CAST(SUM(CAST(l_quantity AS INT)) AS DOUBLE) / COUNT(*) AS temperature_2m_mean,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(ROUND(l_tax * 100) AS INT) ELSE 0 END) AS DOUBLE) AS precipitation_sum,
         CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN CAST(ROUND(l_tax * 100) AS INT) ELSE 0 END) AS DOUBLE) AS rain_sum,
         CAST(MAX(CAST(ROUND(l_discount * 100) AS INT)) * 4 AS DOUBLE) AS wind_speed_10m_max,
         CAST(SUM(CAST(ROUND(l_tax * 1250) AS INT)) AS DOUBLE) / COUNT(*) AS relative_humidity_2m_mean,
         1000 + CAST(SUM(CAST(ROUND(l_discount * 300) AS INT)) AS DOUBLE) / COUNT(*) AS pressure_msl_mean,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1000000 AS shortwave_radiation_sum,
         CAST(SUM(l_linenumber) % 9 AS INT) AS code_slot
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY {name}, {key}, CAST(l_shipdate AS DATE)
) d"""


def panel_with_nulls_sql(grain: str = "region") -> str:
    return f"""
SELECT city, time, latitude, longitude,
       CASE WHEN weather_code = 0 THEN NULL ELSE temperature_2m_max END AS temperature_2m_max,
       temperature_2m_min,
       CASE WHEN weather_code = 0 THEN NULL ELSE temperature_2m_mean END AS temperature_2m_mean,
       apparent_temperature_max,
       CASE WHEN weather_code = 61 THEN NULL ELSE precipitation_sum END AS precipitation_sum,
       rain_sum, snowfall_sum,
       CASE WHEN weather_code = 61 THEN NULL ELSE wind_speed_10m_max END AS wind_speed_10m_max,
       wind_gusts_10m_max,
       CASE WHEN weather_code = 61 THEN NULL ELSE relative_humidity_2m_mean END AS relative_humidity_2m_mean,
       cloud_cover_mean,
       CASE WHEN weather_code = 0 THEN NULL ELSE pressure_msl_mean END AS pressure_msl_mean,
       shortwave_radiation_sum, weather_code
FROM ({panel_sql(grain)}) pn"""


def hist_sql(grain: str = "region") -> str:
    return f"""
SELECT * FROM ({panel_sql(grain)}) ph
WHERE time <= (SELECT MAX(time) FROM ({panel_sql(grain)}) pe) - INTERVAL {HIST_CUT_DAYS} DAY"""


def forecast_sql(grain: str = "region") -> str:
    shift = "CAST(dayofmonth(time) % 3 + 1 AS DOUBLE)"
    return f"""
SELECT city, time, latitude, longitude,
       temperature_2m_max + {shift} AS temperature_2m_max,
       temperature_2m_min + {shift} AS temperature_2m_min,
       temperature_2m_mean + {shift} AS temperature_2m_mean,
       apparent_temperature_max, precipitation_sum, rain_sum, snowfall_sum,
       wind_speed_10m_max, wind_gusts_10m_max, relative_humidity_2m_mean, cloud_cover_mean,
       pressure_msl_mean, shortwave_radiation_sum, weather_code
FROM ({panel_sql(grain)}) pf
WHERE time >= (SELECT MAX(time) FROM ({panel_sql(grain)}) pe) - INTERVAL {FORECAST_DAYS - 1} DAY"""


def hourly_sql() -> str:
    return """
SELECT city, ts, wind_speed_10m, temperature_2m, shortwave_radiation,
       CAST(hour(ts) BETWEEN 6 AND 18 AS INTEGER) AS is_day
FROM (
  SELECT event_type AS city, date_trunc('hour', ts) AS ts,
         MAX(value) AS wind_speed_10m,
         CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100) AS temperature_2m,
         MIN(value) AS shortwave_radiation
  FROM events GROUP BY event_type, date_trunc('hour', ts)
) h"""


def event_day_sql() -> str:
    return """
SELECT 'u' || CAST(user_id AS VARCHAR) AS city, CAST(ts AS DATE) AS time,
       MAX(value) AS temperature_2m_max, CAST(COUNT(*) AS DOUBLE) AS precipitation_sum
FROM events GROUP BY user_id, CAST(ts AS DATE)"""


def nation_dim_sql() -> str:
    return f"""
SELECT n_name AS name, {LAT_BASE} + n_nationkey * {LAT_STEP} AS lat,
       {lon_sql("n_nationkey")} AS lon, n_nationkey AS map_order
FROM nation"""
