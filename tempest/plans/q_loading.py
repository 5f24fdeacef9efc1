"""Registered queries: sources, keyed store, increments, joins and set operations (A*, C*, G*)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from tempest import schemas as S
from tempest.operators import joins as jn
from tempest.operators import loading as ld
from tempest.operators.cleaning import dedupe_first
from tempest.plans import oracle as o
from tempest.plans.catalog import query, round_doubles
from tempest.session import checkpoint_dir
from tempest.sources import files, store
from tempest.sources import fixtures as fx

NAT = o.panel("nation")
REG = o.panel("region")
RAW_D = o.DOUBLE_RAW


def _nation(spark, sf_dir):
    return fx.panel(spark, sf_dir, "nation")


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint directory (never a machine-local path on
    a cluster: ``spark.checkpoint.dir`` names shared storage there)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query("a01_csv_roundtrip", o.with_panels(o.rounded_select(RAW_D, ["city", "time", "weather_code"], "p"),
                                          p=NAT.replace("n_name AS city", "lower(n_name) AS city")))
def q_csv_roundtrip(spark, sf_dir):
    """Land the panel as per-city CSV files, read them back with the landed-file reader
    (city from the path, lower case)."""
    path = _scratch(spark, "landed")
    p = _nation(spark, sf_dir)
    (p.withColumn("time", F.date_format("time", "yyyy-MM-dd"))
     .select(*[c for c in S.DAILY_CSV.fieldNames()], F.lower("city").alias("landing_city"))
     .write.partitionBy("landing_city").option("header", True).csv(path))
    back = files.read_city_csvs(spark, path, "forecast", dir_key="landing_city", layout="folders")
    return round_doubles(back.select(*S.RAW_COLUMNS))


@query("a03_city_dim", o.with_panels(
    "SELECT city, arg_min(latitude, time) AS latitude, arg_min(longitude, time) AS longitude FROM p GROUP BY city",
    p=NAT))
def q_city_dim(spark, sf_dir):
    return ld.city_dim(_nation(spark, sf_dir))


@query("a04_explode_districts",
       "SELECT n_name AS name, unnest(CASE WHEN len(string_split(n_name, '_')) > 0 THEN string_split(n_name, '_') END) AS district "
       "FROM nation")
def q_districts(spark, sf_dir):
    dim = fx.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.split("n_name", "_").alias("districts"))
    return ld.explode_districts(dim)


@query("a05_conform", o.with_panels(
    "SELECT city, time, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, "
    + ", ".join(f"ROUND({m}, 6) AS {m}" if m not in ("cloud_cover_mean", "snowfall_sum") else f"NULL::DOUBLE AS {m}"
                for m in S.MEASURES) + ", weather_code FROM p", p=NAT))
def q_conform(spark, sf_dir):
    p = _nation(spark, sf_dir).drop("latitude", "longitude", "cloud_cover_mean", "snowfall_sum")
    p = p.withColumn("extra_column", F.lit("dropped"))
    return round_doubles(files.conform(p, S.DAILY))


@query("a07_layer_partition_pruning", o.with_panels(
    o.rounded_select(RAW_D, ["city", "time", "weather_code", "CAST(year(time) AS INTEGER) AS year"], "p")
    + " WHERE year(time) = 1997", p=NAT))
def q_layer_roundtrip(spark, sf_dir):
    """Write the layer partitioned by year, read one year back (partition pruning)."""
    path = _scratch(spark, "layer")
    files.write_layer(_nation(spark, sf_dir), path)
    back = spark.read.parquet(path).filter(F.col("year") == 1997)
    return round_doubles(back.select(*S.RAW_COLUMNS, "year"))


_UPSERT_SQL = o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean, "
    "ROUND(temperature_2m_max, 6) AS temperature_2m_max FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY city, time ORDER BY src DESC) AS rn FROM "
    "(SELECT *, 0 AS src FROM h UNION ALL SELECT *, 1 AS src FROM f) u) s WHERE rn = 1",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"))


@query("a08_upsert", _UPSERT_SQL)
def q_upsert(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    m = store.upsert(h, f)
    return round_doubles(m.select("city", "time", "temperature_2m_mean", "temperature_2m_max"))


@query("a08_upsert_to_store", _UPSERT_SQL)
def q_upsert_store(spark, sf_dir):
    """Same merge through the Parquet store: load history, upsert the forecast batch twice
    (replaying a batch leaves the table unchanged)."""
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    path = _scratch(spark, "store")
    store.upsert_to_path(spark, path, h)
    store.upsert_to_path(spark, path, f)
    m = store.upsert_to_path(spark, path, f)
    return round_doubles(m.select("city", "time", "temperature_2m_mean", "temperature_2m_max"))


@query("a10_latest_dates", o.with_panels("SELECT city, MAX(time) AS last_date FROM p GROUP BY city", p=NAT))
def q_latest_dates(spark, sf_dir):
    return store.latest_dates(_nation(spark, sf_dir))


# Increment fixture: history = region panel up to the forecast cut; the batch holds the whole
# region panel plus the nation panel (cities never seen before, starting at DEFAULT_START).
INC_DEFAULT_START = _dt.date(1996, 1, 1)
INC_END = _dt.date(2001, 10, 31)


def _increment(spark, sf_dir):
    h, _ = fx.hist_and_forecast(spark, sf_dir, "region")
    batch = fx.panel(spark, sf_dir, "region").unionByName(_nation(spark, sf_dir))
    return ld.select_increment(batch, store.latest_dates(h), INC_END, INC_DEFAULT_START)


_INC_SQL = ("SELECT b.* FROM (SELECT * FROM r UNION ALL SELECT * FROM n) b "
            "LEFT JOIN (SELECT city, MAX(time) AS last_date FROM h GROUP BY city) l ON b.city = l.city "
            "WHERE b.time > COALESCE(l.last_date, DATE '1996-01-01' - INTERVAL 1 DAY) AND b.time <= DATE '2001-10-31'")


@query("a11_select_increment", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max FROM inc",
    r=REG, n=NAT, h=fx.hist_sql("region"), inc=_INC_SQL))
def q_increment(spark, sf_dir):
    return round_doubles(_increment(spark, sf_dir).select("city", "time", "temperature_2m_max"))


@query("a12_force_start", o.with_panels(
    "SELECT city, time FROM p WHERE time >= DATE '2001-06-01' AND time <= DATE '2001-10-31'", p=NAT))
def q_force_start(spark, sf_dir):
    return ld.force_start(_nation(spark, sf_dir), _dt.date(2001, 6, 1), INC_END).select("city", "time")


@query("a13_filter_cities", o.with_panels(
    "SELECT city, time FROM p WHERE lower(city) IN ('nation_3', 'nation_12')", p=NAT))
def q_filter_cities(spark, sf_dir):
    return ld.filter_cities(_nation(spark, sf_dir), ["Nation_3", "NATION_12"]).select("city", "time")


@query("a16_layer_counts", o.with_panels(
    "SELECT 'raw_historical' AS table_name, COUNT(*) AS row_count FROM h UNION ALL "
    "SELECT 'raw_forecast', COUNT(*) FROM f UNION ALL "
    "SELECT 'staging_historical', COUNT(*) FROM r UNION ALL "
    "SELECT 'staging_forecast', CAST(0 AS BIGINT)",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region"), p=o.nulls("region"), r=o.repaired_sql("p")))
def q_layer_counts(spark, sf_dir):
    from tempest.operators.cleaning import handle_missing

    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    staged = handle_missing(fx.panel_with_nulls(spark, sf_dir, "region"))
    return store.layer_counts({"raw_historical": h, "raw_forecast": f,
                               "staging_historical": staged, "staging_forecast": None})


@query("a17_update_report", o.with_panels(
    "SELECT city, COUNT(*) AS new_rows, MIN(time) AS first_date, MAX(time) AS last_date, "
    "CAST(date_diff('day', MAX(time), DATE '2002-01-01') AS INTEGER) AS days_behind FROM inc GROUP BY city",
    r=REG, n=NAT, h=fx.hist_sql("region"), inc=_INC_SQL))
def q_update_report(spark, sf_dir):
    return ld.update_report(_increment(spark, sf_dir), _dt.date(2002, 1, 1))


@query("a18_ingest_summary", o.with_panels(
    "SELECT c.city, CASE WHEN c.city IN (SELECT city FROM inc) THEN 'updated' ELSE 'skipped' END AS status "
    "FROM (SELECT DISTINCT city FROM r UNION SELECT DISTINCT city FROM n) c",
    r=REG, n=NAT, h=fx.hist_sql("region"), inc=_INC_SQL))
def q_ingest_summary(spark, sf_dir):
    from tempest.session import materialize

    offered = materialize(fx.panel(spark, sf_dir, "region").select("city", "time"))
    h, _ = fx.hist_and_forecast(spark, sf_dir, "region", offered)
    batch = offered.unionByName(_nation(spark, sf_dir).select("city", "time"))
    return ld.ingest_status(batch, store.latest_dates(h), INC_END, INC_DEFAULT_START)


@query("a18_ingest_summary_of_batch", o.with_panels(
    "SELECT c.city, CASE WHEN c.city IN (SELECT city FROM r WHERE time >= DATE '2001-06-01') THEN 'updated' ELSE 'skipped' END AS status "
    "FROM (SELECT DISTINCT city FROM r UNION SELECT DISTINCT city FROM n) c", r=REG, n=NAT))
def q_ingest_summary_of_batch(spark, sf_dir):
    """The same summary from the rows of a batch: here the region series of some months."""
    r = fx.panel(spark, sf_dir, "region").select("city", "time")
    everyone = r.select("city").unionByName(_nation(spark, sf_dir).select("city"))
    return ld.ingest_summary(everyone, ld.force_start(r, _dt.date(2001, 6, 1)))


@query("a19_future_rows", o.with_panels(
    "SELECT city, COUNT(*) AS future_rows, MIN(time) AS first_future FROM p WHERE time > DATE '2001-06-30' GROUP BY city",
    p=NAT))
def q_future_rows(spark, sf_dir):
    ld.validate_range(_dt.date(1995, 1, 1), _dt.date(2001, 6, 30), _dt.date(2001, 6, 30))
    return ld.future_rows(_nation(spark, sf_dir), _dt.date(2001, 6, 30))


# ------------------------------------------------------------------ joins

_CLIM = ("temperature_2m_mean", "temperature_2m_max")


def _clim_sql():
    items = []
    for v in _CLIM:
        items.append(f"ROUND(COALESCE(d.clim_{v}, c.city_{v}, (SELECT AVG({v}) FROM p WHERE year(time) < 2000)), 6) AS clim_{v}")
    by_doy = ", ".join(f"AVG({v}) AS clim_{v}" for v in _CLIM)
    by_city = ", ".join(f"AVG({v}) AS city_{v}" for v in _CLIM)
    return ("SELECT p.city, p.time, " + ", ".join(items) + " FROM p "
            f"LEFT JOIN (SELECT city, dayofyear(time) AS doy, {by_doy} FROM p WHERE year(time) < 2000 GROUP BY 1, 2) d "
            "ON p.city = d.city AND dayofyear(p.time) = d.doy "
            f"LEFT JOIN (SELECT city, {by_city} FROM p WHERE year(time) < 2000 GROUP BY 1) c ON p.city = c.city")


@query("c01_climatology_join", o.with_panels(_clim_sql(), p=NAT))
def q_clim_join(spark, sf_dir):
    p = _nation(spark, sf_dir).withColumn("day_of_year", F.dayofyear("time"))
    train = p.filter(F.year("time") < 2000)
    m = jn.merge_climatology(p, train, _CLIM)
    return round_doubles(m.select("city", "time", *[f"clim_{v}" for v in _CLIM]))


@query("c04_attach_coordinates", o.with_panels(
    "SELECT p.city, p.time, d.lat, d.lon FROM p LEFT JOIN d ON p.city = d.name",
    p="SELECT DISTINCT city, time FROM (" + REG + ") r UNION ALL SELECT city, time FROM (" + NAT + ") n",
    d=fx.nation_dim_sql()))
def q_coords(spark, sf_dir):
    pts = (fx.panel(spark, sf_dir, "region").select("city", "time")
           .unionByName(_nation(spark, sf_dir).select("city", "time")))
    return jn.attach_coordinates(pts, fx.nation_dim(spark, sf_dir)).select("city", "time", "lat", "lon")


_POINTS_SQL = ("SELECT s_suppkey AS point_id, 36.0 + s_nationkey * 0.25 + s_acctbal / 20000.0 AS lat, "
               f"{fx.lon_sql('s_nationkey')} - s_acctbal / 40000.0 AS lon FROM supplier")


def _points(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("point_id"),
                    (F.lit(36.0) + F.col("s_nationkey") * 0.25 + F.col("s_acctbal") / 20000.0).alias("lat"),
                    (fx.lon_of(F.col("s_nationkey")) - F.col("s_acctbal") / 40000.0).alias("lon"))


# The oracle is the brute-force definition (every point against every city); the Spark
# operator reaches the same answer through a grid-cell equi-join.
@query("c05_nearest_city", o.with_panels(
    "SELECT point_id, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon, CASE WHEN d2 < 0.1 THEN name ELSE 'Unknown' END AS city FROM "
    "(SELECT point_id, lat, lon, arg_min(name, (d2, map_order)) AS name, MIN(d2) AS d2 FROM "
    "(SELECT p.point_id, p.lat, p.lon, d.name, d.map_order, pow(d.lat - p.lat, 2) + pow(d.lon - p.lon, 2) AS d2 "
    "FROM pts p CROSS JOIN d) c GROUP BY point_id, lat, lon) b",
    pts=_POINTS_SQL, d=fx.nation_dim_sql()))
def q_nearest(spark, sf_dir):
    r = jn.nearest_city(_points(spark, sf_dir), fx.nation_dim(spark, sf_dir))
    return round_doubles(r)


@query("c07_known_cities_semi", o.with_panels(
    "SELECT city, time FROM p WHERE city IN (SELECT name FROM d)",
    p="SELECT city, time FROM (" + REG + ") r UNION ALL SELECT city, time FROM (" + NAT + ") n",
    d=fx.nation_dim_sql()))
def q_semi(spark, sf_dir):
    pts = (fx.panel(spark, sf_dir, "region").select("city", "time")
           .unionByName(_nation(spark, sf_dir).select("city", "time")))
    return jn.known_cities(pts, fx.nation_dim(spark, sf_dir))


_YEARS = list(range(1995, 2002))


@query("a06_first_available", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max FROM p", p=REG))
def q_first_available(spark, sf_dir):
    """The first stored layer of a list of candidates; the first of them does not exist."""
    base = _scratch(spark, "layers")
    fx.panel(spark, sf_dir, "region").write.parquet(f"{base}/raw")
    found = files.read_first_available(spark, [f"{base}/staging", f"{base}/raw"])
    return round_doubles(found.select("city", "time", "temperature_2m_max"))


@query("c09_align_by_year", o.with_panels(
    "SELECT city, CAST(dayofyear(time) AS INTEGER) AS day_of_year, "
    + ", ".join(f"ROUND(arg_max(temperature_2m_max, time) FILTER (WHERE year(time) = {y}), 6) AS y{y}" for y in _YEARS)
    + " FROM p GROUP BY city, dayofyear(time)", p=REG))
def q_align(spark, sf_dir):
    p = fx.panel(spark, sf_dir, "region").withColumn("day_of_year", F.dayofyear("time"))
    return round_doubles(jn.align_by_year(p, _YEARS))


@query("c09_align_by_year_long", o.with_panels(
    "SELECT city, CAST(dayofyear(time) AS INTEGER) AS day_of_year, CAST(year(time) AS INTEGER) AS year, "
    "ROUND(arg_max(temperature_2m_max, time), 6) AS value FROM p GROUP BY 1, 2, 3", p=REG))
def q_align_long(spark, sf_dir):
    p = fx.panel(spark, sf_dir, "region").withColumn("day_of_year", F.dayofyear("time"))
    return round_doubles(jn.align_by_year_long(p))


# ------------------------------------------------------------------ set operations

@query("g01_union_by_name", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_max, 6) AS temperature_2m_max, ROUND(precipitation_sum, 6) AS precipitation_sum, "
    "ROUND(wind_speed_10m_max, 6) AS wind_speed_10m_max FROM r UNION ALL "
    "SELECT city, time, ROUND(temperature_2m_max, 6), ROUND(precipitation_sum, 6), NULL FROM e",
    r=REG, e=fx.event_day_sql()))
def q_union(spark, sf_dir):
    r = fx.panel(spark, sf_dir, "region").select("city", "time", "temperature_2m_max",
                                                 "precipitation_sum", "wind_speed_10m_max")
    e = fx.event_day_panel(spark, sf_dir)
    return round_doubles(r.unionByName(e, allowMissingColumns=True))


@query("g02_union_all", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean FROM h UNION ALL "
    "SELECT city, time, ROUND(temperature_2m_mean, 6) FROM f",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region")))
def q_union_all(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    return round_doubles(h.select("city", "time", "temperature_2m_mean")
                         .union(f.select("city", "time", "temperature_2m_mean")))


@query("g03_dedupe_key", o.with_panels(
    "SELECT city, time, ROUND(temperature_2m_mean, 6) AS temperature_2m_mean FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY city, time ORDER BY seq) AS rn FROM "
    "(SELECT city, time, temperature_2m_mean, 0 AS seq FROM h UNION ALL "
    " SELECT city, time, temperature_2m_mean, 1 AS seq FROM f) u) s WHERE rn = 1",
    h=fx.hist_sql("region"), f=fx.forecast_sql("region")))
def q_dedupe(spark, sf_dir):
    h, f = fx.hist_and_forecast(spark, sf_dir, "region")
    u = (h.select("city", "time", "temperature_2m_mean", F.lit(0).alias("seq"))
         .union(f.select("city", "time", "temperature_2m_mean", F.lit(1).alias("seq"))))
    return round_doubles(dedupe_first(u, ("city", "time"), seq="seq").drop("seq"))


@query("a02_panel_csv_roundtrip", o.with_panels(o.rounded_select(RAW_D, ["city", "time", "weather_code"], "p"),
                                                p=NAT))
def q_panel_csv(spark, sf_dir):
    """Write the combined panel as one CSV dataset with a header, read it back with the
    panel reader (explicit schema, text dates parsed)."""
    path = _scratch(spark, "panel-csv")
    (_nation(spark, sf_dir).withColumn("time", F.date_format("time", "yyyy-MM-dd"))
     .select(*S.DAILY_CSV.fieldNames()).write.option("header", True).csv(path))
    return round_doubles(files.read_panel_csv(spark, path).select(*S.RAW_COLUMNS))
