"""Joins: climatology, fallback chains, coordinate lookups, nearest city, group pairs
(C1, C2, C4, C5, C7, C8, C9).

Broadcast policy: only tables with a fixed size bound get an explicit ``broadcast`` (the
alias table, a checked table of groups). Aggregates whose size grows with
the number of cities (climatology: cities x 366) are joined without a hint; AQE converts
the join to a broadcast at runtime when the materialised side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and keeps the shuffle join otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIM_VARS = ("temperature_2m_mean", "temperature_2m_max", "temperature_2m_min",
             "precipitation_sum", "relative_humidity_2m_mean", "wind_speed_10m_max")


def climatology(train: DataFrame, variables=CLIM_VARS, key="city", doy="day_of_year"):
    """Per (city, doy), per city and overall means of ``variables`` (training rows only)."""
    by_doy = train.groupBy(key, doy).agg(*[F.avg(v).alias(f"clim_{v}") for v in variables])
    by_city = train.groupBy(key).agg(*[F.avg(v).alias(f"city_{v}") for v in variables])
    overall = train.agg(*[F.avg(v).alias(f"all_{v}") for v in variables])
    return by_doy, by_city, overall


def merge_climatology(df: DataFrame, train: DataFrame, variables=CLIM_VARS, key="city",
                      doy="day_of_year") -> DataFrame:
    """Left-join the (city, doy) climatology with the fallback chain
    (city, doy) mean -> city mean -> overall training mean."""
    by_doy, by_city, overall = climatology(train, variables, key, doy)
    j = df.join(by_doy, [key, doy], "left").join(by_city, key, "left")
    allv = overall.select(F.struct(*[f"all_{v}" for v in variables])).scalar()  # one scalar subquery
    out = [F.col(c) for c in df.columns]
    for v in variables:
        out.append(F.coalesce(F.col(f"clim_{v}"), F.col(f"city_{v}"), allv[f"all_{v}"]).alias(f"clim_{v}"))
    return j.select(*out)


# The two city lists spell three cities differently
# (city registry name -> modelling map name).
CITY_NAME_ALIASES = {"Sumqayit": "Sumgayit", "Gakh": "Kakh", "Absheron": "Khirdalan"}


def resolve_city_aliases(df: DataFrame, aliases: dict | None = None, key="city") -> DataFrame:
    """Rename registry spellings to the modelling map's spelling through a fixed-size alias
    table (broadcast left join); names without an alias are kept."""
    spark = df.sparkSession
    aliases = aliases or CITY_NAME_ALIASES
    table = spark.createDataFrame(sorted(aliases.items()), "_from string, _to string")
    j = df.join(F.broadcast(table), F.col(key) == F.col("_from"), "left")
    return j.select(*[F.coalesce(F.col("_to"), F.col(key)).alias(key) if c == key else F.col(c)
                      for c in df.columns])


def attach_coordinates(df: DataFrame, city_map: DataFrame, key="city") -> DataFrame:
    """Canonical lat/lon from the city map (the planner broadcasts it when it is small)."""
    m = city_map.select(F.col("name").alias(key), F.col("lat"), F.col("lon"))
    return df.join(m, key, "left")


def known_cities(df: DataFrame, city_map: DataFrame, key="city") -> DataFrame:
    return df.join(city_map.select(F.col("name").alias(key)), key, "left_semi")


def nearest_city(points: DataFrame, city_map: DataFrame, lat="lat", lon="lon",
                 max_d2: float = 0.1, unknown: str = "Unknown", point_id="point_id") -> DataFrame:
    """Nearest city by squared degree distance, accepted only below ``max_d2``.

    No cross join: both sides get a grid cell of side >= sqrt(max_d2); every city is
    replicated into its 3x3 neighbour cells, so all candidates within the acceptance radius
    share the point's cell and the match is an equi-join on the cell. Ties go to the earlier
    city in map order (``map_order``)."""
    cell = math.sqrt(max_d2) * 1.0001
    cities = city_map.select(
        F.col("name").alias("_name"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"),
        F.col("map_order").alias("_ord"),
        F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                            for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("_n"))
    cities = cities.select(
        "_name", "_clat", "_clon", "_ord",
        (F.floor(F.col("_clat") / cell) + F.col("_n.dx")).alias("_gx"),
        (F.floor(F.col("_clon") / cell) + F.col("_n.dy")).alias("_gy"))
    pts = points.select(point_id, lat, lon,
                        F.floor(F.col(lat) / cell).alias("_gx"), F.floor(F.col(lon) / cell).alias("_gy"))
    cand = pts.join(cities, ["_gx", "_gy"], "left")
    d2 = F.pow(F.col("_clat") - F.col(lat), 2) + F.pow(F.col("_clon") - F.col(lon), 2)
    best = (cand.withColumn("_d2", d2)
            .groupBy(point_id, lat, lon)
            .agg(F.min_by(F.struct("_name", "_d2"), F.struct("_d2", "_ord")).alias("_b")))
    ok = F.col("_b._d2") < max_d2
    return best.select(point_id, lat, lon,
                       F.when(ok, F.col("_b._name")).otherwise(F.lit(unknown)).alias("city"))


#: groups of a factor that may be compared pair by pair
MAX_PAIR_GROUPS = 1000


def group_pairs(stats: DataFrame, key: str, max_groups: int = MAX_PAIR_GROUPS) -> DataFrame:
    """All pairs a < b of a per-group statistics table (one row per group, never data rows).
    Pairwise comparison is for small factors: more than ``max_groups`` groups are an error,
    so the broadcast side is bounded. Columns get ``_a`` / ``_b`` suffixes."""
    k = stats.count()
    if k > max_groups:
        raise ValueError(f"{k} groups are too many to compare pair by pair (at most {max_groups})")
    a = stats.select(*[F.col(c).alias(f"{c}_a") for c in stats.columns])
    b = stats.select(*[F.col(c).alias(f"{c}_b") for c in stats.columns])
    return a.join(F.broadcast(b), F.col(f"{key}_a") < F.col(f"{key}_b"))


def align_by_year_long(df: DataFrame, value="temperature_2m_max", key="city", doy="day_of_year",
                       time="time") -> DataFrame:
    """Same day-of-year across years, one row per (key, day-of-year, year) for every year of
    the data. The last write in time order wins when two dates share a slot."""
    return (df.groupBy(key, doy, F.year(time).alias("year"))
            .agg(F.max_by(F.col(value), F.col(time)).alias("value")))


def align_by_year(df: DataFrame, years, value="temperature_2m_max", key="city",
                  doy="day_of_year", time="time") -> DataFrame:
    """View of ``align_by_year_long`` with one column per year of an explicit list (a stable
    schema for charts); years outside the list are not shown."""
    long = align_by_year_long(df, value, key, doy, time)
    return (long.groupBy(key, doy).pivot("year", list(years)).agg(F.first("value"))
            .select(key, doy, *[F.col(str(y)).alias(f"y{y}") for y in years]))
