"""Per-series window features (E1-E24) and the feature layer (``compute_all_features``).

Partitioning: every series window is ``partitionBy(city).orderBy(time)``; windows keyed by
(city, day_of_year) or (city, year) are clustered on a superset of ``city``, so one hash
exchange on ``city`` feeds all of them and the plan only adds sorts. A series holds one row
per (city, day) after the keyed store's de-duplication (``sources.store.upsert``), so the
rows of one window partition are bounded by the calendar span of that city, not by the data
volume: a hot city cannot grow a partition beyond its number of distinct days.

Frames count rows, not calendar days (pandas integer windows); ``calendar_rolling_mean``
is the day-based variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx


def series_window(key="city", order="time"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def rolling_mean(col: str, rows: int, key="city", order="time", min_periods: int = 1) -> Column:
    """Mean of the last ``rows`` rows (current included). Null unless the frame holds
    ``min_periods`` non-null values."""
    w = series_window(key, order).rowsBetween(-(rows - 1), 0)
    avg = F.avg(col).over(w)
    if min_periods <= 1:
        return avg
    return F.when(F.count(col).over(w) >= min_periods, avg)


def rolling_sum(col: str, rows: int, key="city", order="time", min_periods: int = 1) -> Column:
    w = series_window(key, order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(col).over(w) >= min_periods, F.sum(col).over(w))


def lag(col: str, k: int, key="city", order="time") -> Column:
    return F.lag(col, k).over(series_window(key, order))


def lagged_rolling_mean(col: str, rows: int, key="city", order="time") -> Column:
    """shift(1) then rolling(rows, min_periods=1): the window excludes today."""
    return F.avg(col).over(series_window(key, order).rowsBetween(-rows, -1))


def calendar_rolling_mean(col: str, days: int, key="city", order="time") -> Column:
    """Day-based frame: the last ``days`` calendar days, gaps do not stretch the window."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(order))).rangeBetween(-(days - 1), 0)
    return F.avg(col).over(w)


def centred_mean(col: str, half: int, key="city", order="time") -> Column:
    return F.avg(col).over(series_window(key, order).rowsBetween(-half, half))


def doy_anomaly(col: str = "temperature_2m_mean", key="city", doy="day_of_year") -> Column:
    """T minus the mean of the same (city, day-of-year), the row itself included."""
    return F.col(col) - F.avg(col).over(Window.partitionBy(key, doy))


def city_anomaly(col: str = "temperature_2m_mean", key="city") -> Column:
    return F.col(col) - F.avg(col).over(Window.partitionBy(key))


# ---------------------------------------------------------------------------------
# Feature layer
# ---------------------------------------------------------------------------------

# Rolled and lagged measures, with their windows and lags in rows.
ROLL_TARGETS = {"temperature_2m_mean": (7, 30), "precipitation_sum": (7, 30)}
LAG_TARGETS = {"temperature_2m_mean": (1, 2), "precipitation_sum": (1, 2)}


def compute_all_features(df: DataFrame, base_temp: float = 18.0,
                         season_labels: dict | None = None) -> DataFrame:
    """Rolling means, calendar fields, season, range, degree days, day-of-year anomaly, lags."""
    cols = [F.col(c) for c in df.columns]
    for c, windows in ROLL_TARGETS.items():
        for w in windows:
            cols.append(rolling_mean(c, w).alias(f"{c}_{w}d"))
    month = F.month("time")
    cols += [month.alias("month"), F.quarter("time").alias("quarter"),
             F.dayofyear("time").alias("day_of_year"),
             cal.season(month, season_labels).alias("season"),
             wx.temperature_range().alias("temperature_range"),
             wx.heating_degree_days(base=base_temp).alias("HDD"),
             wx.cooling_degree_days(base=base_temp).alias("CDD")]
    for c, lags in LAG_TARGETS.items():
        for k in lags:
            cols.append(lag(c, k).alias(f"{c}_lag{k}"))
    out = df.select(*cols)
    return out.withColumn("anomaly_score", doy_anomaly("temperature_2m_mean"))


def fallback_features(df: DataFrame, base_temp: float = 18.0) -> DataFrame:
    """Secondary feature path: rolling *sums* of precipitation and an anomaly against the
    city's own 30-row mean (differs from ``compute_all_features`` on purpose)."""
    t, p = "temperature_2m_mean", "precipitation_sum"
    t30 = rolling_mean(t, 30)
    return df.select(
        *df.columns,
        rolling_mean(t, 7).alias(f"{t}_7d"), t30.alias(f"{t}_30d"),
        (F.col(t) - t30).alias("anomaly_score"),
        lag(t, 1).alias(f"{t}_lag1"), lag(t, 2).alias(f"{t}_lag2"),
        wx.heating_degree_days(base=base_temp).alias("HDD"),
        wx.cooling_degree_days(base=base_temp).alias("CDD"),
        rolling_sum(p, 7).alias(f"{p}_7d"), rolling_sum(p, 30).alias(f"{p}_30d"),
        lag(p, 1).alias(f"{p}_lag1"), lag(p, 2).alias(f"{p}_lag2"),
    )


# ---------------------------------------------------------------------------------
# Risk features
# ---------------------------------------------------------------------------------

def persistence_alert_level(tmax: str = "temperature_2m_max", hot: float = 35.0,
                            cold: float | None = None, rows: int = 3, key="city") -> Column:
    """Hot days among the last ``rows`` rows of the city; rows before a full window get 0.
    With ``cold`` given, the signed level hot - cold counts."""
    w = series_window(key).rowsBetween(-(rows - 1), 0)
    flag = F.coalesce((F.col(tmax) > hot).cast("int"), F.lit(0))
    if cold is not None:
        flag = flag - F.coalesce((F.col(tmax) < cold).cast("int"), F.lit(0))
    rn = F.row_number().over(series_window(key))
    return F.when(rn >= rows, F.sum(flag).over(w)).otherwise(F.lit(0)).cast("int")


def extreme_runs(df: DataFrame, flag: Column, key: str = "city", order: str = "time") -> DataFrame:
    """Gaps-and-islands: consecutive rows with ``flag`` true; one row per run with
    start, end and length (rows)."""
    w = series_window(key, order)
    marked = df.select(key, order, F.coalesce(flag, F.lit(False)).alias("_f"),
                       F.row_number().over(w).alias("_rn"))
    hot = marked.filter("_f").withColumn(
        "_grp", F.col("_rn") - F.row_number().over(series_window(key, "_rn")))
    return (hot.groupBy(key, "_grp")
            .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"),
                 F.count(F.lit(1)).alias("run_length"))
            .drop("_grp"))


def stuck_sensor_flag(col: str = "temperature_2m_mean", rows: int = 3, min_equal: int = 2,
                      key="city") -> Column:
    """diff to the previous row == 0 (the first row's missing diff counts as 0); at least
    ``min_equal`` of the last ``rows`` diffs equal zero, full window required."""
    w = series_window(key)
    same = F.coalesce(F.col(col) - F.lag(col, 1).over(w), F.lit(0.0)) == 0
    same_i = F.coalesce(same.cast("int"), F.lit(0))
    frame = w.rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(frame) == rows
    return F.coalesce(full & (F.sum(same_i).over(frame) >= min_equal), F.lit(False))


def jump_size(col: str = "temperature_2m_mean", key="city") -> Column:
    return F.abs(F.col(col) - lag(col, 1, key))


def date_gap_days(key="city", order="time") -> Column:
    return F.datediff(F.col(order), F.lag(order, 1).over(series_window(key, order)))


def latest_per_key(df: DataFrame, key="city", order="time") -> DataFrame:
    """Newest row per key (QUALIFY row_number() = 1 without QUALIFY), as a ``max_by``
    aggregation: partial aggregation keeps one candidate per key and partition, so a key
    with a huge number of rows never sorts in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_prefer(first: DataFrame, second: DataFrame, keys=("city", "time")) -> DataFrame:
    """Union two sources; on a duplicated key the ``first`` one wins.

    Pre-aggregates with ``max_by`` instead of a row_number window, so a key that repeats
    many times is combined map-side before the shuffle."""
    keys = list(keys)
    cols = [c for c in first.columns if c not in keys]
    tagged = (first.select(*keys, *cols, F.lit(1).alias("_prio"))
              .unionByName(second.select(*keys, *cols, F.lit(0).alias("_prio"))))
    packed = F.struct(*[F.col(c) for c in cols])
    best = tagged.groupBy(*keys).agg(F.max_by(packed, F.col("_prio")).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def every_kth(df: DataFrame, k, key="city", order="time") -> DataFrame:
    """Every k-th row of each series, starting with the first (0-based position % k == 0)."""
    rn = F.row_number().over(series_window(key, order))
    return df.withColumn("_rn", rn).filter((F.col("_rn") - 1) % k == 0).drop("_rn")


def running_last(col, key="city", order="time", descending: bool = False) -> Column:
    """Last non-null value up to the current row. With ``descending`` the series is walked
    backwards, which yields the *next* non-null value. Both are growing frames that Spark
    evaluates in one pass (a frame ending at unboundedFollowing would be re-aggregated for
    every row, quadratic in the series length)."""
    o = F.col(order).desc() if descending else F.col(order)
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col, ignorenulls=True).over(w)


def forward_back_fill(col: str, key="city", order="time") -> Column:
    return F.coalesce(running_last(col, key, order), running_last(col, key, order, descending=True))


def hourly_features(df: DataFrame, key: str = "city", order: str = "ts",
                    columns=("wind_speed_10m", "temperature_2m", "shortwave_radiation"),
                    lags=(1, 2, 3, 6, 12, 24, 48), windows=(6, 12, 24)) -> DataFrame:
    """Hourly lags and rolling means (rows at hourly grain)."""
    out = [F.col(c) for c in df.columns]
    for c in columns:
        for k in lags:
            out.append(lag(c, k, key, order).alias(f"{c}_lag{k}"))
        for w in windows:
            out.append(rolling_mean(c, w, key, order).alias(f"{c}_roll{w}"))
    return df.select(*out)


def autocorrelation(df: DataFrame, col: str, max_lag: int = 40, key="city",
                    order="time") -> DataFrame:
    """ACF per series: r_k = sum (x_t - m)(x_{t-k} - m) / sum (x - m)^2, k = 1..max_lag,
    with the +-1.96/sqrt(n) band. One window pass for all lags, then one aggregate."""
    w = series_window(key, order)
    centred = df.select(key, order, (F.col(col) - F.avg(col).over(Window.partitionBy(key)))
                        .alias("_d"))
    lagged = centred.select(key, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}")
                                         for k in range(1, max_lag + 1)])
    aggs = [F.sum(F.col("_d") * F.col("_d")).alias("_ss"), F.count("_d").alias("n")]
    aggs += [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_p{k}") for k in range(1, max_lag + 1)]
    per = lagged.groupBy(key).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_p{k}"), F.col("_ss"))
                                        .alias("acf")) for k in range(1, max_lag + 1)]))
    return (per.select(key, "n", rows.alias("_r"))
            .select(key, F.col("_r.lag").alias("lag"), F.col("_r.acf").alias("acf"),
                    (F.lit(1.96) / F.sqrt("n")).alias("band")))
