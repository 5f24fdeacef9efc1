"""Serving marts: what the dashboard asks per city, computed for every city in one job
(L1-L8), and the chart series behind it (E16-E19).

Everything is keyed by city; windows reuse one exchange on ``city``. Per-series results are
long tables (city, ..., value), so no result row grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx
from tempest.operators import aggregates as ag
from tempest.operators.features import latest_per_key, merge_prefer, persistence_alert_level, series_window
from tempest.operators.joins import align_by_year_long

HISTORY_COLUMNS = ["temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
                   "relative_humidity_2m_mean", "wind_speed_10m_max", "shortwave_radiation_sum"]


def city_latest(forecast: DataFrame) -> DataFrame:
    """Newest forecast row per city: temperature and coordinates."""
    return latest_per_key(forecast).select("city", "time", "temperature_2m_max", "latitude", "longitude")


def city_history(hist: DataFrame, fc: DataFrame) -> DataFrame:
    """Historical and forecast rows merged per (city, time), historical wins; rows need a
    Tmax; the mean falls back to (max + min) / 2."""
    cols = ["city", "time", *HISTORY_COLUMNS]
    h = hist.select(*cols).filter(F.col("temperature_2m_max").isNotNull())
    f = fc.select(*cols).filter(F.col("temperature_2m_max").isNotNull())
    m = merge_prefer(h, f)
    return m.withColumn("temperature_2m_mean", F.coalesce(
        "temperature_2m_mean", (F.col("temperature_2m_max") + F.col("temperature_2m_min")) / 2.0))


def forecast_rows(fc: DataFrame) -> DataFrame:
    """The raw forecast layer as forecast days: category, impact score and alert level."""
    return fc.select("city", "time", "temperature_2m_max", "temperature_2m_min", "relative_humidity_2m_mean",
                     wx.weather_category().alias("weather_category"), wx.impact_score().alias("impact_score"),
                     persistence_alert_level().alias("persistence_alert_level"))


def history_fallback(history: DataFrame, forecast_days: DataFrame) -> DataFrame:
    """Cities without any history get their forecast rows, mean = round((max + min) / 2, 1);
    as in the dashboard backend the mean is only formed when both values are truthy, so a
    0.0 degree maximum or minimum leaves it null."""
    missing = forecast_days.join(history.select("city").distinct(), "city", "left_anti")
    truthy = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    fill = missing.select(
        "city", F.col("date").alias("time"), "temperature_2m_max", "temperature_2m_min",
        F.when(truthy("temperature_2m_max") & truthy("temperature_2m_min"),
               F.round((F.col("temperature_2m_max") + F.col("temperature_2m_min")) / 2, 1))
        .alias("temperature_2m_mean"),
        "relative_humidity_2m_mean", F.lit(None).cast("double").alias("wind_speed_10m_max"),
        F.lit(None).cast("double").alias("shortwave_radiation_sum"))
    return history.select(*fill.columns).unionByName(fill)


def forecast_documents(days: DataFrame) -> DataFrame:
    """Forecast rows -> one document per city ``{"cities": {city: [day, ...]}}``.
    The days of one city are its forecast horizon (bounded)."""
    day = F.struct(F.date_format("time", "yyyy-MM-dd").alias("date"), "temperature_2m_max",
                   "temperature_2m_min", "relative_humidity_2m_mean", "weather_category",
                   "impact_score", "persistence_alert_level")
    per = days.groupBy("city").agg(F.array_sort(F.collect_list(F.struct(F.col("time").alias("_t"), day.alias("d"))))
                                   .alias("_days"))
    return per.select(F.create_map("city", F.transform("_days", lambda x: x["d"])).alias("cities"))


def city_forecast(days: DataFrame) -> DataFrame:
    """The forecast panel of every city: 7 projected fields, the first day is the headline."""
    w = Window.partitionBy("city").orderBy("date")
    return days.select(
        "city", "date", F.col("temperature_2m_max").alias("temp_max"),
        F.col("temperature_2m_min").alias("temp_min"), F.col("relative_humidity_2m_mean").alias("humidity"),
        F.col("weather_category").alias("condition"), F.col("impact_score").alias("impact"),
        F.col("persistence_alert_level").alias("alert"),
        (F.row_number().over(w) == 1).alias("is_headline"))


def seasonal_box(history: DataFrame, value: str = "temperature_2m_max", last: int = 4) -> DataFrame:
    """Box statistics of the last ``last`` (season year, season) buckets of each city."""
    v = history.filter(F.col(value).isNotNull()).select(
        "city", value, cal.season_year("time").alias("season_year"),
        cal.season(F.month("time"), cal.LABELS_TITLE).alias("season"))
    buckets = ag.last_season_buckets(history.filter(F.col(value).isNotNull()), last)
    kept = v.join(buckets, ["city", "season_year", "season"])
    return ag.five_number(kept, value, ["city", "season_year", "season"])


def seasonal_kruskal(history: DataFrame, value: str = "temperature_2m_max", last: int = 4) -> DataFrame:
    """Kruskal-Wallis H across a city's last season buckets (mid-ranks within the city,
    no tie correction); p from chi-square with (buckets - 1) dof."""
    v = history.filter(F.col(value).isNotNull()).select(
        "city", value, cal.season_year("time").alias("season_year"),
        cal.season(F.month("time"), cal.LABELS_TITLE).alias("season"))
    buckets = ag.last_season_buckets(history.filter(F.col(value).isNotNull()), last)
    kept = v.join(buckets, ["city", "season_year", "season"])
    rank = (F.rank().over(Window.partitionBy("city").orderBy(value))
            + (F.count(F.lit(1)).over(Window.partitionBy("city", value)) - 1) / 2.0)
    r = kept.withColumn("_r", rank)
    g = r.groupBy("city", "season_year", "season").agg(F.sum("_r").alias("R"), F.count(F.lit(1)).alias("ng"))
    s = g.groupBy("city").agg(F.sum("ng").alias("N"), F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("_s"),
                              F.count(F.lit(1)).alias("k"))
    h = F.lit(12.0) / (F.col("N") * (F.col("N") + 1)) * F.col("_s") - 3 * (F.col("N") + 1)
    return s.filter(F.col("k") >= 2).select("city", "N", "k", h.alias("H"), (F.col("k") - 1).alias("dof"))


def decomposition(history: DataFrame, value: str = "temperature_2m_mean", fallback: str = "temperature_2m_max",
                  key="city", order="time") -> DataFrame:
    """Additive decomposition with a per-city period P = min(365, max(7, n // 2)):
    trend = centred mean of the 2 (P // 2) + 1 rows around each row (null near both ends),
    seasonal = mean detrended value of the same day-of-year, residual = obs - trend - seasonal.

    Series of two years and more share P = 365, so their trend is one window of fixed width.
    P of shorter series differs per city: theirs comes from prefix sums joined at i +- half."""
    obs = F.coalesce(F.col(value), F.col(fallback))
    w = series_window(key, order)
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = history.select(
        key, order, obs.alias("obs"), F.row_number().over(w).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    base = base.withColumn("half", F.floor(F.least(F.lit(365), F.greatest(F.lit(7), F.floor(F.col("n") / 2))) / 2))
    inside = (F.col("i") > F.col("half")) & (F.col("i") <= F.col("n") - F.col("half"))
    around = F.avg("obs").over(Window.partitionBy(key).orderBy(order).rowsBetween(-182, 182))
    t = base.withColumn("_around", around)
    long = t.filter("n >= 730").select(key, order, "obs", F.when(inside, F.col("_around")).alias("trend"))
    base = base.filter("n < 730")
    pref = base.select(key, F.col("i").alias("j"), F.sum("obs").over(run).alias("S"),
                       F.count("obs").over(run).alias("C"))
    hi = pref.select(key, F.col("j").alias("_hi"), F.col("S").alias("S_hi"), F.col("C").alias("C_hi"))
    lo = pref.select(key, F.col("j").alias("_lo"), F.col("S").alias("S_lo"), F.col("C").alias("C_lo"))
    t = (base.withColumn("_hi", F.col("i") + F.col("half")).withColumn("_lo", F.col("i") - F.col("half") - 1)
         .join(hi, [key, "_hi"], "left").join(lo, [key, "_lo"], "left"))
    cnt = F.col("C_hi") - F.coalesce(F.col("C_lo"), F.lit(0))
    trend = F.when(inside & (cnt > 0), (F.col("S_hi") - F.coalesce(F.col("S_lo"), F.lit(0.0))) / cnt)
    t = long.unionByName(t.select(key, order, "obs", trend.alias("trend")))
    detr = F.col("obs") - F.col("trend")
    seasonal = F.avg(detr).over(Window.partitionBy(key, F.dayofyear(order)))
    out = t.withColumn("seasonal", seasonal)
    resid = F.when(F.col("obs").isNotNull() & F.col("trend").isNotNull() & F.col("seasonal").isNotNull(),
                   F.col("obs") - F.col("trend") - F.col("seasonal"))
    return out.withColumn("residual", resid)


def yoy_long(history: DataFrame, value: str = "temperature_2m_mean",
             fallback: str = "temperature_2m_max") -> DataFrame:
    """(city, day-of-year 1..365, year, value): mean (else max) temperature of every year of
    the data, last write wins."""
    v = history.select("city", "time", F.dayofyear("time").alias("day_of_year"),
                       F.coalesce(F.col(value), F.col(fallback)).alias("_v"))
    return align_by_year_long(v.filter(F.col("day_of_year") <= 365), "_v")


def yoy_matrix(history: DataFrame, years, value: str = "temperature_2m_mean",
               fallback: str = "temperature_2m_max") -> DataFrame:
    """View of ``yoy_long`` with one column per year of an explicit list."""
    return (yoy_long(history, value, fallback).groupBy("city", "day_of_year")
            .pivot("year", list(years)).agg(F.first("value"))
            .select("city", "day_of_year", *[F.col(str(y)).alias(f"y{y}") for y in years]))


def calendar_heatmap(history: DataFrame, value: str = "temperature_2m_mean") -> DataFrame:
    """(year, doy 1..366) cells of the mean temperature, scaled 0..1 by the city's own
    minimum and maximum (a range of 0 scales by 1)."""
    v = history.filter(F.col(value).isNotNull()).select(
        "city", "time", F.year("time").alias("year"), F.dayofyear("time").alias("day_of_year"),
        F.col(value).alias("value"))
    cell = v.groupBy("city", "year", "day_of_year").agg(F.max_by("value", "time").alias("value"))
    w = Window.partitionBy("city")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    rng = F.when(hi - lo != 0, hi - lo).otherwise(F.lit(1.0))
    return cell.withColumn("scaled", (F.col("value") - lo) / rng)


def doy_smoothing(history: DataFrame, value: str = "temperature_2m_max", half: int = 3) -> DataFrame:
    """Per (city, year): a 365-slot day-of-year grid, centred mean over +-``half`` slots of the
    values present; empty slots take their neighbours' mean."""
    v = history.select("city", F.year("time").alias("year"), F.dayofyear("time").alias("day_of_year"),
                       F.col(value).alias("_v"), "time").filter(F.col("day_of_year") <= 365)
    cells = v.groupBy("city", "year", "day_of_year").agg(F.max_by("_v", "time").alias("value"))
    grid = (v.select("city", "year").distinct()
            .select("city", "year", F.explode(F.sequence(F.lit(1), F.lit(365))).alias("day_of_year")))
    g = grid.join(cells, ["city", "year", "day_of_year"], "left")
    w = Window.partitionBy("city", "year").orderBy("day_of_year").rowsBetween(-half, half)
    return g.withColumn("smoothed", F.avg("value").over(w))
