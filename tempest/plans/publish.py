"""Publish the dashboard marts for every city from the stored layers.

Each mart is a DataFrame job over the raw historical and forecast layers and is written as
its own Parquet dataset under ``<base>/marts/<name>``; the dashboard reads one city's rows
with a pushed-down filter instead of running statistics per request.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tempest.operators import aggregates as ag
from tempest.operators import marts as mt
from tempest.operators.features import autocorrelation, every_kth
from tempest.operators.stats import qq_fit, qq_points, correlation_pairs, strong_pairs
from tempest.sources import files

CORR_VARS = ["temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
             "relative_humidity_2m_mean", "wind_speed_10m_max", "shortwave_radiation_sum"]


def build_marts(hist, fc, sample_step: int = 5) -> dict:
    """Every mart by name; the scatter sample keeps each ``sample_step``-th day of a city."""
    history, days = mt.city_history(hist, fc), mt.forecast_rows(fc).withColumnRenamed("time", "date")
    points = qq_points(history, "temperature_2m_max")
    sample = every_kth(history.select("city", "time", "temperature_2m_max", "relative_humidity_2m_mean"), sample_step)
    return {
        "city_forecast": mt.city_forecast(days),
        "city_history_or_forecast": mt.history_fallback(history, days),
        "qq_points": points,
        "autocorrelation": autocorrelation(history.filter("temperature_2m_max IS NOT NULL"), "temperature_2m_max"),
        "scatter_sample": sample,
        "city_latest": mt.city_latest(fc),
        "city_history": history,
        "seasonal_box": mt.seasonal_box(history),
        "seasonal_kruskal": mt.seasonal_kruskal(history),
        "decomposition": mt.decomposition(history),
        "year_over_year": mt.yoy_long(history),
        "calendar_heatmap": mt.calendar_heatmap(history),
        "doy_smoothing": mt.doy_smoothing(history),
        "qq_fit": qq_fit(points),
        "strong_pairs": strong_pairs(correlation_pairs(history, CORR_VARS)),
    }


def publish_marts(spark: SparkSession, base: str, energy: str | None = None) -> dict:
    """Read the raw layers under ``base`` (and the energy documents at ``energy``, one per
    line) and write every mart; returns the mart paths."""
    hist = spark.read.parquet(f"{base.rstrip('/')}/raw_historical").drop("year")
    fc = spark.read.parquet(f"{base.rstrip('/')}/raw_forecast").drop("year")
    marts, paths = build_marts(hist, fc), {}
    if energy:
        hours, metrics = files.read_energy_json(spark, energy, multi_line=False)
        daily = ag.energy_daily(hours)
        marts |= {"city_energy": daily, "city_energy_totals": ag.energy_totals(daily), "energy_models": ag.pick_model_metrics(metrics)}
    for name, df in marts.items():
        path = f"{base.rstrip('/')}/marts/{name}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths


def publish_from_frames(spark: SparkSession, base: str, hist, fc, energy: str | None = None) -> dict:
    files.replace_all(hist, f"{base.rstrip('/')}/raw_historical")
    files.replace_all(fc, f"{base.rstrip('/')}/raw_forecast")
    return publish_marts(spark, base, energy)
