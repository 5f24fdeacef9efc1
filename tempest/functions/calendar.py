"""Calendar derivations as Catalyst expressions (B1-B6, B3 season year)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meteorological seasons by month and the label sets in use.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}
LABELS_LOWER = {"winter": "winter", "spring": "spring", "summer": "summer", "autumn": "autumn"}
LABELS_TITLE = {"winter": "Winter", "spring": "Spring", "summer": "Summer", "autumn": "Autumn"}
LABELS_US = {"winter": "Winter", "spring": "Spring", "summer": "Summer", "autumn": "Fall"}
# Display order of season buckets inside one season year.
SEASON_ORDER = ["spring", "summer", "autumn", "winter"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_columns(time="time") -> list[Column]:
    t = _c(time)
    return [F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
            F.quarter(t).alias("quarter"), F.dayofyear(t).alias("day_of_year")]


def season(month="month", labels: dict | None = None) -> Column:
    labels = labels or LABELS_LOWER
    m = _c(month)
    expr = None
    for key in ("winter", "spring", "summer", "autumn"):
        cond = m.isin(*SEASON_MONTHS[key])
        expr = F.when(cond, F.lit(labels[key])) if expr is None else expr.when(cond, F.lit(labels[key]))
    return expr


def season_index(month="month") -> Column:
    """Position of the month's season in SEASON_ORDER (spring=0 .. winter=3)."""
    m = _c(month)
    return (F.when(m.isin(3, 4, 5), 0).when(m.isin(6, 7, 8), 1)
            .when(m.isin(9, 10, 11), 2).otherwise(3))


def season_year(time="time") -> Column:
    """January and February belong to the winter that started the previous December."""
    t = _c(time)
    return F.when(F.month(t).isin(1, 2), F.year(t) - 1).otherwise(F.year(t))


def is_weekend(time="time") -> Column:
    return F.weekday(_c(time)).isin(5, 6).cast("int")  # weekday: Monday=0 .. Sunday=6


def doy_harmonics(doy="day_of_year", period: float = 365.25) -> list[Column]:
    angle = F.lit(2 * math.pi) * _c(doy) / F.lit(period)
    return [F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos")]


def date_ord(time="time") -> Column:
    t = _c(time)
    return F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)
