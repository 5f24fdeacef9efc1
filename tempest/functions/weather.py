"""Weather indices, flags and label mappings as Catalyst expressions.

Null rule: pandas arithmetic keeps NaN while Spark's ``greatest``/``least`` skip nulls,
so every clipped quantity is wrapped in ``when(x.isNotNull())`` to keep a null input null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positive_part(x) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def temperature_range(tmax="temperature_2m_max", tmin="temperature_2m_min") -> Column:
    return _c(tmax) - _c(tmin)


def heating_degree_days(t="temperature_2m_mean", base: float = 18.0) -> Column:
    return positive_part(F.lit(base) - _c(t))


def cooling_degree_days(t="temperature_2m_mean", base: float = 18.0) -> Column:
    return positive_part(_c(t) - F.lit(base))


def flag_positive(x) -> Column:
    """1 when x > 0, else 0; a null compares false and gives 0."""
    return F.coalesce((_c(x) > 0).cast("int"), F.lit(0))


def flag_equals(x, value) -> Column:
    return F.coalesce((_c(x) == value).cast("int"), F.lit(0))


def safe_ratio(part, whole) -> Column:
    """part / whole; zero or null denominator gives null."""
    return F.try_divide(_c(part), F.when(_c(whole) != 0, _c(whole)))


def heat_stress_linear(tmax="temperature_2m_max", rh="relative_humidity_2m_mean") -> Column:
    return _c(tmax) * (_c(rh) / 100)


def heat_stress_quadratic(tmean="temperature_2m_mean", rh="relative_humidity_2m_mean") -> Column:
    return _c(tmean) * (F.lit(1) + F.pow(_c(rh) / 100, 2))


# Fixed values of the impact score: thresholds and weights.
IMPACT_TEMP_THRESHOLD, IMPACT_TEMP_WEIGHT = 30.0, 3.0
IMPACT_WIND_THRESHOLD, IMPACT_WIND_WEIGHT = 20.0, 2.0
IMPACT_HUMIDITY_THRESHOLD, IMPACT_HUMIDITY_POINTS = 70.0, 10.0
IMPACT_CAP = 100.0


def impact_score(tmax="temperature_2m_max", wind="wind_speed_10m_max",
                 rh="relative_humidity_2m_mean") -> Column:
    """min(100, 3*(Tmax-30)+ + 2*(wind-20)+ + 10*[RH>70]); a null operand contributes 0."""
    t, w, h = _c(tmax), _c(wind), _c(rh)
    temp = F.when(t > IMPACT_TEMP_THRESHOLD, (t - IMPACT_TEMP_THRESHOLD) * IMPACT_TEMP_WEIGHT).otherwise(0.0)
    windp = F.when(w > IMPACT_WIND_THRESHOLD, (w - IMPACT_WIND_THRESHOLD) * IMPACT_WIND_WEIGHT).otherwise(0.0)
    hum = F.when(h > IMPACT_HUMIDITY_THRESHOLD, F.lit(IMPACT_HUMIDITY_POINTS)).otherwise(0.0)
    return F.least(F.lit(IMPACT_CAP), temp + windp + hum)


def wind_temp_interaction(tmax="temperature_2m_max", wind="wind_speed_10m_max") -> Column:
    return _c(tmax) * _c(wind)


def extreme_heat_excess(tmax="temperature_2m_max", threshold=35.0) -> Column:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return positive_part(_c(tmax) - thr)


# WMO weather code -> category label, first match wins, default "Cloudy".
WMO_CATEGORIES = [
    ("Clear Sky", (0,)),
    ("Cloudy", (1, 2, 3)),
    ("Drizzle", (51, 53, 55, 56, 57)),
    ("Rain", (61, 63, 65, 66, 67)),
    ("Snowfall", (71, 73, 75, 77, 85, 86)),
    ("Fog", (45, 48)),
    ("Rain Showers", (80, 81, 82)),
    ("Thunderstorm", (95, 96, 99)),
]
WMO_DEFAULT = "Cloudy"


def weather_category(code="weather_code") -> Column:
    c = _c(code)
    expr = None
    for label, codes in WMO_CATEGORIES:
        cond = c.isin(*codes)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(WMO_DEFAULT))


# Condition text substring rules, checked in this order.
CONDITION_RULES = [
    (("thunder",), "Thunderstorm"),
    (("snow",), "Snowfall"),
    (("shower",), "Rain Showers"),
    (("drizzle",), "Drizzle"),
    (("rain",), "Rain"),
    (("fog", "mist"), "Fog"),
    (("cloud",), "Cloudy"),
    (("sun", "clear"), "Clear Sky"),
]
CONDITION_LABELS = [label for label, _codes in WMO_CATEGORIES]


def condition_group(text="weather_category") -> Column:
    """Exact label match first, then ordered substring rules; default Cloudy."""
    t = _c(text)
    low = F.lower(t)
    expr = F.when(t.isNull(), F.lit(WMO_DEFAULT)).when(t.isin(*CONDITION_LABELS), t)
    for subs, label in CONDITION_RULES:
        cond = None
        for s in subs:
            cond = low.contains(s) if cond is None else (cond | low.contains(s))
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(WMO_DEFAULT))


# Impact bands.
IMPACT_HIGH, IMPACT_MEDIUM = 70.0, 40.0


def impact_band(score="impact_score") -> Column:
    s = _c(score)
    return (F.when(s.isNull(), "unknown").when(s >= IMPACT_HIGH, "high")
            .when(s >= IMPACT_MEDIUM, "medium").otherwise("low"))


def persistence_alert(level="persistence_alert_level") -> Column:
    return F.coalesce(_c(level) > 0, F.lit(False))


# Column alias normalisation (source -> alias added when absent).
COLUMN_ALIASES = {
    "weather_code": "weathercode",
    "wind_speed_10m_max": "windspeed_10m_max",
    "cloud_cover_mean": "cloudcover_mean",
}


def add_column_aliases(df, aliases: dict | None = None):
    aliases = aliases or COLUMN_ALIASES
    for src, dst in aliases.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumn(dst, F.col(src))
    return df


# Spelling repairs applied after title-casing a city name.
CITY_SPELLING_FIXES = {"Bandar-E Anzali": "Bandar-e Anzali"}


def canonical_city(name="city") -> Column:
    """trim + title case; initcap capitalises only after spaces, which already gives
    the repaired spelling for hyphenated names; the explicit fixes cover the rest."""
    expr = F.initcap(F.trim(_c(name)))
    for bad, good in CITY_SPELLING_FIXES.items():
        expr = F.when(expr == bad, F.lit(good)).otherwise(expr)
    return expr


def coerce_double(x) -> Column:
    """Numeric coercion: anything that does not parse becomes null."""
    return F.expr(f"try_cast(`{x}` as double)") if isinstance(x, str) else x.try_cast("double")


def mean_temperature_fallback(mean="temperature_2m_mean", tmax="temperature_2m_max",
                              tmin="temperature_2m_min") -> Column:
    return F.coalesce(_c(mean), (_c(tmax) + _c(tmin)) / 2)


def city_search(city="city", needle: str = "") -> Column:
    return F.lower(_c(city)).contains(needle.lower())
