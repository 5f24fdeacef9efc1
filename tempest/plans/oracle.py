"""SQL text shared by the oracle queries (DuckDB dialect, plain window/aggregate SQL)."""

from __future__ import annotations

from tempest.schemas import RAW_COLUMNS, MEASURES
from tempest.sources import fixtures as fx

W_CITY = "PARTITION BY city ORDER BY time"

# the repair rules of the raw columns, written out so that the oracle stands on its own
REPAIR = {
    "latitude": "interpolate", "longitude": "interpolate",
    "temperature_2m_max": "ffill", "temperature_2m_min": "ffill", "temperature_2m_mean": "ffill", "apparent_temperature_max": "ffill",
    "precipitation_sum": "zero", "rain_sum": "zero", "snowfall_sum": "zero",
    "wind_speed_10m_max": "interpolate", "wind_gusts_10m_max": "interpolate", "relative_humidity_2m_mean": "interpolate",
    "cloud_cover_mean": "interpolate", "pressure_msl_mean": "interpolate", "shortwave_radiation_sum": "interpolate",
}
DOUBLE_RAW = ["latitude", "longitude", *MEASURES]


def with_panels(body: str, **ctes: str) -> str:
    if not ctes:
        return body
    parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


def rounded_select(cols_double, cols_other=(), src="t") -> str:
    items = list(cols_other) + [f"ROUND({c}, 6) AS {c}" for c in cols_double]
    return f"SELECT {', '.join(items)} FROM {src}"


def repaired_sql(src: str = "p") -> str:
    """handle_missing with the default strategy, then drop rows still holding a null."""
    strat = REPAIR
    items = ["city", "time"]
    for c in RAW_COLUMNS[2:]:
        m = strat.get(c)
        if m == "ffill":
            items.append(
                f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER ({W_CITY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
                f"FIRST_VALUE({c} IGNORE NULLS) OVER ({W_CITY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")
        elif m == "zero":
            items.append(f"COALESCE({c}, 0.0) AS {c}")
        elif m == "interpolate":
            pi = f"LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN _pos END IGNORE NULLS) OVER ({W_CITY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            pv = f"LAST_VALUE({c} IGNORE NULLS) OVER ({W_CITY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            ni = f"FIRST_VALUE(CASE WHEN {c} IS NOT NULL THEN _pos END IGNORE NULLS) OVER ({W_CITY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
            nv = f"FIRST_VALUE({c} IGNORE NULLS) OVER ({W_CITY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
            items.append(
                f"CASE WHEN {c} IS NOT NULL THEN {c} "
                f"WHEN {pv} IS NOT NULL AND {nv} IS NOT NULL THEN {pv} + ({nv} - {pv}) * (_pos - {pi}) / ({ni} - {pi}) "
                f"ELSE COALESCE({pv}, {nv}) END AS {c}")
        else:
            items.append(c)
    inner = (f"SELECT {', '.join(items)} FROM (SELECT *, ROW_NUMBER() OVER ({W_CITY}) AS _pos FROM {src}) s")
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLUMNS)
    return f"SELECT * FROM ({inner}) r WHERE {not_null}"


def season_case(month: str = "month(time)") -> str:
    return (f"CASE WHEN {month} IN (12, 1, 2) THEN 'winter' WHEN {month} IN (3, 4, 5) THEN 'spring' "
            f"WHEN {month} IN (6, 7, 8) THEN 'summer' WHEN {month} IN (9, 10, 11) THEN 'autumn' END")


FEATURE_DOUBLES = [
    "temperature_2m_mean_7d", "temperature_2m_mean_30d", "precipitation_sum_7d",
    "precipitation_sum_30d", "temperature_range", "HDD", "CDD",
    "temperature_2m_mean_lag1", "temperature_2m_mean_lag2", "precipitation_sum_lag1",
    "precipitation_sum_lag2", "anomaly_score",
]
FEATURE_OTHER = ["month", "quarter", "day_of_year", "season"]


def features_sql(src: str) -> str:
    t, p = "temperature_2m_mean", "precipitation_sum"

    def roll(c, w):
        return f"AVG({c}) OVER ({W_CITY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"

    def pos(x):
        return f"CASE WHEN {x} IS NOT NULL THEN GREATEST({x}, 0.0) END"

    items = [
        "*",
        f"{roll(t, 7)} AS {t}_7d", f"{roll(t, 30)} AS {t}_30d",
        f"{roll(p, 7)} AS {p}_7d", f"{roll(p, 30)} AS {p}_30d",
        "CAST(month(time) AS INTEGER) AS month", "CAST(quarter(time) AS INTEGER) AS quarter",
        "CAST(dayofyear(time) AS INTEGER) AS day_of_year", f"{season_case()} AS season",
        "temperature_2m_max - temperature_2m_min AS temperature_range",
        f"{pos(f'18.0 - {t}')} AS HDD", f"{pos(f'{t} - 18.0')} AS CDD",
        f"LAG({t}, 1) OVER ({W_CITY}) AS {t}_lag1", f"LAG({t}, 2) OVER ({W_CITY}) AS {t}_lag2",
        f"LAG({p}, 1) OVER ({W_CITY}) AS {p}_lag1", f"LAG({p}, 2) OVER ({W_CITY}) AS {p}_lag2",
        f"{t} - AVG({t}) OVER (PARTITION BY city, dayofyear(time)) AS anomaly_score",
    ]
    return f"SELECT {', '.join(items)} FROM {src}"


def panel(grain="nation"):
    return fx.panel_sql(grain)


def nulls(grain="region"):
    return fx.panel_with_nulls_sql(grain)


# Tail probabilities as sums of the textbook power series (terms by logarithms), independent
# of the engine's continued fractions.

def gamma_q(a: str, x: str) -> str:
    """Upper regularized gamma of rows with columns or literals a, x: 1 - sum of the series."""
    return (f"CASE WHEN ({x}) <= 0 THEN 1.0 ELSE GREATEST(0.0, 1 - (SELECT SUM(exp((({a}) + i) * ln({x}) - ({x}) - lgamma(({a}) + i + 1))) "
            "FROM range(0, 60000) r(i))) END")


def beta_tail(a: str, b: str, y: str) -> str:
    """1 - I_y(a, b): the F tail with a = d1 / 2, b = d2 / 2, y = d1 F / (d2 + d1 F)."""
    return (f"CASE WHEN ({y}) <= 0 THEN 1.0 ELSE GREATEST(0.0, 1 - (SELECT SUM(exp(lgamma(({a}) + ({b}) + i) - lgamma({b}) - lgamma(({a}) + i + 1) "
            f"+ (({a}) + i) * ln({y}) + ({b}) * ln(1 - ({y})))) FROM range(0, 60000) r(i))) END")


def t_tail(t: str, df: str) -> str:
    """Two-sided p of Student's t."""
    tail = beta_tail("0.5", f"({df}) / 2.0", f"({t}) * ({t}) / (({df}) + ({t}) * ({t}))")
    return f"CASE WHEN ({t}) * ({t}) > 4000 AND ({df}) > 50 THEN 0.0 ELSE {tail} END"  # below 1e-40


def f_tail(f: str, d1: str, d2: str) -> str:
    tail = beta_tail(f"({d1}) / 2.0", f"({d2}) / 2.0", f"({d1}) * ({f}) / (({d2}) + ({d1}) * ({f}))")
    return f"CASE WHEN ({f}) > 4000 AND ({d2}) > 50 THEN 0.0 ELSE {tail} END"


def inverse_step(k: int, size: int, m: str = "m") -> str:
    """One Gauss-Jordan step in place on the nested list ``m`` (pivot k, from 1)."""
    cells = []
    for i in range(1, size + 1):
        row = []
        for j in range(1, size + 1):
            p = f"{m}[{k}][{k}]"
            row.append(f"1.0 / {p}" if i == j == k else f"{m}[{k}][{j}] / {p}" if i == k else f"-{m}[{i}][{k}] / {p}" if j == k
                       else f"{m}[{i}][{j}] - {m}[{i}][{k}] * {m}[{k}][{j}] / {p}")
        cells.append("[" + ", ".join(row) + "]")
    return "[" + ", ".join(cells) + "]"


def inverse_ctes(source: str, size: int, keep: str, prefix: str = "inv") -> dict:
    """CTEs that invert the matrix ``m`` of each row of ``source``; the last holds the inverse."""
    out, prev = {}, source
    for k in range(1, size + 1):
        out[f"{prefix}{k}"] = f"SELECT {keep}, {inverse_step(k, size)} AS m FROM {prev}"
        prev = f"{prefix}{k}"
    return out
