"""Explicit schemas for every layer (no inference anywhere)."""

from pyspark.sql import types as T

# Measures of the daily panel, in the order of the raw layer.
MEASURES = [
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
    "apparent_temperature_max",
    "precipitation_sum", "rain_sum", "snowfall_sum",
    "wind_speed_10m_max", "wind_gusts_10m_max",
    "relative_humidity_2m_mean", "cloud_cover_mean",
    "pressure_msl_mean", "shortwave_radiation_sum",
]

RAW_COLUMNS = ["city", "time", "latitude", "longitude", *MEASURES, "weather_code"]

DAILY = T.StructType(
    [T.StructField("city", T.StringType()), T.StructField("time", T.DateType()),
     T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
    + [T.StructField("weather_code", T.IntegerType())]
)

# Landed CSV files carry the date as text; it becomes DateType at the boundary.
DAILY_CSV = T.StructType(
    [T.StructField("time", T.StringType()), T.StructField("city", T.StringType()),
     T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
    + [T.StructField("weather_code", T.DoubleType())]
)

CITY_DIM = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("districts", T.ArrayType(T.StringType())),
])

GAP_REPORT = T.StructType([
    T.StructField("city", T.StringType()), T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()), T.StructField("expected_days", T.IntegerType()),
    T.StructField("actual_days", T.IntegerType()), T.StructField("missing_count", T.IntegerType()),
    T.StructField("missing_dates", T.ArrayType(T.DateType())),
])

QUALITY_RESULT = T.StructType([
    T.StructField("check_name", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("details", T.StringType()),
])

AUDIT_RUN = T.StructType([
    T.StructField("run_id", T.IntegerType()), T.StructField("run_at", T.TimestampType()),
    T.StructField("mode", T.StringType()), T.StructField("cities_count", T.IntegerType()),
    T.StructField("rows_raw", T.LongType()), T.StructField("rows_staging", T.LongType()),
    T.StructField("rows_analytics", T.LongType()), T.StructField("duration_sec", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("notes", T.StringType()),
])

FORECAST_DAY = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("temperature_2m_max", T.DoubleType()),
    T.StructField("temperature_2m_min", T.DoubleType()),
    T.StructField("relative_humidity_2m_mean", T.DoubleType()),
    T.StructField("weather_category", T.StringType()),
    T.StructField("impact_score", T.DoubleType()),
    T.StructField("persistence_alert_level", T.IntegerType()),
])
FORECAST_DOC = T.StructType([
    T.StructField("cities", T.MapType(T.StringType(), T.ArrayType(FORECAST_DAY))),
])

ENERGY_HOUR = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()), T.StructField("hour", T.IntegerType()),
    T.StructField("Envision_wind_kWh", T.DoubleType()),
    T.StructField("Fuhrlander_wind_kWh", T.DoubleType()),
    T.StructField("Jinko_Solar_kWh", T.DoubleType()),
    # the same series under the name used in the project documentation
    T.StructField("Jinko_Solar_solar_kWh", T.DoubleType()),
    T.StructField("Trina_Solar_kWh", T.DoubleType()),
])
ENERGY_DOC = T.StructType([
    T.StructField("locations", T.MapType(T.StringType(), T.ArrayType(ENERGY_HOUR))),
    T.StructField("model_metrics", T.ArrayType(T.StructType([
        T.StructField("target", T.StringType()), T.StructField("test_r2", T.DoubleType()),
        T.StructField("test_rmse", T.DoubleType()),
    ]))),
])

HOURLY = T.StructType([
    T.StructField("city", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("wind_speed_10m", T.DoubleType()), T.StructField("temperature_2m", T.DoubleType()),
    T.StructField("shortwave_radiation", T.DoubleType()), T.StructField("is_day", T.IntegerType()),
])

# Columns the feature layer must produce (gate Q5), names of temperatures and
# of columns with outlier flags.
REQUIRED_FEATURES = [
    "temperature_2m_mean_7d", "temperature_2m_mean_30d",
    "precipitation_sum_7d", "precipitation_sum_30d",
    "month", "quarter", "day_of_year", "season",
    "temperature_range", "HDD", "CDD", "anomaly_score",
    "temperature_2m_mean_lag1", "temperature_2m_mean_lag2",
    "precipitation_sum_lag1", "precipitation_sum_lag2",
]

TEMPERATURE_COLUMNS = [
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
    "apparent_temperature_max",
]

OUTLIER_COLUMNS = [
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
    "precipitation_sum", "wind_speed_10m_max", "wind_gusts_10m_max",
    "pressure_msl_mean", "shortwave_radiation_sum", "apparent_temperature_max",
]

# Fixed values of the missing-value repair: measures whose name holds one of these words take
# the last value, the named sums become zero, other measures are interpolated.
FILLED_FORWARD = ("temperature", "apparent")
ZERO_FILLED = ("precipitation_sum", "rain_sum", "snowfall_sum")
UNREPAIRED = ("city", "time", "weather_code")
