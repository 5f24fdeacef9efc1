import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tempest.operators import cleaning as cl
from tempest.operators import features as fe
from tempest.operators import quality as qa

D0 = dt.date(2020, 1, 1)


def series(spark, values, city="a", start=D0, step=1):
    data = [(city, start + dt.timedelta(days=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "city string, time date, x double")


def test_interpolation_matches_pandas_positional(spark):
    vals = [None, 1.0, None, None, 4.0, 10.0, None, None]
    got = [r[0] for r in cl.handle_missing(series(spark, vals), {"x": "interpolate"}, drop_remaining=False)
           .orderBy("time").select("x").collect()]
    want = pd.Series(vals, dtype=float).interpolate(method="linear", limit_direction="both").tolist()
    assert np.allclose(got, want)


def test_ffill_then_bfill_and_zero(spark):
    df = series(spark, [None, 2.0, None, 5.0, None])
    got = [r[0] for r in cl.handle_missing(df, {"x": "ffill"}).orderBy("time").select("x").collect()]
    assert got == [2.0, 2.0, 2.0, 5.0, 5.0]
    got = [r[0] for r in cl.handle_missing(df, {"x": "zero"}).orderBy("time").select("x").collect()]
    assert got == [0.0, 2.0, 0.0, 5.0, 0.0]


def test_all_null_column_rows_dropped(spark):
    df = series(spark, [None, None, None])
    assert cl.handle_missing(df, {"x": "interpolate"}).count() == 0


def test_zscore_zero_variance_never_flags(spark):
    df = series(spark, [3.0, 3.0, 3.0, 3.0])
    flags = [r[0] for r in cl.flag_outliers(df, ["x"], "zscore", 1.0).select("x_outlier_flag").collect()]
    assert flags == [False] * 4


def test_iqr_flags_match_pandas(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 2.0, 40.0, 2.2, -30.0]
    flags = [r[0] for r in cl.flag_outliers(series(spark, vals), ["x"]).orderBy("time").select("x_outlier_flag").collect()]
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    want = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).tolist()
    assert flags == want


def test_stuck_sensor_three_equal_days_and_jump(spark):
    df = series(spark, [5.0, 5.0, 5.0, 7.0, 23.0, 23.5])
    out = df.select("time", fe.stuck_sensor_flag("x").alias("stuck"), fe.jump_size("x").alias("jump")).orderBy("time").collect()
    # diff().fillna(0) == 0 -> [1, 1, 1, 0, 0, 0]; rolling(3).sum() >= 2 with a full window:
    # row 2 (3 zeros) and row 3 (2 zeros, the "2 of 3" rule) are flagged
    assert [r["stuck"] for r in out] == [False, False, True, True, False, False]
    assert [r["jump"] is not None and r["jump"] > 15 for r in out] == [False, False, False, False, True, False]


def test_gap_of_three_passes_four_warns(spark):
    d = [("a", D0, 1.0), ("a", D0 + dt.timedelta(days=3), 1.0), ("b", D0, 1.0), ("b", D0 + dt.timedelta(days=4), 1.0)]
    df = spark.createDataFrame(d, "city string, time date, x double")
    r = qa.check_date_continuity(df, "s").first()
    assert r["status"] == "WARN" and r["details"] == "limit=3 cities=1 worst=b gap=4"


def test_value_range_edges(spark):
    df = spark.createDataFrame([(-50.0,), (-50.1,)], "temperature_2m_max double")
    r = qa.check_value_ranges(df, "s").first()
    assert r["status"] == "WARN" and r["details"].endswith("outside=1")


def test_empty_layer_fails_row_count(spark):
    df = spark.createDataFrame([], "city string, time date, x double")
    assert qa.check_row_count(df, "raw").first()["status"] == "FAIL"


def test_gap_report_lists_missing_dates(spark):
    d = [("a", D0, 1.0), ("a", D0 + dt.timedelta(days=3), 1.0), ("one", D0, 2.0)]
    g = {r["city"]: r for r in cl.date_gaps(spark.createDataFrame(d, "city string, time date, x double")).collect()}
    assert g["a"]["missing_count"] == 2 and g["a"]["missing_dates"] == [D0 + dt.timedelta(days=1), D0 + dt.timedelta(days=2)]
    assert g["one"]["expected_days"] == 1 and g["one"]["missing_dates"] == []


def test_approximate_quartiles_close_to_exact(spark):
    vals = [float(v % 37) + (v % 5) * 0.1 for v in range(500)]
    df = series(spark, vals)
    exact = cl.flag_outliers(df, ["x"]).select("x_outlier_flag").collect()
    approx = cl.flag_outliers(df, ["x"], approx=True).select("x_outlier_flag").collect()
    assert sum(r[0] != s[0] for r, s in zip(exact, approx)) <= 5


def test_repair_rules_by_name():
    from tempest.operators.cleaning import default_strategy

    assert default_strategy(["soil_temperature", "apparent_max", "precipitation_sum_7d", "rain_sum", "weather_code", "humidity"]) == {
        "soil_temperature": "ffill", "apparent_max": "ffill", "precipitation_sum_7d": "interpolate", "rain_sum": "zero", "humidity": "interpolate"}
