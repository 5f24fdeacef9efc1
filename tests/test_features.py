import datetime as dt

import numpy as np
import pandas as pd

from tempest.operators import features as fe
from tests.conftest import SMALL

D0 = dt.date(2021, 1, 1)


def test_rolling_counts_rows_not_days(spark):
    # a 10-day gap does not shrink the 3-row window
    dates = [D0, D0 + dt.timedelta(days=1), D0 + dt.timedelta(days=11), D0 + dt.timedelta(days=12)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(dates)], "city string, time date, x double")
    got = [r[0] for r in df.select(fe.rolling_mean("x", 3)).collect()]
    want = pd.Series([0.0, 1.0, 2.0, 3.0]).rolling(3, min_periods=1).mean().tolist()
    assert np.allclose(got, want)
    cal = [r[0] for r in df.orderBy("time").select(fe.calendar_rolling_mean("x", 3)).collect()]
    assert np.allclose(cal, [0.0, 0.5, 2.0, 2.5])


def test_persistence_first_two_rows_zero_per_city(spark):
    d = [("a", D0 + dt.timedelta(days=i), 40.0) for i in range(4)] + [("b", D0, 40.0)]
    df = spark.createDataFrame(d, "city string, time date, temperature_2m_max double")
    out = {(r["city"], r["time"]): r["p"] for r in df.select("city", "time", fe.persistence_alert_level().alias("p")).collect()}
    assert [out[("a", D0 + dt.timedelta(days=i))] for i in range(4)] == [0, 0, 3, 3]
    assert out[("b", D0)] == 0


def test_anomaly_includes_the_row_itself(spark):
    d = [("a", dt.date(2020, 2, 1), 10.0), ("a", dt.date(2021, 2, 1), 20.0)]  # day 32 in both years
    df = spark.createDataFrame(d, "city string, time date, temperature_2m_mean double")
    f = fe.compute_all_features(df.selectExpr("*", "0.0 as precipitation_sum", "0.0 as temperature_2m_max",
                                              "0.0 as temperature_2m_min"))
    assert sorted(r["anomaly_score"] for r in f.collect()) == [-5.0, 5.0]


def test_extreme_runs_islands(spark):
    vals = [36, 37, 20, 38, 39, 40, 10]
    d = [("a", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(d, "city string, time date, t double")
    runs = sorted(r["run_length"] for r in fe.extreme_runs(df, df.t > 35).collect())
    assert runs == [2, 3]


def test_feature_layer_uses_one_exchange_on_city(spark):
    from tempest.operators.cleaning import handle_missing
    from tempest.sources import fixtures as fx

    staged = handle_missing(fx.panel_with_nulls(spark, SMALL, "region"))
    f = fe.compute_all_features(staged)
    plan = f._jdf.queryExecution().executedPlan().toString()
    # the fixture aggregation shuffles by (city, key, day); the window layer adds exactly one
    # exchange on city, shared by every series window and the (city, day_of_year) window
    keys = [l.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1]
            for l in plan.splitlines() if "Exchange hashpartitioning(" in l]
    on_city_only = [k for k in keys if len(k) == 1 and k[0].startswith("city#")]
    assert len(on_city_only) == 1, plan
    assert "SinglePartition" not in plan
