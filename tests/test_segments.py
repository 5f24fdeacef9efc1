"""Ranks by ranges, partners by codes, joins on time, lasso by sums."""
import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tempest.operators import models as md
from tempest.operators import partners as pt
from tempest.operators import segments as sg
from tempest.operators import stats as st
from tempest.operators import temporal as tm


def hot(spark, n=3000):
    """One city with nine rows of ten, a frequent value, nulls."""
    rows = [("hot" if i % 10 else f"c{i % 3}", float(i * 37 % 50) if i % 3 else 0.0, None if i % 11 == 0 else float(i * i % 17)) for i in range(n)]
    return spark.createDataFrame([*rows, ("one", 1.0, None), ("none", None, None), (None, 1.0, 1.0)], "city string, a double, b double")


def near(x, y):
    return (x is None or math.isnan(x)) and (y is None or math.isnan(y)) or abs(x - y) < 1e-9


def test_split_forms_equal_the_windows(spark, monkeypatch):
    df = hot(spark)
    monkeypatch.setattr(sg, "PIECE", 100)
    known = df.filter("city is not null")
    want = {(r["city"], r["var_a"]): r["r"] for r in st.spearman_pairs(known, ["a", "b"]).collect()}
    got = {(r["city"], r["var_a"]): r["r"] for r in sg.spearman_pairs_split(known, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)
    points = lambda d: sorted((r["city"], r["sample"], round(r["theoretical"], 9)) for r in d.collect())
    assert points(sg.qq_points_split(known, "a")) == points(st.qq_points(known, "a"))
    assert sg.group_mid_ranks(df.filter("false"), "city", "a").count() == 0


def test_adjustment_of_one_large_family(spark):
    rows = [("big" if i % 20 else f"f{i % 4}", i, (i * 7919 % 1000) / 1000.0) for i in range(4000)]
    tests = spark.createDataFrame([*rows, ("big", 5000, None)], "family string, id long, p double")
    want = {r["id"]: (r["p_bonferroni"], r["p_bh"]) for r in st.p_adjust(tests.filter("p is not null")).collect()}
    got = {r["id"]: (r["p_bonferroni"], r["p_bh"]) for r in sg.p_adjust_split(tests).collect()}
    assert got.pop(5000)[1] in (None, 1.0) and all(near(a, b) for k in want for a, b in zip(got[k], want[k]))
    assert len(got) == len(want)


def test_partners_recall_and_growth(spark):
    rng = np.random.default_rng(1)
    n, days = 240, 150
    x = np.repeat(rng.normal(size=(n // 6, days)), 6, 0) + rng.normal(size=(n, days)) * rng.uniform(0.4, 1.6, (n, 1))
    x[::7] *= -1  # strong negative partners too
    rows = pd.DataFrame({"city": np.repeat([f"c{i:03}" for i in range(n)], days), "day": np.tile(np.arange(days), n), "v": x.ravel()})
    df = spark.createDataFrame(rows).selectExpr("city", "date_add(date'2020-01-01', cast(day as int)) as time", "v")
    got = {(r["city"], r["partner"]): r["r"] for r in pt.city_partners(df, "v", top=3, least=0.4).collect()}
    c = np.corrcoef(x) - 2 * np.eye(n)
    want = {(f"c{i:03}", f"c{j:03}"): c[i, j] for i in range(n) for j in sorted(range(n), key=lambda j: -abs(c[i, j]) if j != i else 9)[:3] if abs(c[i, j]) >= 0.4}
    assert len(want) > 300 and sum(k in got for k in want) >= 0.97 * len(want)
    assert all(near(got[k], want[k]) for k in want if k in got)
    bits = [pt.banding(n, 0.4, 0.99)[0] for n in (100, 10_000, 1_000_000)]
    assert bits[0] < bits[1] <= bits[2]
    constant = df.withColumn("v", F.lit(1.0))
    assert pt.city_partners(constant, "v").count() == 0 and pt.city_partners(df.filter("false"), "v").count() == 0


def test_asof_join_edges(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    left = spark.createDataFrame([("a", t(1), 1), ("a", t(2), 2), ("a", t(20), 3), ("b", t(5), 4), (None, t(5), 5), ("a", None, 6), ("a", t(2), 2)], "city string, time timestamp, x int")
    right = spark.createDataFrame([("a", t(2), 10), ("a", t(2), 11), ("a", t(1, 5), 9), ("c", t(1), 7), (None, t(1), 8)], "city string, time timestamp, y int")
    for period in (3600, 86400, 400 * 86400):
        got = sorted(((r["x"], r["y_asof"]) for r in tm.asof_join(left, right, period=period).collect()), key=str)
        assert got == [(1, None), (2, 11), (2, 11), (3, 11), (4, None), (5, None), (6, None)]
    got = {r["x"]: r["y_asof"] for r in tm.asof_join(left, right, tolerance=86400, period=86400).collect()}
    assert got[2] == 11 and got[3] is None


def test_interval_join_edges(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    points = spark.createDataFrame([("a", d(i), i) for i in range(0, 60, 5)] + [("b", d(3), -1), ("a", None, -2)], "city string, time date, x int")
    spans = spark.createDataFrame([("a", d(5), d(40), "long"), ("a", d(20), d(20), "one"), ("a", d(9), d(8), "turned"), ("a", d(1), None, "open"), ("c", d(0), d(50), "c")],
                                  "city string, start date, end date, name string")
    for days in (1, 16, 400):
        got = sorted((r["x"], r["name"]) for r in tm.interval_join(points, spans, days=days).collect())
        assert got == sorted([(i, "long") for i in range(5, 41, 5)] + [(20, "one")])


def test_lasso_conditions(spark):
    """At the optimum the gradient equals the penalty on used features and is below it on the others."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    x[:, 3] = x[:, 0] * 0.9 + 0.1 * x[:, 3]
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=400) + 4
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=[*"abcde", "y"]))
    g = md.fold_sums(df.withColumn("fold", F.lit(0)), list("abcde"), "y", 1)["sums"][0]
    z = (x - x.mean(0)) / x.std(0)
    for alpha in (0.01, 0.3, 5.0):
        intercept, beta = md.lasso_from_sums(g, alpha)
        pull = z.T @ (y - intercept - z @ beta) / 400
        assert np.allclose(pull[beta != 0], alpha * np.sign(beta[beta != 0]), atol=1e-9) and (abs(pull) <= alpha + 1e-9).all()
    path = md.lasso_path(df, df, alphas=(0.01, 5.0), features=list("abcde"), label="y")
    assert [r["alpha"] for r in path] == [0.01, 5.0] and path[1]["zeroed"] == 5 and path[0]["rmse"] < 0.4
