import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tempest.operators import models as md
from tempest.sources import fixtures as fx
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return md.model_table(fx.panel(spark, SMALL, "region"), (1995, 1999), 2000)


def test_ols_matches_closed_form(spark, tables):
    _, train, test = tables
    model, tr_pred, _ = md.fit_linear(train, test)
    rows = tr_pred.select(vector_to_array("features").alias("x"), md.REG_TARGET).collect()
    X = np.array([r["x"] for r in rows])
    y = np.array([r[md.REG_TARGET] for r in rows])
    # population-std scaling: every scaled column has population variance 1
    assert np.allclose(X.var(axis=0), 1.0, atol=1e-9)
    A = np.column_stack([X, np.ones(len(X))])
    beta, *_ = np.linalg.lstsq(A, y, rcond=None)
    assert np.allclose(list(model.coefficients) + [model.intercept], beta, rtol=1e-6, atol=1e-6)
    resid = y - A @ beta
    sigma2 = resid @ resid / (len(y) - A.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(A.T @ A)) * sigma2)
    assert np.allclose(model.summary.coefficientStandardErrors, se, rtol=1e-5)


def test_contiguous_folds_are_blocks(spark, tables):
    _, train, _ = tables
    f = md.contiguous_folds(train, 5).select("city", "date_ord", "fold").toPandas()
    f = f.sort_values(["city", "date_ord"]).reset_index(drop=True)
    assert (f["fold"].diff().fillna(0) >= 0).all()           # non-decreasing in (city, date) order
    sizes = f["fold"].value_counts().sort_index().to_numpy()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1


def test_bootstrap_is_seeded_and_brackets_rmse(spark, tables):
    _, _, test = tables
    p = (test.withColumn("prediction", F.col("temperature_2m_max_lag1"))
         .withColumn("row_id", F.concat_ws("|", "city", F.col("time").cast("string"))))
    a = md.poisson_bootstrap(p, replicates=100).first()
    b = md.poisson_bootstrap(p, replicates=100).first()
    point = md.regression_metrics(p).first()["rmse"]
    assert a == b and a["rmse_low"] < point < a["rmse_high"]


def test_class_weights_balance(spark, tables):
    _, train, _ = tables
    w = md.class_weights(train).groupBy("will_rain").agg(F.sum("weight").alias("s")).collect()
    n = train.count()
    assert all(r["s"] == pytest.approx(n / 2) for r in w)


def test_ridge_cv_against_numpy(spark):
    """Same penalty in every fold, nulls dropped before folds are cut."""
    import datetime as dt

    rng = np.random.default_rng(5)
    rows = []
    for c in ("a", "b"):
        for i in range(60):
            x = rng.normal(size=3)
            rows.append((c, i, *[float(v) for v in x], float(x @ [1.0, -2.0, 0.5] + rng.normal()), dt.date(2024, 1, 1)))
    rows.append(("a", 99, None, 1.0, 1.0, 1.0, dt.date(2024, 1, 1)))
    df = spark.createDataFrame(rows, "city string, date_ord int, x1 double, x2 double, x3 double, y double, time date")
    best, (b0, beta), scored, table = md.ridge_cv(df, df, alphas=(0.1, 50.0), features=["x1", "x2", "x3"], label="y", folds=4)
    data = np.array([r[2:6] for r in rows[:-1]], float)
    x = (data[:, :3] - data[:, :3].mean(0)) / data[:, :3].std(0)
    y, fold = data[:, 3], np.arange(120) * 4 // 120

    def fit(x, y, a):
        m = x.mean(0)
        c = np.linalg.solve((x - m).T @ (x - m) + a * np.eye(3), (x - m).T @ (y - y.mean()))
        return y.mean() - m @ c, c
    for a, score in table:
        want = []
        for f in range(4):
            i, c = fit(x[fold != f], y[fold != f], a)
            h = y[fold == f]
            want.append(1 - ((h - i - x[fold == f] @ c) ** 2).sum() / ((h - h.mean()) ** 2).sum())
        assert abs(score - np.mean(want)) < 1e-9
    i, c = fit(x, y, best[0])
    assert abs(b0 - i) < 1e-9 and np.allclose(beta, c)
    assert scored.count() == 120


def test_residual_trend_bins_are_filled(spark):
    import datetime as dt

    rows = [("c", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 3), float(i % 2)) for i in range(61)]
    df = spark.createDataFrame(rows, "city string, time date, prediction double, temperature_2m_max double")
    got = md.residual_trend(df, bins=10).collect()
    assert sorted(r["bin"] for r in got) == list(range(10)) and {r["n"] for r in got} == {6, 7}


def test_logistic_is_stationary_and_matches_plain_newton(spark, tables):
    _, train, test = tables
    fit, scored = md.fit_logistic(train, test, features=md.TREE_FEATURES)
    rows = train.na.drop(subset=[md.CLF_TARGET, *md.TREE_FEATURES]).select(md.CLF_TARGET, *md.TREE_FEATURES).toPandas()
    assert fit["gradient"] < 1e-6 * len(rows)
    y, x = rows[md.CLF_TARGET].to_numpy(float), rows[list(md.TREE_FEATURES)].to_numpy(float)
    sd = x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(sd == 0, 1.0, sd)])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.r_[fit["intercept"], fit["coefficients"]]
    ridge = np.r_[0.0, np.ones(z.shape[1] - 1)]
    p = 1 / (1 + np.exp(-z @ b))
    assert np.abs(z.T @ (w * (p - y)) + ridge * b).max() < 1e-6 * len(y)
    assert scored.filter("prediction <> CAST(probability_1 > 0.5 AS INT)").count() == 0


def test_logistic_constant_feature_and_one_class(spark):
    rows = [(float(i), 3.0, int(i % 7 > 2 and i > 5)) for i in range(60)]
    df = spark.createDataFrame(rows + [(None, 3.0, 1)], "a double, b double, will_rain int")
    fit, scored = md.fit_logistic(df, df, features=["a", "b"])
    assert fit["coefficients"][1] == 0.0 and scored.count() == 60
    with pytest.raises(ValueError):
        md.fit_logistic(df.filter("will_rain = 1"), df, features=["a", "b"])


@pytest.fixture(scope="module")
def dull(spark, tmp_path_factory):
    """Tables of which every (region, day) has rain, the same highest and the same lowest
    temperature, so the regression's label, the rain flag and half the features are constant."""
    import datetime as dt

    at = str(tmp_path_factory.mktemp("dull"))
    lines, key = [], 0
    for year in range(1995, 2001):
        for i in range(14):
            day = dt.datetime(year, 1, 2) + dt.timedelta(days=26 * i + year % 3)
            for s in range(5):
                for q in (1.0, 10.0 + (key * 7) % 13, 50.0):
                    key += 1
                    lines.append((key, key, s, 1 + key % 7, q, 900.0 + key % 31, (key % 11) / 100, (1 + key * 5 % 8) / 100, "R", "OF"[key % 2], day))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(s, s) for s in range(5)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(s, f"nation {s}", s) for s in range(5)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(s, f"region {s}") for s in range(5)], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    return at


def oracle(at, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    return con.sql(__spark_entry__.oracle_sql()[name]).df().to_dict("records")


def test_rain_logistic_of_one_class_is_its_sql(spark, dull):
    import __spark_entry__

    got = __spark_entry__.queries()["k10_rain_logistic"](spark, dull).toPandas().to_dict("records")
    assert len(got) == 1 and got[0]["tp"] == 70 and got == oracle(dull, "k10_rain_logistic")


@pytest.mark.parametrize("label", [0, 1])
def test_logistic_of_one_class_against_plain_steps(spark, label):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame([(*map(float, r), 3.0, label) for r in x], "a double, b double, c double, will_rain int")
    fit, scored = md.fit_logistic(df, df, features=["a", "b", "c"], one_class_steps=50)
    z = np.column_stack([np.ones(40), (x - x.mean(axis=0)) / x.std(axis=0), np.zeros(40)])
    bound, beta, ridge = np.linalg.inv(z.T @ z / 8 + np.diag([0.0, 1, 1, 1])), np.zeros(4), np.r_[0.0, 1, 1, 1]
    for _ in range(50):
        beta = beta + bound @ (0.5 * z.T @ (label - 1 / (1 + np.exp(-z @ beta))) - ridge * beta)
    assert np.allclose([fit["intercept"], *fit["coefficients"]], beta) and fit["gradient"] < 1e-9
    assert {r["prediction"] for r in scored.collect()} == {label}
    assert scored.first()["probability_1"] == pytest.approx(1 / (1 + np.exp(-beta[0])))
    with pytest.raises(ValueError):
        md.fit_logistic(df.limit(0), df, features=["a", "b", "c"], one_class_steps=50)


def test_rain_classifiers_of_one_class(spark, dull):
    import __spark_entry__

    got = {r["model"]: r for r in __spark_entry__.queries()["k10_rain_classifiers"](spark, dull).collect()}
    assert set(got) == {"logistic_balanced", "gbt_balanced"}
    assert {(r["accuracy"], r["f1"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in got.values()} == {(1.0, 1.0, 70, 0, 0, 0)}
    assert [m for m, r in got.items() if r["is_best"]] == ["logistic_balanced"]


def test_ols_coefficients_of_constant_label(spark, dull):
    import __spark_entry__

    got = __spark_entry__.queries()["k06_ols_coefficients"](spark, dull).collect()
    n = oracle(dull, "k06_ols_coefficients")[0]["n"]
    assert sorted(r["term"] for r in got) == sorted([*md.LINEAR_FEATURES, "intercept"])
    assert {r["term"]: r["coef"] for r in got} == {**{c: 0.0 for c in md.LINEAR_FEATURES}, "intercept": 50.0}
    assert {(r["std_err"], r["t"], r["p"], r["r2"], r["r2_adj"], r["n"]) for r in got} == {(0.0, None, None, None, None, n)}


def test_ols_of_dependent_features_matches_pinv(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 2))
    x = np.column_stack([x, np.full(80, 7.0), x[:, 0]])  # one constant, one repeated
    y = 3 + x[:, 0] - 2 * x[:, 1] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y double")
    model, _, _ = md.fit_linear(df, df, features=list("abcd"), label="y")
    got = {r["term"]: r for r in md.ols_summary(model, list("abcd"))}
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1.0, x.std(0))
    a = np.column_stack([z, np.ones(80)])
    inv = np.linalg.pinv(a.T @ a, rcond=1e-10)
    beta, rest = inv @ a.T @ y, y - a @ inv @ a.T @ y
    se = np.sqrt(np.diag(inv) * (rest @ rest) / (80 - 3))
    for i, c in enumerate([*"abcd", "intercept"]):
        assert abs(got[c]["coef"] - beta[i]) < 1e-9 and abs(got[c]["std_err"] - se[i]) < 1e-9
    assert got["c"]["t"] is None and got["a"]["t"] == pytest.approx(beta[0] / se[0])
    assert got["a"]["r2"] == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum())
    two, _, _ = md.fit_linear(df, df, features=list("ab"), label="y")  # the same fit of full rank, by Spark
    full = {r["term"]: r for r in md.ols_summary(two, list("ab"))}
    assert got["b"]["t"] == pytest.approx(full["b"]["t"]) and got["b"]["p"] == pytest.approx(full["b"]["p"], abs=1e-12)
    assert got["b"]["r2_adj"] == pytest.approx(full["b"]["r2_adj"])


def test_lasso_path_of_constant_label(spark, dull):
    import __spark_entry__

    got = __spark_entry__.queries()["k08_lasso_path"](spark, dull).collect()
    assert sorted((r["alpha"], r["rmse"], r["r2"], r["zeroed"], r["features"]) for r in got) == [
        (a, 0.0, None, 15, 15) for a in (0.001, 0.01, 0.1, 1.0, 10.0)]


def test_lasso_path_of_constant_test_label_and_no_test_rows(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 5) + i % 2) for i in range(40)], "a double, y double")
    flat = df.withColumn("y", F.lit(2.0))
    (one,) = md.lasso_path(df, flat, alphas=(0.1,), features=["a"], label="y")
    (none,) = md.lasso_path(df, df.limit(0), alphas=(0.1,), features=["a"], label="y")
    assert one["r2"] is None and one["rmse"] > 0.5
    assert none["r2"] is None and none["rmse"] is None and none["zeroed"] == one["zeroed"] == 0
