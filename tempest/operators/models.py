"""Next-day models: leak-free features, baselines, metrics, Spark ML estimators.

Features are computed for all cities in one job (windows on ``city``), the temporal split
is a filter on ``year`` (partition-prunable on the layer), climatology comes from training
rows only. Metrics are single aggregations. Estimators are Spark ML (distributed
treeAggregate / normal-equation solvers); the k x k matrices of OLS intervals are the only
things inverted on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx
from tempest.operators.features import lag, lagged_rolling_mean, series_window

REG_TARGET = "temperature_2m_max"
CLF_TARGET = "will_rain"
LAG_COLS = ("temperature_2m_max", "temperature_2m_min", "relative_humidity_2m_mean")
EXTRA_LAG_COLS = ("pressure_msl_mean", "shortwave_radiation_sum", "cloud_cover_mean", "precipitation_sum")

# climatology column -> source variable, and how a missing (city, doy) is filled
CLIM_SOURCES = {
    "clim_temp_max": "temperature_2m_max", "clim_temp_min": "temperature_2m_min",
    "clim_humidity": "relative_humidity_2m_mean", "clim_pressure": "pressure_msl_mean",
    "clim_shortwave": "shortwave_radiation_sum", "clim_cloud": "cloud_cover_mean",
}
CITY_FILLED = ("clim_temp_max", "clim_temp_min", "clim_humidity")
CITY_STATS = {"city_temp_mean": "temperature_2m_mean", "city_humidity_mean": "relative_humidity_2m_mean"}

LINEAR_FEATURES = [
    "lat", "lon", "month", "day_of_year", "doy_sin", "doy_cos", "is_weekend",
    "clim_temp_max", "clim_temp_min", "clim_humidity",
    "temperature_2m_max_lag1", "temperature_2m_max_lag3", "temperature_2m_max_roll7",
    "temperature_2m_min_lag1", "relative_humidity_2m_mean_lag1",
]
TREE_FEATURES = LINEAR_FEATURES + [
    "clim_pressure", "clim_shortwave", "clim_cloud", "city_temp_mean", "city_humidity_mean",
    "temperature_2m_max_lag7", "temperature_2m_min_lag3", "temperature_2m_min_roll7",
    "relative_humidity_2m_mean_roll7", "precipitation_sum_lag1", "pressure_msl_mean_lag1",
    "shortwave_radiation_sum_lag1", "cloud_cover_mean_lag1",
]


def base_columns(panel: DataFrame) -> DataFrame:
    """Calendar and derived columns of the model table."""
    t = F.col("time")
    doy = F.dayofyear(t)
    return panel.select(
        "*", F.year(t).alias("year"), F.month(t).alias("month"), doy.alias("day_of_year"),
        cal.is_weekend().alias("is_weekend"), *cal.doy_harmonics(doy),
        cal.date_ord().alias("date_ord"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        wx.weather_category().alias("weather_category"),
        wx.flag_positive("precipitation_sum").alias(CLF_TARGET))


def add_climatology(df: DataFrame, train: DataFrame) -> DataFrame:
    """Train-only climatology per (city, doy), city means, and the fill chain: the first
    three fall back to the city's training mean of the variable, the rest to the overall
    training mean; city stats fall back to the overall training mean."""
    by_doy = train.groupBy("city", "day_of_year").agg(
        *[F.avg(src).alias(c) for c, src in CLIM_SOURCES.items()])
    city_means = train.groupBy("city").agg(
        *[F.avg(src).alias(c) for c, src in CITY_STATS.items()],
        *[F.avg(CLIM_SOURCES[c]).alias(f"_fill_{c}") for c in CITY_FILLED])
    overall = {c: train.select(F.avg(src)).scalar() for c, src in {**CLIM_SOURCES, **CITY_STATS}.items()
               if c not in CITY_FILLED}
    j = df.join(by_doy, ["city", "day_of_year"], "left").join(city_means, "city", "left")
    out = [F.col(c) for c in df.columns]
    for c in CLIM_SOURCES:
        if c in CITY_FILLED:
            out.append(F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(c), overall[c]).alias(c))
    for c in CITY_STATS:
        out.append(F.coalesce(F.col(c), overall[c]).alias(c))
    return j.select(*out)


def add_lag_features(df: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in df.columns]
    for c in LAG_COLS:
        cols += [lag(c, k).alias(f"{c}_lag{k}") for k in (1, 3, 7)]
        cols.append(lagged_rolling_mean(c, 7).alias(f"{c}_roll7"))
    for c in EXTRA_LAG_COLS:
        if c in df.columns:
            cols += [lag(c, 1).alias(f"{c}_lag1"), lagged_rolling_mean(c, 7).alias(f"{c}_roll7")]
    cols.append(lag(CLF_TARGET, 1).alias(f"{CLF_TARGET}_lag1"))
    return df.select(*cols)


def add_climatology_window(df: DataFrame, is_train: Column) -> DataFrame:
    """Same result as ``add_climatology`` when the training rows are a subset of ``df``:
    conditional averages over (city, doy) and city windows, which cluster on ``city`` like
    the lag windows, so no join and no extra shuffle of the panel. The overall fallbacks
    are scalar subqueries."""
    w_doy = Window.partitionBy("city", "day_of_year")
    w_city = Window.partitionBy("city")

    def t(col):
        return F.when(is_train, F.col(col))
    scalar_src = {c: src for c, src in {**CLIM_SOURCES, **CITY_STATS}.items() if c not in CITY_FILLED}
    # every overall training mean in one scalar subquery (one pass over the training rows)
    overall = df.filter(is_train).select(F.struct(*[F.avg(src).alias(c) for c, src in scalar_src.items()])).scalar()
    out = [F.col(c) for c in df.columns]
    for c, src in CLIM_SOURCES.items():
        by_doy = F.avg(t(src)).over(w_doy)
        if c in CITY_FILLED:
            out.append(F.coalesce(by_doy, F.avg(t(src)).over(w_city)).alias(c))
        else:
            out.append(F.coalesce(by_doy, overall[c]).alias(c))
    for c, src in CITY_STATS.items():
        out.append(F.coalesce(F.avg(t(src)).over(w_city), overall[c]).alias(c))
    return df.select(*out)


def model_table(panel: DataFrame, train_years=(1995, 1999), test_year: int = 2000):
    """(full, train, test): lags built on all rows before the split, climatology from the
    training years only."""
    base = base_columns(panel)
    full = add_lag_features(add_climatology_window(base, F.col("year").between(*train_years)))
    train = full.filter(F.col("year").between(*train_years))
    test = full.filter(F.col("year") == test_year)
    return full, train, test


# ---------------------------------------------------------------------------------
# metrics
# ---------------------------------------------------------------------------------

def regression_metrics(pred: DataFrame, y: str = REG_TARGET, yhat: str = "prediction",
                       model: str = "model") -> DataFrame:
    """RMSE, MAE, R^2 in one aggregation (rows with both values)."""
    v = pred.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = F.col(y) - F.col(yhat)
    a = v.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("mae"),
              F.var_pop(y).alias("_vy"))
    return a.select(F.lit(model).alias("model"), "n", F.sqrt(F.try_divide(F.col("_sse"), F.col("n"))).alias("rmse"),
                    "mae", (1 - F.try_divide(F.col("_sse"), F.col("n") * F.col("_vy"))).alias("r2"))


def classification_metrics(pred: DataFrame, y: str = CLF_TARGET, yhat: str = "prediction",
                           model: str = "model") -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0) and the 2x2 confusion counts."""
    yy, pp = F.col(y).cast("int"), F.col(yhat).cast("int")
    v = pred.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    a = v.agg(F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
              F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 0) & (pp == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return a.select(F.lit(model).alias("model"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "tp", "fp", "fn", "tn")


def residual_interval(pred: DataFrame, train_resid: DataFrame, z: float = 1.96,
                      yhat: str = "prediction", resid: str = "residual") -> DataFrame:
    """yhat +- z * sd(train residual) (population sd); constant width 2 z sd."""
    se = train_resid.select(F.stddev_pop(resid)).scalar()
    return pred.select("*", (F.col(yhat) - z * se).alias("ci_low"), (F.col(yhat) + z * se).alias("ci_high"),
                       (2 * z * se).alias("ci_width"))


def probability_interval(pred: DataFrame, n: int, p: str = "probability_1", z: float = 1.96) -> DataFrame:
    """p +- z sqrt(p (1 - p) / n), clipped to [0, 1] (Wald form)."""
    half = z * F.sqrt(F.col(p) * (1 - F.col(p)) / n)
    lo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p) - half))
    hi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p) + half))
    return pred.select("*", lo.alias("ci_low"), hi.alias("ci_high"))


def residual_diagnostics(pred: DataFrame, y: str = REG_TARGET, yhat: str = "prediction",
                         key="city", order="time") -> DataFrame:
    """Per city: residual mean, sd, skewness, excess kurtosis, Jarque-Bera and Durbin-Watson
    (differences taken within the city's own series)."""
    e = (F.col(y) - F.col(yhat)).alias("e")
    r = pred.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(key, order, e)
    d = r.withColumn("_de", F.col("e") - F.lag("e").over(series_window(key, order)))
    a = d.groupBy(key).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"),
                           F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurtosis"),
                           F.sum(F.col("_de") * F.col("_de")).alias("_sdd"), F.sum(F.col("e") * F.col("e")).alias("_see"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4)
    return a.select(key, "n", "mean", "sd", "skew", "kurtosis", jb.alias("jarque_bera"),
                    F.try_divide(F.col("_sdd"), F.col("_see")).alias("durbin_watson"))


def residual_trend(pred: DataFrame, bins: int = 30, y: str = REG_TARGET, yhat: str = "prediction",
                   key="city", order="time") -> DataFrame:
    """Mean residual in ``bins`` equal-count bins of the fitted value: bin = floor(position *
    bins / n) in (fitted, key, order) order, so ties are split and every bin is filled.
    Positions are running counts over range partitions."""
    from tempest.operators.stats import ordered_offsets

    v = pred.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    rows = v.select(F.struct(F.col(yhat).alias("f"), F.col(key).alias("k"), F.col(order).alias("o")).alias("_at"),
                    (F.col(y) - F.col(yhat)).alias("_e"), F.lit(1).alias("_one"))
    placed = ordered_offsets(rows, "_at", "_one")
    n = placed.select(F.count(F.lit(1))).scalar()
    return (placed.withColumn("bin", F.floor(F.col("offset") * bins / n).cast("int")).groupBy("bin")
            .agg(F.avg("_at.f").alias("fitted"), F.avg("_e").alias("mean_residual"), F.count(F.lit(1)).alias("n")))


def class_weights(df: DataFrame, y: str = CLF_TARGET, weight: str = "weight") -> DataFrame:
    """Balanced weights n / (2 n_class), attached through a 2-row table (broadcast)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.select(F.count(F.lit(1))).scalar()
    w = counts.select(y, (total / (2 * F.col("_nc"))).alias(weight))
    return df.join(F.broadcast(w), y, "left")


def poisson_bootstrap(pred: DataFrame, replicates: int = 200, seed: int = 7,
                      y: str = REG_TARGET, yhat: str = "prediction", row_id: str = "row_id") -> DataFrame:
    """Bootstrap RMSE interval with Poisson(1) row weights. A row's weight in each replicate
    is the inverse Poisson cdf of a seeded hash of its id; the (id, error) table is aggregated
    with two conditional sums per replicate, so no row is copied."""
    cdf, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        acc += term
        cdf.append(acc)
        term /= (k + 1)
    from tempest.session import materialize

    v = materialize(pred.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(
        F.col(row_id).cast("string").alias("_id"), ((F.col(y) - F.col(yhat)) ** 2).alias("_se")))

    def uniform(r: int) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:{r // 4}:"), F.col("_id")).cast("binary"))
        return F.conv(F.substring(digest, 1 + 8 * (r % 4), 8), 16, 10).cast("long") / F.lit(float(1 << 32))

    # weights first, then the sums; 20 replicates at a time keep the generated code small
    def below(u: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c <= F.col(u)))

    parts = []
    for at in range(0, replicates, 20):
        some = range(at, min(at + 20, replicates))
        drawn = v.select("_se", *[uniform(r).alias(f"u{r}") for r in some])
        weighed = drawn.select("_se", *[below(f"u{r}").alias(f"w{r}") for r in some])
        sums = weighed.agg(*[F.sum(F.col(f"w{r}") * F.col("_se")).alias(f"s{r}") for r in some],
                           *[F.sum(f"w{r}").alias(f"n{r}") for r in some])
        parts.append(sums.select(F.explode(F.array(*[F.try_divide(F.col(f"s{r}"), F.col(f"n{r}")) for r in some])).alias("_mse")))
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    rm = F.sqrt(F.col("_mse"))
    return per.agg(F.percentile(rm, 0.025).alias("rmse_low"), F.percentile(rm, 0.975).alias("rmse_high"),
                   F.count(F.lit(1)).alias("replicates"))


def polynomial_terms(df: DataFrame, cols, degree: int = 2) -> DataFrame:
    """Explicit squares and pairwise interactions of ``cols`` (degree 2)."""
    out = [F.col(c) for c in df.columns]
    for i, a in enumerate(cols):
        out.append((F.col(a) * F.col(a)).alias(f"{a}^2"))
        for b in cols[i + 1:]:
            out.append((F.col(a) * F.col(b)).alias(f"{a}*{b}"))
    return df.select(*out)


# ---------------------------------------------------------------------------------
# Spark ML estimators
# ---------------------------------------------------------------------------------

def _assembled(df: DataFrame, features, label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    from tempest.session import materialize

    clean = df.na.drop(subset=[label, *features])
    return materialize(VectorAssembler(inputCols=list(features), outputCol="raw_features").transform(clean))


def scale_on_train(train: DataFrame, test: DataFrame, features, label: str):
    """Standardise with the training mean and *population* std (the sample std Spark uses
    is rescaled by sqrt((n-1)/n) so coefficients match a population-std scaler)."""
    from pyspark.ml.feature import StandardScaler

    tr, te = _assembled(train, features, label), _assembled(test, features, label)
    model = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True,
                           withStd=True).fit(tr)
    n = tr.count()
    fix = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    from pyspark.ml.functions import vector_to_array, array_to_vector

    def rescale(d):
        arr = vector_to_array(F.col("features"))
        return d.withColumn("features", array_to_vector(F.transform(arr, lambda x: x * fix)))
    return rescale(model.transform(tr)), rescale(model.transform(te))


def fit_linear(train: DataFrame, test: DataFrame, features=LINEAR_FEATURES, label: str = REG_TARGET,
               reg: float = 0.0, l1: float = 0.0):
    """OLS (reg=0, normal equations) / ridge (l1=0) / lasso (l1=1). For the penalised fits
    regParam = alpha * sd(y) / n: Spark scales the label internally."""
    from pyspark.ml.regression import LinearRegression

    tr, te = scale_on_train(train, test, features, label)
    solver = "normal" if reg == 0 or l1 == 0 else "auto"
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=l1,
                          standardization=False, solver=solver)
    model = lr.fit(tr)
    return model, model.transform(tr), model.transform(te)


def lasso_from_sums(g, alpha: float, start=None, tolerance: float = 1e-13, sweeps: int = 100_000):
    """(intercept, coefficients) minimising squared error / 2n + alpha * sum |coefficient| by
    coordinate descent with covariance updates: the data enter by their sums of products only."""
    import numpy as np

    n, k = g[0, 0], len(g) - 2
    mean = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(mean, mean)
    gram, pull = c[:k, :k], c[:k, k]
    beta = np.zeros(k) if start is None else start.copy()
    for _ in range(sweeps):
        step = 0.0
        for j in range(k):
            if gram[j, j] <= 0:
                continue
            rho = pull[j] - gram[j] @ beta + gram[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            step, beta[j] = max(step, abs(new - beta[j])), new
        if step < tolerance:
            break
    return mean[k] - mean[:k] @ beta, beta


def lasso_path(train: DataFrame, test: DataFrame, alphas=(0.001, 0.01, 0.1, 1.0, 10.0),
               features=LINEAR_FEATURES, label: str = REG_TARGET, zero: float = 1e-6):
    """Lasso fits over alpha on standardised features: test RMSE and R^2 and the number of
    coefficients with |coef| < 1e-6. The training rows are read once for the whole path (sums
    of products, largest alpha first, each fit starting from the one before), the test rows
    once for its errors. R^2 is null where the test label is constant, both without test rows."""
    features, beta, fits = list(features), None, {}
    known = train.na.drop(subset=[label, *features]).withColumn("fold", F.lit(0))
    s = fold_sums(known, features, label, 1)
    for a in sorted(alphas, reverse=True):
        intercept, beta = lasso_from_sums(s["sums"][0], a, beta)
        fits[a] = intercept, beta
    z = [(F.col(c) - s["mean"][c]) / s["sd"][c] for c in features]
    held = test.na.drop(subset=[label, *features])
    error = lambda a: F.col(label) - sum((F.lit(float(b)) * x for b, x in zip(fits[a][1], z)), F.lit(float(fits[a][0])))
    sums = held.agg(F.count(F.lit(1)).alias("n"), F.var_pop(label).alias("var"), (F.min(label) < F.max(label)).alias("varies"),
                    *[F.sum(error(a) ** 2).alias(f"e{i}") for i, a in enumerate(alphas)]).first()
    mse = [sums[f"e{i}"] / sums["n"] if sums["n"] else None for i in range(len(alphas))]
    return [{"alpha": float(a), "rmse": None if m is None else math.sqrt(m), "r2": 1 - m / sums["var"] if sums["varies"] else None, "zeroed": int((abs(fits[a][1]) < zero).sum()),
             "features": len(features)} for a, m in zip(alphas, mse)]


def ols_summary(model, features) -> list[dict]:
    """Coefficients with standard errors, t and p values (normal-equation solver). Spark has
    errors of full-rank fits with residual degrees of freedom only; others (constant label,
    features that are constant or depend on each other) come from ``ols_of_least_norm``."""
    from pyspark.errors import UnsupportedOperationException

    s = model.summary
    names = list(features) + ["intercept"]
    coefs = list(model.coefficients) + [model.intercept]
    try:
        errors = s.coefficientStandardErrors if s.degreesOfFreedom > 0 else None
    except UnsupportedOperationException:
        errors = None
    if errors is None:
        return ols_of_least_norm(s.predictions, names, s.featuresCol, s.labelCol)
    return [{"term": n, "coef": float(c), "std_err": float(se), "t": float(t), "p": float(p),
             "r2": float(s.r2), "r2_adj": float(s.r2adj), "n": int(s.numInstances)}
            for n, c, se, t, p in zip(names, coefs, errors, s.tValues, s.pValues)]


def products(df: DataFrame, cols: list[Column]):
    """The matrix of the sums of all products of two of ``cols``, in one aggregate."""
    import numpy as np

    k = len(cols)
    sums = df.select(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = sums[f"g{i}_{j}"]
    return g


def ols_of_least_norm(scaled: DataFrame, names, features_col: str, label: str, rank_tolerance: float = 1e-10) -> list[dict]:
    """The least-squares fit of least norm and its errors by the pseudo-inverse of the products
    of the standardised features: a constant feature gets 0, features that say the same share
    what they explain. Degrees of freedom are rows less rank (eigenvalues above
    ``rank_tolerance`` of the largest). What has no value is null: t and p where the error is
    0, errors without degrees of freedom, R^2 of a constant label."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from tempest.functions.distributions import t_two_sided_p

    y = F.col(label).cast("double")
    of = scaled.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high")).first()
    centre = of["low"] if of["low"] == of["high"] else of["mean"]
    k = len(names) - 1
    x = vector_to_array(F.col(features_col))
    g = products(scaled, [F.lit(1.0), *[x[i] for i in range(k)], y - F.lit(centre)])
    values, vectors = np.linalg.eigh(g[:-1, :-1])
    kept = values > rank_tolerance * values.max()
    inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
    beta = inverse @ g[:-1, -1]
    w = np.r_[beta, -1.0]
    sse, sst, n, df = max(0.0, float(w @ g @ w)), float(g[-1, -1]), of["n"], of["n"] - int(kept.sum())
    r2 = 1 - sse / sst if sst > 0 else None
    r2_adj = 1 - sse / sst * (n - 1) / df if sst > 0 and df > 0 else None
    out = []
    for i in [*range(1, k + 1), 0]:
        coef = float(beta[i]) + (centre if i == 0 else 0.0)
        error = math.sqrt(max(0.0, sse / df * float(inverse[i, i]))) if df > 0 else None
        t = coef / error if error else None
        out.append({"term": names[i - 1], "coef": coef, "std_err": error, "t": t,
                    "p": None if t is None else t_two_sided_p(t, df), "r2": r2, "r2_adj": r2_adj, "n": n})
    return out


def ols_mean_interval(train_scaled: DataFrame, pred: DataFrame, model, z_or_t: float = 1.96) -> DataFrame:
    """Confidence interval of the fitted mean: yhat +- t sqrt(x' (X'X)^-1 x sigma^2), with the
    (k+1)x(k+1) Gramian summed on the executors and inverted on the driver."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    k = len(model.coefficients)
    arr = vector_to_array(F.col("features"))
    inv = np.linalg.pinv(products(train_scaled, [F.lit(1.0)] + [arr[i] for i in range(k)]))
    sigma2 = model.summary.meanSquaredError * model.summary.numInstances / max(
        1, model.summary.numInstances - k - 1)
    px = pred.withColumn("_x", vector_to_array(F.col("features")))
    xv = [F.lit(1.0)] + [F.col("_x")[i] for i in range(k)]
    quad = None
    for i in range(k + 1):
        for j in range(k + 1):
            term = F.lit(float(inv[i, j])) * xv[i] * xv[j]
            quad = term if quad is None else quad + term
    half = z_or_t * F.sqrt(quad * sigma2)
    return px.select("*", (F.col("prediction") - half).alias("mean_ci_low"),
                     (F.col("prediction") + half).alias("mean_ci_high")).drop("_x")


def contiguous_folds(train: DataFrame, folds: int = 5, key="city", order="date_ord") -> DataFrame:
    """Fold = position in (city, date) order split into ``folds`` contiguous blocks, as an
    unshuffled k-fold would. Positions come from per-city counts (one row per city, prefix
    sums over range partitions) and a per-city row number, so no global sort is needed."""
    from tempest.operators.stats import ordered_offsets

    counts = train.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    offs = ordered_offsets(counts, key, "_c").withColumnRenamed("offset", "_off")
    total = counts.select(F.sum("_c")).scalar()
    pos = F.col("_off") + F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return (train.join(offs.select(key, "_off"), key)
            .withColumn("fold", F.floor(pos * folds / total).cast("int")).drop("_off"))


def fold_sums(train: DataFrame, features, label: str, folds: int) -> dict:
    """Per fold the sums of all products of (1, standardised features, label): one aggregate,
    from which every ridge fit and its held-out error follow."""
    import numpy as np

    cols = ["_one", *features, label]
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    mean = {c: stats[f"m_{c}"] or 0.0 for c in features}
    sd = {c: stats[f"s_{c}"] or 1.0 for c in features}
    z = train.select("fold", F.lit(1.0).alias("_one"), F.col(label).cast("double").alias(label),
                     *[((F.col(c) - mean[c]) / sd[c]).alias(c) for c in features])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = z.groupBy("fold").agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:  # one row per fold
        g = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        out[r["fold"]] = g
    return {"sums": [out.get(f, np.zeros((len(cols), len(cols)))) for f in range(folds)], "mean": mean, "sd": sd}


def ridge_from_sums(g, alpha: float):
    """(intercept, coefficients) of the ridge fit with penalty ``alpha`` on the coefficients
    and a free intercept, from sums of products."""
    import numpy as np

    n, k = g[0, 0], len(g) - 2
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    beta = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k])
    return mean[k] - mean[:k] @ beta, beta


def r2_from_sums(g, intercept: float, beta) -> float:
    import numpy as np

    w = np.r_[intercept, beta, -1.0]
    return 1.0 - (w @ g @ w) / (g[-1, -1] - g[0, -1] ** 2 / g[0, 0])


def ridge_cv(train: DataFrame, test: DataFrame, alphas=(0.01, 0.1, 1.0, 10.0, 100.0),
             features=LINEAR_FEATURES, label: str = REG_TARGET, folds: int = 5):
    """Ridge with contiguous k-fold CV over alpha (mean held-out R^2), then refitted on all
    training rows. Rows with nulls go first, then folds are cut; every fit has the same
    penalty ``alpha`` whatever its number of rows. The data are read once (fold sums).
    Returns (best alpha, its score), (intercept, coefficients), scored test rows, table."""
    import numpy as np

    features = list(features)
    known = train.na.drop(subset=[label, *features])
    s = fold_sums(contiguous_folds(known, folds), features, label, folds)
    total = sum(s["sums"])
    table = []
    for a in alphas:
        scores = [r2_from_sums(held, *ridge_from_sums(total - held, a)) for held in s["sums"]]
        table.append((a, float(np.mean(scores))))
    best = max(table, key=lambda t: t[1])
    intercept, beta = ridge_from_sums(total, best[0])
    yhat = F.lit(float(intercept))
    for c, b in zip(features, beta):
        yhat = yhat + F.lit(float(b)) * (F.col(c) - s["mean"][c]) / s["sd"][c]
    scored = test.na.drop(subset=[label, *features]).withColumn("prediction", yhat)
    return best, (float(intercept), beta.tolist()), scored, table


def fit_gbt_regressor(train: DataFrame, test: DataFrame, features=TREE_FEATURES, label: str = REG_TARGET,
                      max_iter: int = 50, seed: int = 42):
    """Boosted trees with the most recent 10 % of training dates held out for early stopping."""
    from pyspark.ml.regression import GBTRegressor

    tr = _assembled(train, features, label)
    cut = tr.select(F.percentile_approx("date_ord", 0.9, 10000)).scalar()
    tr = tr.withColumn("is_val", F.col("date_ord") > cut)
    te = _assembled(test, features, label)
    gbt = GBTRegressor(featuresCol="raw_features", labelCol=label, maxIter=max_iter, maxDepth=5,
                       stepSize=0.1, validationIndicatorCol="is_val", seed=seed)
    model = gbt.fit(tr)
    return model, model.transform(tr), model.transform(te)


def newton_sums(rows: DataFrame, beta, penalty: float):
    """(loss, gradient, curvature) of the penalised weighted logistic loss at ``beta`` from one
    pass over rows (x, y, w). Each task sums its batches into one matrix; its entries meet by
    position, so what reaches the driver is k * k numbers whatever the number of tasks. The
    first entry of x is the constant 1 and is not penalised."""
    import numpy as np
    import pyarrow as pa

    k = len(beta)

    def run(batches):
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy().reshape(-1, k)
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            m = x @ beta
            p = 1.0 / (1.0 + np.exp(-m))
            total[0] += (w * (np.logaddexp(0.0, m) - y * m)).sum()
            total[1:k + 1] += x.T @ (w * (p - y))
            total[k + 1:] += ((x * (w * p * (1.0 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    sums = np.zeros(1 + k + k * k)
    for r in rows.select("x", "y", "w").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    ridge = np.r_[0.0, np.full(k - 1, penalty)]
    return (sums[0] + 0.5 * (ridge * beta * beta).sum(), sums[1:k + 1] + ridge * beta,
            sums[k + 1:].reshape(k, k) + np.diag(ridge))


def one_class_intercept(label: int, steps: int) -> float:
    """Intercept after ``steps`` Newton steps from zero with the curvature held at its bound (a
    quarter of the weights) on rows that all have ``label``. The features are centred, so the
    coefficients stay zero and the rows' number and weight cancel out of every step."""
    b = 0.0
    for _ in range(steps):
        b += 4.0 * (label - 1.0 / (1.0 + math.exp(-b)))
    return b


def fit_logistic(train: DataFrame, test: DataFrame, features=LINEAR_FEATURES, label: str = CLF_TARGET,
                 penalty: float = 1.0, tolerance: float = 1e-9, rounds: int = 100, one_class_steps: int | None = None):
    """Balanced logistic regression by iteratively reweighted least squares: minimises
    penalty / 2 * |coefficients|^2 + the sum of class-weighted losses on standardised features
    (training mean, population deviation, 1 for a constant feature; free intercept). Each
    Newton step is one pass over the written training rows; a step that doesn't lower the
    loss is halved. Ends when no entry of the gradient exceeds ``tolerance`` times the rows.
    Rows with nulls are left out of both sides. Returns ({"intercept", "coefficients",
    "gradient", "rounds"}, scored test rows with probability_1 and prediction).

    Training rows of one class have no finite fit: the loss falls without end as the intercept
    grows. They are an error, unless ``one_class_steps`` says after how many steps of
    ``one_class_intercept`` to stop; "gradient" is then that of the coefficients alone."""
    import numpy as np

    from tempest.session import materialize

    features = list(features)
    known = train.na.drop(subset=[label, *features])
    one = F.col(label).cast("double")
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one), F.lit(0.0)).alias("ones"),
                      *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    n, ones = stats["n"], stats["ones"]
    one_class = not 0 < ones < n
    if one_class and (one_class_steps is None or not n):
        raise ValueError(f"{label} needs rows of both classes, has {ones:.0f} of {n}")
    scaled = [(F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in features]
    rows = materialize(known.select(
        F.array(F.lit(1.0), *scaled).alias("x"), one.alias("y"),
        F.when(one > 0, F.lit(n / (2.0 * (ones or n)))).otherwise(F.lit(n / (2.0 * ((n - ones) or n)))).alias("w")))
    beta, done = np.zeros(len(features) + 1), 0
    if one_class:
        beta[0], done = one_class_intercept(int(ones > 0), one_class_steps), one_class_steps
    loss, gradient, curvature = newton_sums(rows, beta, penalty)
    if one_class:
        gradient[0] = 0.0
    while not one_class and np.abs(gradient).max() > tolerance * n:
        if done == rounds:
            raise ArithmeticError(f"logistic regression did not converge in {rounds} rounds")
        step, done = np.linalg.solve(curvature, gradient), done + 1
        for _ in range(30):
            new = newton_sums(rows, beta - step, penalty)
            if new[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        beta, (loss, gradient, curvature) = beta - step, new
    margin = F.lit(float(beta[0]))
    for b, z in zip(beta[1:], scaled):
        margin = margin + F.lit(float(b)) * z
    scored = test.na.drop(subset=[label, *features]).withColumn("probability_1", 1 / (1 + F.exp(-margin)))
    scored = scored.withColumn("prediction", (F.col("probability_1") > 0.5).cast("int"))
    return {"intercept": float(beta[0]), "coefficients": beta[1:].tolist(), "gradient": float(np.abs(gradient).max()),
            "rounds": done}, scored


def fit_gbt_classifier(train: DataFrame, test: DataFrame, features=TREE_FEATURES, label: str = CLF_TARGET,
                       seed: int = 42) -> DataFrame:
    """Balanced boosted trees for the rain flag; the scored test rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    tr, te = _assembled(class_weights(train, label), features, label), _assembled(test, features, label)
    model = GBTClassifier(featuresCol="raw_features", labelCol=label, weightCol="weight", maxIter=40,
                          maxDepth=5, seed=seed).fit(tr)
    return model.transform(te).withColumn("probability_1", vector_to_array("probability")[1])


def fit_classifiers(train: DataFrame, test: DataFrame, label: str = CLF_TARGET, seed: int = 42,
                    one_class_steps: int | None = None):
    """Balanced logistic regression and balanced boosted trees for the rain flag;
    ``one_class_steps``: see ``fit_logistic``."""
    return {"logistic_balanced": fit_logistic(train, test, label=label, one_class_steps=one_class_steps)[1],
            "gbt_balanced": fit_gbt_classifier(train, test, label=label, seed=seed)}
