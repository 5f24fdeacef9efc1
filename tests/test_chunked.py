import datetime as dt

import pytest
from pyspark.sql import functions as F

from tempest.operators import chunked as ch
from tempest.operators.cleaning import handle_missing
from tempest.operators.features import compute_all_features
from tempest.sources import fixtures as fx
from tests.conftest import SMOKE


def _same(a, b, cols):
    ra = a.select(*cols).exceptAll(b.select(*cols)).count()
    rb = b.select(*cols).exceptAll(a.select(*cols)).count()
    return ra == 0 and rb == 0


def test_index_series_is_row_position(spark):
    p = fx.panel(spark, SMOKE, "nation")
    ix = ch.index_series(p).select("city", "time", "_idx")
    from pyspark.sql import Window
    want = p.select("city", "time", (F.row_number().over(Window.partitionBy("city").orderBy("time")) - 1)
                    .cast("long").alias("_idx"))
    assert _same(ix, want, ["city", "time", "_idx"])


@pytest.mark.parametrize("chunk", [40, 97])
def test_chunked_repair_and_features_equal_unchunked(spark, chunk):
    raw = fx.panel_with_nulls(spark, SMOKE, "region")
    a = handle_missing(raw)
    b = ch.handle_missing_chunked(raw, chunk_rows=chunk)
    assert _same(a, b, a.columns)
    fa = compute_all_features(a)
    fb = ch.compute_all_features_chunked(a, chunk_rows=chunk)
    assert _same(fa, fb, fa.columns)


def test_chunked_fill_carries_across_many_empty_chunks(spark):
    d0 = dt.date(2020, 1, 1)
    vals = [None] * 7 + [4.0] + [None] * 9 + [8.0] + [None] * 5
    df = spark.createDataFrame([("a", d0 + dt.timedelta(days=i), v) for i, v in enumerate(vals)],
                               "city string, time date, x double")
    for method in ("ffill", "interpolate"):
        a = handle_missing(df, {"x": method}, drop_remaining=False).orderBy("time").collect()
        b = ch.handle_missing_chunked(df, {"x": method}, chunk_rows=3, drop_remaining=False).orderBy("time").collect()
        assert [r["x"] for r in a] == [r["x"] for r in b]


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_joined_outlier_flags_equal_window_flags(spark, method):
    from tempest.operators.cleaning import flag_outliers

    p = fx.panel(spark, SMOKE, "nation")
    cols = ["temperature_2m_max", "precipitation_sum", "wind_speed_10m_max"]
    a = flag_outliers(p, cols, method, 1.5)
    b = flag_outliers(p, cols, method, 1.5, by_join=True)
    assert _same(a, b, a.columns)
