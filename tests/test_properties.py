from pyspark.sql import functions as F

from tempest.operators import models as md
from tempest.operators.cleaning import handle_missing
from tempest.operators.features import compute_all_features
from tempest.sources import fixtures as fx
from tests.conftest import SMOKE


def _same(a, b, cols):
    return (a.select(*cols).exceptAll(b.select(*cols)).count() == 0
            and b.select(*cols).exceptAll(a.select(*cols)).count() == 0)


def test_features_invariant_under_repartition_and_shuffle(spark):
    raw = fx.panel_with_nulls(spark, SMOKE, "region")
    a = compute_all_features(handle_missing(raw))
    shuffled = raw.repartition(7, F.rand(seed=3)).sortWithinPartitions(F.rand(seed=5))
    b = compute_all_features(handle_missing(shuffled))
    assert _same(a, b, a.columns)


def test_climatology_has_no_test_leak(spark):
    panel = fx.panel(spark, SMOKE, "region")
    altered = panel.withColumn("temperature_2m_max", F.when(F.year("time") == 2000, F.col("temperature_2m_max") + 100)
                               .otherwise(F.col("temperature_2m_max")))
    clim = ["clim_temp_max", "clim_temp_min", "clim_humidity", "clim_pressure", "city_temp_mean"]
    a, _, _ = md.model_table(panel, (1995, 1999), 2000)
    b, _, _ = md.model_table(altered, (1995, 1999), 2000)
    assert _same(a.select("city", "time", *clim), b.select("city", "time", *clim), ["city", "time", *clim])
