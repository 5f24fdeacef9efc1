import pytest

import __spark_entry__ as entry
from tests.conftest import SMOKE
from tools.plan_audit import audit

QUERIES = ["e01_feature_layer", "e01_feature_layer_chunked", "j05_kruskal_wallis", "j17_mann_whitney",
           "j01_median_split", "k01_model_features", "j06_tukey_hsd", "q07_run_all_checks", "c05_nearest_city",
           "j15_p_adjust"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_cartesian_or_single_partition_window(spark, name):
    df = entry.queries()[name](spark, SMOKE)
    a = audit(df._jdf.queryExecution().executedPlan().toString())
    assert a["cartesian"] == 0 and a["single_partition_window"] == 0, a


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SMOKE}/lineitem.parquet").filter(F.col("l_quantity") > 10).select("l_suppkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan
