import numpy as np
from pyspark.sql import functions as F

from tempest.operators import sketches as sk


def test_rank_error_of_merged_summaries_is_within_the_bound(spark):
    n, accuracy = 60_000, 100
    df = spark.range(n, numPartitions=8).select(
        F.lit("x").alias("city"), (F.col("id") % 12).cast("int").alias("year"), F.xxhash64("id").cast("double").alias("v"))
    stored = sk.value_sketches(df, ["v"], accuracy=accuracy)
    assert stored.select(F.max(F.octet_length("sketch"))).first()[0] < 8 * 5000 / 4  # far below the values of a year
    got = sk.quantiles(stored, np.linspace(0.05, 0.95, 19).tolist()).first()
    values = np.sort([r[0] for r in df.select("v").collect()])
    ranks = np.searchsorted(values, got["quantiles"], side="right") / n
    assert got["n"] == n and (got["low"], got["high"]) == (values[0], values[-1])
    assert np.abs(ranks - np.linspace(0.05, 0.95, 19)).max() < 2 * sk.rank_error(accuracy)


def test_small_groups_are_exact_and_missing_values_leave(spark):
    rows = [("a", 2020, float(i), None) for i in range(50)] + [("a", 2021, float("nan"), None), ("a", 2021, None, 1.0), ("b", 2020, None, None)]
    df = spark.createDataFrame(rows, "city string, year int, v double, w double")
    stored = sk.value_sketches(df, ["v", "w"])
    got = {(r["city"], r["variable"]): r for r in sk.quantiles(stored).collect()}
    assert set(got) == {("a", "v"), ("a", "w")}
    assert got["a", "v"]["quantiles"] == [12.0, 24.0, 37.0] and got["a", "v"]["n"] == 50
    assert sk.quantiles(stored.filter("year = 2021")).count() == 1
    assert sk.quantiles(stored.limit(0)).count() == 0
