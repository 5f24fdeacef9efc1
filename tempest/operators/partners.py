"""Each city's most correlated other cities, same day or lagged, without all pairs.

A standardised series is summed against random signs per day, once per projection; the signs
of the sums are bits whose agreement grows with the correlation: two series of correlation r
share a bit with probability 1 - arccos(r) / pi. Bits are cut into bands; cities that share
a band (or its complement, for negative correlations) become candidates, and only candidates
meet their series for the exact correlation. Bits per band grow with the logarithm of the
number of cities, so a band's buckets stay small; bands are as many as the recall at the
least correlation asked for takes. All is one aggregate, a join of codes and a join of the
candidates' rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.operators.stats import correlation
from tempest.session import materialize

#: expected cities in a bucket, and the most projections
BUCKET, PROJECTIONS = 8, 4096


def banding(cities: int, least: float, recall: float) -> tuple[int, int]:
    """(bits per band, bands): at correlation ``least`` a pair shares a band with probability ``recall``."""
    same = 1 - math.acos(min(least, 1 - 1e-9)) / math.pi
    bits = max(2, math.ceil(math.log2(max(2, cities / BUCKET))))
    bands = lambda b: math.ceil(math.log(1 - recall) / math.log1p(-same ** b))
    while bits > 2 and bits * bands(bits) > PROJECTIONS:
        bits -= 1
    return bits, bands(bits)


def _codes(series: DataFrame, key: str, order: str, bits: int, bands: int, seed: int) -> DataFrame:
    """(key, code): an array of one number per band, and its complement."""
    count = bits * bands
    words = [F.xxhash64(F.col(order), F.lit(seed), F.lit(w)).alias(f"_h{w}") for w in range((count + 63) // 64)]
    rows = series.select(key, "_z", order).select(key, "_z", *words)
    sign = lambda i: F.lit(1.0) - 2.0 * F.shiftright(F.col(f"_h{i // 64}"), i % 64).bitwiseAND(F.lit(1))
    sums = rows.groupBy(key).agg(*[F.sum(F.col("_z") * sign(i)).alias(f"_s{i}") for i in range(count)])
    band = lambda b, up: sum((F.when(F.col(f"_s{b * bits + i}") >= 0, F.lit(int(up) << i)).otherwise(F.lit(int(not up) << i)) for i in range(bits)), F.lit(0))
    return sums.select(key, F.array(*[band(b, True) for b in range(bands)]).alias("code"), F.array(*[band(b, False) for b in range(bands)]).alias("opposite"))


def city_partners(df: DataFrame, value: str, top: int = 4, least: float = 0.3, lag: int = 0, key="city", order="time",
                  recall: float = 0.99, seed: int = 7, min_days: int = 3) -> DataFrame:
    """(city, partner, r, n, rank): of each city the ``top`` others with the largest |r| of at
    least ``least``, over the days both have; with ``lag`` the city's value so many rows
    earlier against the partner's of the day. Pairs of correlation ``least`` are found with
    probability ``recall``, stronger ones more surely."""
    series = df.filter(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias("_v"))
    led = series
    if lag:
        led = series.select(key, order, F.lag("_v", lag).over(Window.partitionBy(key).orderBy(order)).alias("_v")).filter(F.col("_v").isNotNull())
    bits, bands = banding(series.select(F.count_distinct(key)).first()[0], least, recall)

    def coded(rows, name):
        stats = rows.groupBy(key).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_d"))
        z = rows.join(stats, key).select(key, order, F.try_divide(F.col("_v") - F.col("_m"), F.col("_d")).alias("_z")).filter("_z is not null")
        return _codes(z, key, order, bits, bands, seed).withColumnRenamed(key, name)

    left = coded(led, "city_a").select("city_a", F.explode(F.array("code", "opposite")).alias("code")).select("city_a", F.posexplode("code").alias("band", "bucket"))
    right = coded(series, "city_b").select("city_b", F.posexplode("code").alias("band", "bucket"))
    pairs = materialize(left.join(right, ["band", "bucket"]).filter("city_a <> city_b").select("city_a", "city_b").distinct())
    a = led.select(F.col(key).alias("city_a"), F.col(order).alias("_t"), F.col("_v").alias("_a"))
    b = series.select(F.col(key).alias("city_b"), F.col(order).alias("_t"), F.col("_v").alias("_b"))
    r = (pairs.join(a, "city_a").join(b, ["city_b", "_t"]).groupBy("city_a", "city_b")
         .agg(correlation("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_days) & (F.abs("r") >= least)))
    ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy("city_a").orderBy(F.abs(F.round("r", 9)).desc(), "city_b")))
    return ranked.filter(F.col("rank") <= top).select(F.col("city_a").alias(key), F.col("city_b").alias("partner"), "r", "n", "rank")
