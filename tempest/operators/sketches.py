"""Mergeable quantile summaries per city and year (quartiles and thresholds of any year range).

A summary holds a bounded number of a group's values whatever its size, and summaries of
years merge into those of a range, so quantiles of stored history need no second scan of the
rows. Spark's KLL sketches of doubles do the work, with map-side combination. A group of at
most ``accuracy`` values is summarised exactly (its quantiles are ``quantile_disc``: the value
of rank ceil(q n)); beyond that the rank of an answer is off by at most ``rank_error(accuracy)``
of the group's size with 99 % confidence. Nulls and NaN are not values; a group without
values has no summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: values a summary keeps apart; the sketch's size and error follow from it
ACCURACY = 200
SCHEMA = "city string, variable string, n long, low double, high double, sketch binary, year int"


def rank_error(accuracy: int = ACCURACY) -> float:
    """Error of one rank as a share of the group's size (fixed values: the published fit for
    KLL sketches at 99 % confidence)."""
    return 2.296 / accuracy ** 0.9021


def value_sketches(df: DataFrame, values, keys=("city", "year"), accuracy: int = ACCURACY) -> DataFrame:
    """(*keys, variable, n, low, high, sketch), one scan for all ``values``."""
    keys = list(keys)
    entries = []
    for v in values:
        x = F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))
        entries.append(F.struct(F.lit(v).alias("variable"), F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
                                F.kll_sketch_agg_double(x, accuracy).alias("sketch")))
    per = df.groupBy(*keys).agg(F.array(*entries).alias("_all"))
    return per.select(*keys, F.inline("_all")).filter("n > 0")


def merged(sketches: DataFrame, keys=("city",)) -> DataFrame:
    """The summaries of coarser groups, from those of finer ones."""
    keys = list(keys)
    return sketches.groupBy(*keys, "variable").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                                   F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, qs=(0.25, 0.5, 0.75), keys=("city",)) -> DataFrame:
    """(*keys, variable, n, low, high, quantiles) of the merged summaries, one entry per q."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(q)) for q in qs]))
    return merged(sketches, keys).select(*keys, "variable", "n", "low", "high", at.alias("quantiles"))


def read_sketches(spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Stored summaries of a range of years: only those directories are read."""
    out = spark.read.schema(SCHEMA).parquet(path)
    if first_year is not None:
        out = out.filter(F.col("year") >= first_year)
    return out if last_year is None else out.filter(F.col("year") <= last_year)
