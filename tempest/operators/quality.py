"""Quality gates (Q1-Q9): every check yields a row ``check_name, stage, status, details``
computed from aggregates of its layer; status and details are Spark expressions, so
nothing but the final rows reaches the driver. The aggregate-based checks of one layer
share a single aggregation pass; ``run_all_checks`` unions the layers' rows in the fixed
order (``seq``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.schemas import REQUIRED_FEATURES, TEMPERATURE_COLUMNS

TEMP_MIN, TEMP_MAX = -50.0, 60.0
SEVERITY = {"PASS": 0, "WARN": 1, "FAIL": 2}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def _row(stats: DataFrame, name: str, stage: str, status: Column, details: Column) -> DataFrame:
    return stats.select(F.lit(name).alias("check_name"), F.lit(stage).alias("stage"),
                        status.alias("status"), details.alias("details"))


class Check:
    """One gate as (aggregates over the layer, row built from those aggregates). Several
    checks of a layer share one aggregation pass (``single_pass``)."""

    def __init__(self, name: str, aggs, status, details):
        self.name, self.aggs, self.status, self.details = name, aggs, status, details


def single_pass(df: DataFrame, stage: str, checks, seq0: int = 0, seqs=None) -> DataFrame:
    aggs = [a for c in checks for a in c.aggs]
    stats = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    seqs = list(seqs) if seqs is not None else [seq0 + i for i in range(len(checks))]
    rows = [F.struct(F.lit(c.name).alias("check_name"), F.lit(stage).alias("stage"),
                     c.status.alias("status"), c.details.alias("details"), F.lit(q).alias("seq"))
            for c, q in zip(checks, seqs)]
    return stats.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def row_count_check(df: DataFrame, p: str = "rc") -> Check:
    n = F.col(f"{p}_n")
    empty = n == 0
    return Check("row_count", [F.count(F.lit(1)).alias(f"{p}_n")],
                 F.when(empty, "FAIL").otherwise("PASS"),
                 F.format_string("rows=%d", n))


def numeric_columns(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def null_ratio_check(df: DataFrame, threshold: float = 0.05, p: str = "nr") -> Check:
    cols = numeric_columns(df)
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(f"{p}_{c}") for c in cols]
    bad = F.array_compact(F.array(*[
        F.when(F.col(f"{p}_{c}") > threshold,
               F.format_string("%s=%.1f%%", F.lit(c), F.col(f"{p}_{c}") * 100))
        for c in cols])) if cols else F.array().cast("array<string>")
    limit = F.lit(f"limit={threshold * 100:.0f}%")
    return Check("null_ratio", aggs, F.when(F.size(bad) > 0, "WARN").otherwise("PASS"),
                 F.concat_ws(" ", limit, F.concat_ws(" ", bad)) if cols else limit)


def value_range_check(df: DataFrame, lo: float = TEMP_MIN, hi: float = TEMP_MAX, p: str = "vr") -> Check:
    present = [c for c in TEMPERATURE_COLUMNS if c in df.columns]
    skip = "nothing to check"
    if not present:
        return Check("value_ranges", [], F.lit("WARN"), F.lit(skip))
    out_of = None
    for c in present:
        cond = F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
        out_of = cond if out_of is None else (out_of | cond)
    n, bad = F.col(f"{p}_n"), F.col(f"{p}_bad")
    rng = f"range={lo}..{hi}"
    return Check("value_ranges", [F.count(F.lit(1)).alias(f"{p}_n"), F.count_if(out_of).alias(f"{p}_bad")],
                 F.when(n == 0, "WARN").when(bad > 0, "WARN").otherwise("PASS"),
                 F.when(n == 0, F.lit(skip))
                 .otherwise(F.concat(F.lit(f"{rng} outside="), bad.cast("string"))))


def feature_completeness_check(df: DataFrame, required=REQUIRED_FEATURES, p: str = "fc") -> Check:
    missing = [c for c in required if c not in df.columns]  # schema only, no data read
    present = [c for c in required if c in df.columns]
    aggs = [F.count(c).alias(f"{p}_{c}") for c in present]
    all_null = F.array_compact(F.array(*[F.when(F.col(f"{p}_{c}") == 0, F.lit(c)) for c in present])) \
        if present else F.array().cast("array<string>")
    found = F.concat(F.lit(f"required={len(required)} absent={','.join(missing)} empty="), F.concat_ws(",", all_null))
    return Check("feature_completeness", aggs,
                 F.when(F.lit(bool(missing)) | (F.size(all_null) > 0), "WARN").otherwise("PASS"), found)


def freshness_check(df: DataFrame, max_lag_days: int = 2, as_of: _dt.date | None = None,
                    p: str = "fr") -> Check:
    as_of = as_of or _dt.date.today()
    skip = "nothing to check"
    if "time" not in df.columns:
        return Check("freshness", [], F.lit("WARN"), F.lit(skip))
    latest = F.col(f"{p}_latest")
    lag = F.datediff(F.lit(as_of), latest)
    latest_s = F.date_format(latest, "yyyy-MM-dd")
    return Check("freshness", [F.max(F.to_date("time")).alias(f"{p}_latest")],
                 F.when(latest.isNull(), "WARN").when(lag > max_lag_days, "WARN").otherwise("PASS"),
                 F.when(latest.isNull(), F.lit(skip))
                 .otherwise(F.format_string(f"latest=%s lag=%d limit={max_lag_days}", latest_s, lag)))


def _one(df: DataFrame, stage: str, check: Check) -> DataFrame:
    return single_pass(df, stage, [check]).drop("seq")


def check_row_count(df: DataFrame, stage: str = "raw_load") -> DataFrame:
    return _one(df, stage, row_count_check(df))


def check_null_ratio(df: DataFrame, stage: str = "staging", threshold: float = 0.05) -> DataFrame:
    return _one(df, stage, null_ratio_check(df, threshold))


def check_value_ranges(df: DataFrame, stage: str = "staging", lo: float = TEMP_MIN,
                       hi: float = TEMP_MAX) -> DataFrame:
    return _one(df, stage, value_range_check(df, lo, hi))


def check_feature_completeness(df: DataFrame, stage: str = "analytics",
                               required=REQUIRED_FEATURES) -> DataFrame:
    return _one(df, stage, feature_completeness_check(df, required))


def check_freshness(df: DataFrame, stage: str = "raw_load", max_lag_days: int = 2,
                    as_of: _dt.date | None = None) -> DataFrame:
    return _one(df, stage, freshness_check(df, max_lag_days, as_of))


def city_max_gaps(df: DataFrame, key="city", order="time") -> DataFrame:
    """Largest distance in days between consecutive distinct dates, per city with >= 2 dates."""
    days = df.select(key, F.to_date(order).alias("_d")).distinct()
    gap = F.datediff("_d", F.lag("_d").over(Window.partitionBy(key).orderBy("_d")))
    return days.select(key, gap.alias("_g")).groupBy(key).agg(F.max("_g").alias("max_gap")) \
        .filter(F.col("max_gap").isNotNull())


def check_date_continuity(df: DataFrame, stage: str = "staging", max_gap_days: int = 3) -> DataFrame:
    """Cities with a gap over the limit: their number and the worst of them (the first by
    name on ties); ``city_max_gaps`` lists them all."""
    spark = df.sparkSession
    if "time" not in df.columns or "city" not in df.columns:
        return _row(spark.range(1), "date_continuity", stage, F.lit("WARN"), F.lit("nothing to check"))
    over = F.col("max_gap") > max_gap_days
    n_rows = df.select(F.count(F.lit(1))).scalar()  # scalar subquery
    s = city_max_gaps(df).agg(
        F.count_if(over).alias("bad"), F.max("max_gap").alias("gap"),
        F.min_by("city", F.struct(-F.col("max_gap"), F.col("city"))).alias("worst")).withColumn("n_rows", n_rows)
    limit = F.lit(f"limit={max_gap_days} cities=")
    return _row(s, "date_continuity", stage,
                F.when((F.col("n_rows") == 0) | (F.col("bad") > 0), "WARN").otherwise("PASS"),
                F.when(F.col("n_rows") == 0, "nothing to check")
                .when(F.col("bad") > 0, F.concat(limit, F.col("bad").cast("string"), F.lit(" worst="), "worst",
                                                 F.lit(" gap="), F.col("gap").cast("string")))
                .otherwise(F.concat(limit, F.lit("0"))))


def run_all_checks(raw: DataFrame | None = None, staging: DataFrame | None = None,
                   analytics: DataFrame | None = None, as_of: _dt.date | None = None,
                   names=("raw_historical", "staging_historical", "analytics_historical")) -> DataFrame:
    """raw: row_count, freshness; staging: row_count, null_ratio, date_continuity,
    value_ranges; analytics: row_count, feature_completeness. An absent layer is skipped;
    an empty layer reports FAIL on row_count."""
    parts = []
    if raw is not None:
        parts.append(single_pass(raw, names[0], [row_count_check(raw), freshness_check(raw, as_of=as_of)], 0))
    if staging is not None:
        one = single_pass(staging, names[1], [row_count_check(staging), null_ratio_check(staging),
                                              value_range_check(staging)], seqs=(2, 3, 5))
        cont = check_date_continuity(staging, names[1]).withColumn("seq", F.lit(4))
        parts += [one, cont]
    if analytics is not None:
        parts.append(single_pass(analytics, names[2], [row_count_check(analytics),
                                                       feature_completeness_check(analytics)], 6))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def overall_status(results: DataFrame) -> DataFrame:
    """FAIL > WARN > PASS over all results."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return results.agg(F.max(rank).alias("_r")).select(
        F.when(F.col("_r") == 2, "FAIL").when(F.col("_r") == 1, "WARN").otherwise("PASS").alias("overall"))


def structural_validation(df: DataFrame, key="city", order="time") -> DataFrame:
    """Duplicated keys, cities with date gaps and rows without coordinates, as check rows."""
    dup = df.groupBy(key, order).count().filter("count > 1").agg(F.count(F.lit(1)).alias("v"))
    span = (df.groupBy(key).agg(F.count_distinct(order).alias("d"),
                                (F.datediff(F.max(order), F.min(order)) + 1).alias("e"))
            .agg(F.count_if(F.col("d") < F.col("e")).alias("v")))
    coords = df.agg(F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("v"))

    def row(s, name, what):
        return s.select(F.lit(name).alias("check_name"),
                        F.when(F.col("v") == 0, "PASS").otherwise("WARN").alias("status"),
                        F.concat(F.col("v").cast("string"), F.lit(f" {what}")).alias("details"))
    return (row(dup, "duplicate_keys", "duplicated (city, time) keys")
            .unionByName(row(span, "date_gaps", "cities with missing dates"))
            .unionByName(row(coords, "coordinates_present", "rows without latitude/longitude")))


def report_rule_counts(df: DataFrame, stuck: Column, jump: Column, hot: float = 40.0,
                       cold: float = -25.0) -> DataFrame:
    """Counts and shares of the report rules: extreme temperatures, stuck sensor, jumps."""
    rule = (F.col("temperature_2m_max") > hot) | (F.col("temperature_2m_min") < cold)
    s = df.select(F.coalesce(rule, F.lit(False)).alias("_x"), stuck.alias("_s"),
                  F.coalesce(jump > 15, F.lit(False)).alias("_j"))
    a = s.agg(F.count(F.lit(1)).alias("n"), F.count_if("_x").alias("extreme"),
              F.count_if("_s").alias("stuck"), F.count_if("_j").alias("jumps"))
    return a.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows"),
                                     (F.col(k) * 100.0 / F.col("n")).alias("pct"))
                            for k in ("extreme", "stuck", "jumps")])).alias("r")).select("r.*")
