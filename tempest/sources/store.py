"""Keyed store operations on (city, time): upsert, latest dates, audit log, layer counts
(A8-A10, A15, A16).

Upsert is an aggregation, not a row_number window: every copy of a key is tagged with
(source priority, ingest sequence) and ``max_by`` keeps the winner. Partial aggregation
reduces a key with many copies map-side, so a hot key never lands whole in one task.
Writes use dynamic partition overwrite on ``year``: only touched partitions are replaced,
and replaying the same batch yields the same table (idempotent).
"""

from __future__ import annotations

import datetime as _dt
import time as _time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest import schemas as S

KEYS = ("city", "time")


def upsert(target: DataFrame | None, batch: DataFrame, keys=KEYS, seq: str | None = None) -> DataFrame:
    """Insert-or-replace: the batch wins over the target; inside the batch the largest
    ``seq`` wins (ingest order), so a duplicated key in one batch resolves last-wins. Rows of
    equal ``seq`` (or of none) resolve by the largest row, so replays agree."""
    keys = list(keys)
    cols = [c for c in batch.columns if c not in keys and c != seq]
    b_seq = F.col(seq) if seq else F.lit(None).cast("long")
    kind = batch.schema[seq].dataType if seq else "long"
    parts = [batch.select(*keys, *cols, F.lit(1).alias("_src"), b_seq.alias("_seq"))]
    if target is not None:
        parts.insert(0, target.select(*keys, *cols, F.lit(0).alias("_src"),
                                      F.lit(None).cast(kind).alias("_seq")))
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    packed = F.struct(*[F.col(c) for c in cols])
    order = F.struct("_src", "_seq", packed)
    best = union.groupBy(*keys).agg(F.max_by(packed, order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def upsert_to_path(spark: SparkSession, path: str, batch: DataFrame, keys=KEYS,
                   seq: str | None = None) -> DataFrame:
    """Merge ``batch`` into the Parquet layer at ``path``; only the years present in the
    batch are read back and rewritten (dynamic partition overwrite)."""
    from tempest.session import materialize
    from tempest.sources.files import layout_for_write, path_exists

    batch = batch.withColumn("year", F.year("time"))
    if path_exists(spark, path):
        # the distinct years of a batch are a handful of values: an explicit isin gives
        # static partition pruning, only those directories are read and rewritten
        years = [r[0] for r in batch.select("year").distinct().collect()]
        current = spark.read.parquet(path).filter(F.col("year").isin(years))
        merged = upsert(current.drop("year"), batch.drop("year"), keys, seq)
    else:
        merged = upsert(None, batch.drop("year"), keys, seq)
    # a table of its own: the rewritten partitions are also the ones being read
    merged = materialize(merged.withColumn("year", F.year("time")))
    (layout_for_write(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").parquet(path))
    return spark.read.parquet(path)


def latest_dates(panel: DataFrame, key="city", order="time") -> DataFrame:
    return panel.groupBy(key).agg(F.max(order).alias("last_date"))


def layer_counts(layers: dict) -> DataFrame:
    """Row count of each named layer; an absent layer (None) counts 0. One job per layer,
    results unioned."""
    spark = SparkSession.getActiveSession()
    parts = []
    for name, df in layers.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"),
                                               F.lit(0).cast("long").alias("row_count")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LAYER_TABLES = ("raw_historical", "raw_forecast", "staging_historical", "staging_forecast",
                "analytics_historical", "analytics_forecast", "pipeline_runs")


def stored_layer_counts(spark: SparkSession, base: str, tables=LAYER_TABLES) -> DataFrame:
    """Row counts of every stored table under ``base``; an absent table counts 0."""
    from tempest.sources.files import path_exists

    return layer_counts({t: (spark.read.parquet(f"{base.rstrip('/')}/{t}")
                             if path_exists(spark, f"{base.rstrip('/')}/{t}") else None)
                         for t in tables})


def claim_run_id(spark: SparkSession, path: str) -> int:
    """The next run id, claimed by an empty file that only one run can create (beside the
    audit rows, under a name that readers of the table skip)."""
    from tempest.sources.files import _fs_path, path_exists

    run_id = 1
    if path_exists(spark, path) and not spark.read.schema(S.AUDIT_RUN).parquet(path).isEmpty():
        run_id = spark.read.parquet(path).agg(F.max("run_id")).first()[0] + 1
    while True:
        claim, fs = _fs_path(spark, f"{path.rstrip('/')}/_claims/{run_id}")
        if not fs.exists(claim) and fs.createNewFile(claim):
            return run_id
        run_id += 1


def append_audit(spark: SparkSession, path: str, mode: str, cities_count: int, rows_raw: int,
                 rows_staging: int, rows_analytics: int, started: float, status: str,
                 notes: str = "") -> DataFrame:
    """Append one run record; ``run_id`` = the previous largest + 1 (claimed, so two runs at
    once get different ones), duration rounded to 2 digits."""
    run_id = claim_run_id(spark, path)
    row = (run_id, _dt.datetime.now(), mode, int(cities_count), int(rows_raw), int(rows_staging),
           int(rows_analytics), round(_time.time() - started, 2), status, notes)
    rec = spark.createDataFrame([row], S.AUDIT_RUN)
    rec.write.mode("append").parquet(path)
    return rec
