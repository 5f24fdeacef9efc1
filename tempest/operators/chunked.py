"""Series windows for very long series: the feature layer and the missing-value repair
computed over fixed-size chunks of each series instead of one window partition per city.

A city that holds a large share of all rows would otherwise put its whole series in one
task. Here

1. every row gets its position in the series (``_idx``) from windows over (city, year)
   plus per-city offsets computed from one row per (city, year);
2. the series is cut into chunks of ``chunk_rows`` positions; rows within ``lookback``
   positions of a chunk's start are copied into that chunk as *halo* rows, so row-based
   frames and lags see their full history; halo rows are dropped afterwards;
3. values that may come from arbitrarily far away (forward/back fill, the previous and next
   observed point of an interpolation) are carried across chunks through a summary with
   one row per (city, chunk).

Every window partition is then (city, chunk) or (city, year) with a bounded number of
rows, and the results equal the unchunked operators exactly (tests/test_chunked.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx
from tempest.operators.cleaning import default_strategy, numeric_columns
from tempest.operators.features import LAG_TARGETS, ROLL_TARGETS


def index_series(df: DataFrame, key="city", order="time") -> DataFrame:
    """``_idx``: 0-based position of each row in its series, without ordering a whole series
    in one task (windows per (key, year); offsets from the per-(key, year) counts)."""
    b = df.withColumn("_yr", F.year(order))
    counts = b.groupBy(key, "_yr").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select(key, "_yr", F.coalesce(F.sum("_c").over(
        Window.partitionBy(key).orderBy("_yr").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))  # one row per (key, year)
    local = F.row_number().over(Window.partitionBy(key, "_yr").orderBy(order)) - 1
    return b.join(offs, [key, "_yr"]).withColumn("_idx", (F.col("_off") + local).cast("long")) \
        .drop("_off", "_yr")


def with_halo(indexed: DataFrame, chunk_rows: int, lookback: int, lookahead: int = 0) -> DataFrame:
    """``_chunk`` = _idx div chunk_rows. The last ``lookback`` rows of each chunk are also
    emitted into the next chunk and the first ``lookahead`` rows into the previous one, with
    ``_halo`` = true."""
    if max(lookback, lookahead) >= chunk_rows:
        raise ValueError("chunk_rows must exceed the lookback and the lookahead")
    c = F.floor(F.col("_idx") / chunk_rows).cast("long")
    r = F.col("_idx") % chunk_rows
    copies = F.array_compact(F.array(
        F.struct(c.alias("k"), F.lit(False).alias("h")),
        F.when(r >= chunk_rows - lookback, F.struct((c + 1).alias("k"), F.lit(True).alias("h"))),
        F.when((r < lookahead) & (c > 0), F.struct((c - 1).alias("k"), F.lit(True).alias("h")))))
    return (indexed.withColumn("_cp", F.explode(copies))
            .withColumn("_chunk", F.col("_cp.k")).withColumn("_halo", F.col("_cp.h")).drop("_cp"))


def chunked_apply(df: DataFrame, build, lookback: int, lookahead: int = 0, chunk_rows: int = 100_000,
                  key="city", order="time") -> DataFrame:
    """Add the columns ``build(window, position)`` returns, computed over (city, chunk)
    partitions ordered by series position; frames may reach ``lookback`` rows back and
    ``lookahead`` rows ahead. ``position`` is the 0-based row position in the whole series."""
    h = with_halo(index_series(df, key, order), chunk_rows, lookback, lookahead)
    w = Window.partitionBy(key, "_chunk").orderBy("_idx")
    return (h.select(*df.columns, *build(w, F.col("_idx")), "_halo")
            .filter(~F.col("_halo")).drop("_halo"))


def persistence_alert_level(tmax: str = "temperature_2m_max", hot: float = 35.0, cold: float | None = None,
                            rows: int = 3):
    """Builder for ``chunked_apply``: hot days among the last ``rows`` rows (0 for the first
    rows - 1 positions of a series); signed with ``cold``."""
    def build(w, pos):
        flag = F.coalesce((F.col(tmax) > hot).cast("int"), F.lit(0))
        if cold is not None:
            flag = flag - F.coalesce((F.col(tmax) < cold).cast("int"), F.lit(0))
        lvl = F.when(pos >= rows - 1, F.sum(flag).over(w.rowsBetween(-(rows - 1), 0))).otherwise(F.lit(0))
        return [lvl.cast("int").alias("persistence_alert_level")]
    return build


def sensor_artefacts(col: str = "temperature_2m_mean", rows: int = 3, min_equal: int = 2):
    """Builder: stuck flag (>= min_equal zero diffs in a full window of ``rows``) and |jump|."""
    def build(w, pos):
        diff = F.col(col) - F.lag(col, 1).over(w)
        same = F.coalesce((F.coalesce(diff, F.lit(0.0)) == 0).cast("int"), F.lit(0))
        frame = w.rowsBetween(-(rows - 1), 0)
        stuck = F.coalesce((F.count(F.lit(1)).over(frame) == rows) & (F.sum(same).over(frame) >= min_equal),
                           F.lit(False))
        return [stuck.alias("stuck"), F.abs(diff).alias("jump")]
    return build


def centred_mean(col: str, half: int, name: str):
    def build(w, pos):
        return [F.avg(col).over(w.rowsBetween(-half, half)).alias(name)]
    return build


def _cw(key="city"):
    return Window.partitionBy(key, "_chunk").orderBy("_idx")


def compute_all_features_chunked(df: DataFrame, chunk_rows: int = 100_000, base_temp: float = 18.0,
                                 season_labels: dict | None = None, key="city") -> DataFrame:
    """Same columns and values as ``features.compute_all_features``."""
    lookback = max(max(ws) for ws in ROLL_TARGETS.values()) - 1
    lookback = max(lookback, max(max(ls) for ls in LAG_TARGETS.values()))
    h = with_halo(index_series(df, key), chunk_rows, lookback)
    w = _cw(key)
    cols = [F.col(c) for c in df.columns]
    for c, windows in ROLL_TARGETS.items():
        for n in windows:
            cols.append(F.avg(c).over(w.rowsBetween(-(n - 1), 0)).alias(f"{c}_{n}d"))
    month = F.month("time")
    cols += [month.alias("month"), F.quarter("time").alias("quarter"),
             F.dayofyear("time").alias("day_of_year"), cal.season(month, season_labels).alias("season"),
             wx.temperature_range().alias("temperature_range"),
             wx.heating_degree_days(base=base_temp).alias("HDD"),
             wx.cooling_degree_days(base=base_temp).alias("CDD")]
    for c, lags in LAG_TARGETS.items():
        for k in lags:
            cols.append(F.lag(c, k).over(w).alias(f"{c}_lag{k}"))
    out = h.select(*cols, "_halo").filter(~F.col("_halo")).drop("_halo")
    # (city, day-of-year) groups hold one row per year: bounded partitions
    anomaly = F.col("temperature_2m_mean") - F.avg("temperature_2m_mean").over(
        Window.partitionBy(key, "day_of_year"))
    return out.withColumn("anomaly_score", anomaly)


def _carried(summary: DataFrame, name: str, key="city", forward: bool = True) -> Column:
    """Last non-null ``name`` of the chunks before (forward) / first of the chunks after."""
    # both directions are growing frames (one pass); a frame ending at unboundedFollowing
    # would be re-aggregated for every chunk
    order = F.col("_chunk") if forward else F.col("_chunk").desc()
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(name, ignorenulls=True).over(w)


def handle_missing_chunked(df: DataFrame, strategy: dict | None = None, chunk_rows: int = 100_000,
                           key="city", order="time", drop_remaining: bool = True) -> DataFrame:
    """Same result as ``cleaning.handle_missing`` (ffill+bfill, zero, positional linear
    interpolation with nearest-value edges, drop)."""
    strategy = strategy if strategy is not None else default_strategy(numeric_columns(df))
    fill = [c for c, m in strategy.items() if m in ("ffill", "interpolate") and c in df.columns]
    ix = index_series(df, key, order).withColumn("_chunk", F.floor(F.col("_idx") / chunk_rows).cast("long"))
    # per (city, chunk): first and last observed point of every filled column
    aggs = []
    for c in fill:
        pt = F.when(F.col(c).isNotNull(), F.struct(F.col("_idx").alias("i"), F.col(c).alias("v")))
        aggs += [F.max_by(pt, F.when(F.col(c).isNotNull(), F.col("_idx"))).alias(f"_last_{c}"),
                 F.min_by(pt, F.when(F.col(c).isNotNull(), F.col("_idx"))).alias(f"_first_{c}")]
    out = ix
    if fill:
        summary = ix.groupBy(key, "_chunk").agg(*aggs)   # one row per (city, chunk)
        carries = summary.select(key, "_chunk", *[
            e for c in fill for e in (_carried(summary, f"_last_{c}", key, True).alias(f"_prev_{c}"),
                                      _carried(summary, f"_first_{c}", key, False).alias(f"_next_{c}"))])
        out = ix.join(carries, [key, "_chunk"])
    run = Window.partitionBy(key, "_chunk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    rev = Window.partitionBy(key, "_chunk").orderBy(F.col("_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    drop_subset, cols = [], []
    for c in df.columns:
        m = strategy.get(c)
        if m in ("ffill", "interpolate"):
            pt = F.when(F.col(c).isNotNull(), F.struct(F.col("_idx").alias("i"), F.col(c).alias("v")))
            prev = F.coalesce(F.last(pt, ignorenulls=True).over(run), F.col(f"_prev_{c}"))
            nxt = F.coalesce(F.last(pt, ignorenulls=True).over(rev), F.col(f"_next_{c}"))
            if m == "ffill":
                cols.append(F.coalesce(F.col(c), prev["v"], nxt["v"]).alias(c))
            else:
                between = prev["v"] + (nxt["v"] - prev["v"]) * (F.col("_idx") - prev["i"]) / (nxt["i"] - prev["i"])
                cols.append(F.when(F.col(c).isNotNull(), F.col(c))
                            .when(prev.isNotNull() & nxt.isNotNull(), between)
                            .otherwise(F.coalesce(prev["v"], nxt["v"])).alias(c))
        elif m == "zero":
            cols.append(F.coalesce(F.col(c), F.lit(0.0)).alias(c))
        else:
            if m == "drop":
                drop_subset.append(c)
            cols.append(F.col(c))
    res = out.select(*cols)
    if drop_subset:
        res = res.na.drop(subset=drop_subset)
    return res.na.drop() if drop_remaining else res
