"""Incremental derivation with maintained history (M2).

Two results of a row depend on the whole history of its city: the day-of-year anomaly and
the outlier flags. They are not stored with the rows. The layers keep what follows from the
rows around (repaired measures, rolling means, lags, calendar), and beside them two small
tables are maintained: count and sum of the temperature per (city, day of year), and how
often each value of the flagged measures occurs per city. ``with_history`` joins them back,
so a new day never rewrites the years before it.

A batch changes rows from its first day on, and further back only where a run of nulls ends
at that day: the last complete row before it (no null in a measure that is filled from its
neighbours) is the city's *anchor*, and everything up to it keeps its values. Rows after the
anchor are repaired again from the anchor on, featured again with the ``CONTEXT`` staged rows
before them, and their years are the only ones written. The maintained tables lose what the
replaced rows had added and gain what the new ones add; a full run builds them anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.operators.cleaning import default_strategy, numeric_columns
from tempest.schemas import OUTLIER_COLUMNS
from tempest.sources.store import upsert

#: rows before a row that its rolling means (30 rows with itself) and lags read
CONTEXT = 29
TEMPERATURE = "temperature_2m_mean"


def row_features(features: DataFrame) -> DataFrame:
    """What the stored rows keep: all but the columns of the whole history."""
    return features.drop("anomaly_score", *[c for c in features.columns if c.endswith("_outlier_flag")])


def doy_sums(staged: DataFrame) -> DataFrame:
    return (staged.filter(F.col(TEMPERATURE).isNotNull()).groupBy("city", F.dayofyear("time").alias("day_of_year"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(TEMPERATURE).alias("total")))


def value_counts(staged: DataFrame, columns=OUTLIER_COLUMNS) -> DataFrame:
    cols = [c for c in columns if c in staged.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in cols]))
    return (staged.select("city", pairs.alias("_p")).select("city", "_p.variable", "_p.value").filter("value is not null")
            .groupBy("city", "variable", "value").agg(F.count(F.lit(1)).alias("n")))


def moved(state: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """A maintained table less what replaced rows had added, plus what new rows add."""
    sums = [c for c in ("n", "total") if c in state.columns]
    keys = [c for c in state.columns if c not in sums]
    parts = state.unionByName(come).unionByName(gone.select(*keys, *[(-F.col(c)).alias(c) for c in sums]))
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).filter("n > 0")


def outlier_bounds(values: DataFrame, threshold: float = 1.5) -> DataFrame:
    """One row per city: a map from measure to (low, high), from exact quartiles of the counts."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("n"))
    per = values.groupBy("city", "variable").agg(q.alias("q"))
    low, high = (F.col("q")[0] - threshold * (F.col("q")[1] - F.col("q")[0]), F.col("q")[1] + threshold * (F.col("q")[1] - F.col("q")[0]))
    pair = F.struct("variable", F.struct(low.alias("low"), high.alias("high")))
    return per.groupBy("city").agg(F.map_from_entries(F.collect_list(pair)).alias("_bounds"))


def with_history(rows: DataFrame, values: DataFrame, doy: DataFrame | None = None, columns=OUTLIER_COLUMNS) -> DataFrame:
    """The rows with their outlier flags and, given the day-of-year sums, their anomaly."""
    out = rows.join(outlier_bounds(values), "city", "left")
    flags = []
    for c in (c for c in columns if c in rows.columns):
        bound = F.col("_bounds")[c]
        flags.append(F.coalesce((F.col(c) < bound["low"]) | (F.col(c) > bound["high"]), F.lit(False)).alias(f"{c}_outlier_flag"))
    if doy is None:
        return out.select(*rows.columns, *flags)
    mean = doy.select("city", "day_of_year", (F.col("total") / F.col("n")).alias("_mean"))
    out = out.join(mean, ["city", "day_of_year"], "left")
    return out.select(*rows.columns, *flags, (F.col(TEMPERATURE) - F.col("_mean")).alias("anomaly_score"))


@dataclass
class Stored:
    """The stored tables; layers carry ``year``, their partition column."""

    raw: DataFrame
    staging: DataFrame
    analytics: DataFrame
    doy: DataFrame
    values: DataFrame


def _recent(stored: DataFrame, since) -> DataFrame:
    """The years from the one before ``since`` on: directories that are read at all."""
    return stored.filter(F.col("year") >= since.year - 1)


def anchors(stored: Stored, batch: DataFrame) -> DataFrame:
    """(city, _first, _anchor) of the batch's cities: its first day and the last complete
    stored row before that (null: the whole series is derived again). Older years than the
    one before the batch are read only if a city has no complete row in the recent ones."""
    from tempest.session import materialize

    first = materialize(batch.groupBy("city").agg(F.min("time").alias("_first")))
    filled = [c for c, how in default_strategy(numeric_columns(stored.raw.drop("year"))).items() if how != "zero"]
    complete = " and ".join(f"`{c}` is not null" for c in filled)

    def last(rows):
        return first.join(rows.select("city", "time", *filled).filter(complete).select("city", "time").join(first, "city")
                          .filter("time < _first").groupBy("city").agg(F.max("time").alias("_anchor")), "city", "left")

    found = materialize(last(_recent(stored.raw, first.agg(F.min("_first")).first()[0])))
    older = found.filter("_anchor is null").join(stored.raw.select("city").distinct(), "city", "left_semi")
    return found if older.isEmpty() else materialize(last(stored.raw))


def context_rows(staging: DataFrame, tail: DataFrame) -> DataFrame:
    """The last ``CONTEXT`` staged rows of each city up to its anchor."""
    known = tail.filter("_anchor is not null").select("city", "_anchor")
    before = staging.join(known, "city").filter("time <= _anchor").drop("_anchor")
    at = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("time")))
    return before.withColumn("_at", at).filter(F.col("_at") <= CONTEXT).drop("_at")


def derive_tail(stored: Stored, batch: DataFrame, repair: Callable, features: Callable):
    """(tail, staged rows after the anchors, their row features): ``tail`` names the cities
    and anchors; ``repair`` and ``features`` are those that built the layers."""
    from tempest.session import materialize

    tail = anchors(stored, batch)
    since = tail.agg(F.min("_anchor"), F.max(F.col("_anchor").isNull().cast("int"))).first()
    whole = since[0] is None or since[1] == 1
    raw = stored.raw if whole else stored.raw.filter(F.col("year") >= since[0].year)
    changed = raw.drop("year").join(tail.select("city", "_anchor"), "city").filter("_anchor is null or time >= _anchor").drop("_anchor")
    after = F.expr("_anchor is null or time > _anchor")
    staged = materialize(repair(upsert(changed, batch)).join(tail.select("city", "_anchor"), "city").filter(after).drop("_anchor"))
    staging = stored.staging if since[0] is None else _recent(stored.staging, since[0])
    context = context_rows(staging.drop("year"), tail)
    if since[0] is not None:  # sparse series may need rows of older years
        few = context.groupBy("city").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") < CONTEXT)
        few = tail.filter("_anchor is not null").join(context.select("city").distinct(), "city", "left_anti").select("city").unionByName(few.select("city"))
        if not stored.staging.filter(F.col("year") < since[0].year - 1).join(few, "city", "left_semi").isEmpty():
            context = context_rows(stored.staging.drop("year"), tail)
    featured = row_features(features(context.select(*staged.columns).unionByName(staged)))
    featured = featured.join(tail.select("city", "_anchor"), "city").filter(after).drop("_anchor")
    return tail, staged, featured


def replaced(layer: DataFrame, tail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows after the anchors) of a stored layer."""
    j = layer.join(tail.select("city", "_anchor", F.lit(True).alias("_in")), "city", "left")
    goes = F.expr("_in is not null and (_anchor is null or time > _anchor)")
    return j.filter(~goes).drop("_anchor", "_in"), j.filter(goes).drop("_anchor", "_in")


@dataclass
class Delta:
    """New content: of the layers the touched years only, of the maintained tables all."""

    raw: DataFrame
    staging: DataFrame
    analytics: DataFrame
    doy: DataFrame
    values: DataFrame
    raw_years: list
    years: list


def delta(stored: Stored, batch: DataFrame, repair: Callable, features: Callable) -> Delta:
    """What a batch changes in the stored tables."""
    raw_years = sorted(r[0] for r in batch.select(F.year("time")).distinct().collect())  # a batch's years
    raw = upsert(stored.raw.filter(F.col("year").isin(raw_years)).drop("year"), batch)
    tail, staged, featured = derive_tail(stored, batch, repair, features)
    since = tail.agg(F.min("_anchor"), F.max(F.col("_anchor").isNull().cast("int"))).first()
    touched = stored.staging if since[0] is None or since[1] == 1 else stored.staging.filter(F.col("year") >= since[0].year)
    _, gone = replaced(touched, tail)
    years = sorted({r[0] for df in (staged.select(F.year("time").alias("year")), gone.select("year")) for r in df.distinct().collect()})
    stays = lambda layer: replaced(layer.filter(F.col("year").isin(years)), tail)[0].drop("year")
    return Delta(raw, stays(stored.staging).unionByName(staged), stays(stored.analytics).unionByName(featured),
                 moved(stored.doy, doy_sums(gone), doy_sums(staged)), moved(stored.values, value_counts(gone), value_counts(staged)),
                 raw_years, years)
