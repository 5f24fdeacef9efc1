"""Ranks, Q-Q points, Spearman correlations and p-value adjustment per group without a whole
group in one task (J5, J10, J12, J15, L6).

Rows of a group are reduced to its distinct values and their counts; these are cut into
ranges of (group, value), and a range takes from those before it (or, for a suffix minimum,
after it) one number per group it shares with them. One group may hold nearly all rows: its
ranges lie in as many tasks as there are shuffle partitions. Results equal the window forms
in ``operators.stats`` and ``operators.marts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import distributions as dist
from tempest.operators import aggregates as ag
from tempest.operators.stats import correlation_pairs, ordered_offsets
from tempest.session import materialize

#: rows that one task makes of a value's ties
PIECE = 100_000


def group_positions(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, col, n, before, total): of each distinct value its count, the rows of its group
    with smaller values, and the rows of the group."""
    counts = (df.filter(F.col(col).isNotNull() & F.col(group).isNotNull()).groupBy(F.struct(group, col).alias("_gv"))
              .agg(F.count(F.lit(1)).alias("n")))
    placed = materialize(ordered_offsets(materialize(counts), "_gv", "n"))
    placed = placed.select(F.col("_gv").getField(group).alias(group), F.col("_gv").getField(col).alias(col), "n", "offset")
    first = placed.groupBy(group).agg(F.min("offset").alias("_first"), F.sum("n").alias("total"))
    return placed.join(first, group).select(group, col, "n", (F.col("offset") - F.col("_first")).alias("before"), "total")


def group_mid_ranks(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, col, mid_rank): the average rank among ties within the group."""
    return group_positions(df, group, col).select(group, col, (F.col("before") + (F.col("n") + 1) / 2.0).alias("mid_rank"))


def spearman_pairs_split(df: DataFrame, cols, key="city") -> DataFrame:
    """Spearman's rho of every column pair per group; ranks over the rows where a column is present."""
    rows = df.select(key, *cols)
    for c in cols:
        ranks = group_mid_ranks(df, key, c).withColumnRenamed("mid_rank", f"_rank_{c}")
        rows = rows.join(ranks, [key, c], "left")  # ties are one row of ranks; a frequent value is split by AQE
    return correlation_pairs(rows.select(key, *[F.col(f"_rank_{c}").alias(c) for c in cols]), cols, key)


def qq_points_split(df: DataFrame, value: str, key="city") -> DataFrame:
    """Sorted values against probit((i - 0.5) / n) per group; the ties of a frequent value are
    written out by several tasks."""
    at = group_positions(df, key, value)
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PIECE).cast("int") - 1))
    at = at.withColumn("_piece", pieces).repartition(key, value, "_piece")
    low = F.col("_piece").cast("long") * PIECE
    i = F.explode(F.sequence(low + 1, F.least(F.col("n"), low + PIECE)))
    pos = (F.col("before") + F.col("_i") - 0.5) / F.col("total")
    return at.withColumn("_i", i).select(key, F.col(value).alias("sample"), dist.probit(pos).alias("theoretical"))


def kruskal_per_group(df: DataFrame, key: str, group, value: str) -> DataFrame:
    """Per key: Kruskal-Wallis H over its groups (``group``: columns), no tie correction."""
    group = [group] if isinstance(group, str) else list(group)
    cells = materialize(df.filter(F.col(value).isNotNull()).groupBy(key, *group, value).agg(F.count(F.lit(1)).alias("c")))
    rows = cells.select(key, value, F.col("c").alias("_w"))
    counts = materialize(rows.groupBy(F.struct(key, value).alias("_gv")).agg(F.sum("_w").alias("n")))
    placed = materialize(ordered_offsets(counts, "_gv", "n")).select(
        F.col("_gv").getField(key).alias(key), F.col("_gv").getField(value).alias(value), "n", "offset")
    first = placed.groupBy(key).agg(F.min("offset").alias("_first"))
    ranks = placed.join(first, key).select(key, value, (F.col("offset") - F.col("_first") + (F.col("n") + 1) / 2.0).alias("_rank"))
    sums = cells.join(ranks, [key, value]).groupBy(key, *group).agg(F.sum(F.col("c") * F.col("_rank")).alias("R"), F.sum("c").alias("ng"))
    s = sums.groupBy(key).agg(F.sum("ng").alias("N"), F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("_s"), F.count(F.lit(1)).alias("k"))
    h = F.lit(12.0) / (F.col("N") * (F.col("N") + 1)) * F.col("_s") - 3 * (F.col("N") + 1)
    return s.filter(F.col("k") >= 2).select(key, "N", "k", h.alias("H"), (F.col("k") - 1).alias("dof"))


def seasonal_kruskal_split(history: DataFrame, value: str = "temperature_2m_max", last: int = 4) -> DataFrame:
    """``marts.seasonal_kruskal`` for cities of any number of rows."""
    known = history.filter(F.col(value).isNotNull())
    rows = known.select("city", value, cal.season_year("time").alias("season_year"), cal.season(F.month("time"), cal.LABELS_TITLE).alias("season"))
    kept = rows.join(ag.last_season_buckets(known, last), ["city", "season_year", "season"])
    return kruskal_per_group(kept, "city", ["season_year", "season"], value)


def suffix_min(table: DataFrame, group: str, key: str, value: str, partitions: int | None = None) -> DataFrame:
    """``suffix_min``: the least ``value`` of the group's rows from this one on in ``key`` order."""
    n = partitions or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(table.repartitionByRange(n, group, key).withColumn("_p", F.spark_partition_id()))
    down = Window.partitionBy("_p", group).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(group).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group: a group has at most as many as there are ranges
    carried = ranged.groupBy("_p", group).agg(F.min(value).alias("_m")).select("_p", group, F.min("_m").over(later).alias("_carry"))
    out = ranged.withColumn("_local", F.min(value).over(down)).join(carried, ["_p", group])
    return out.withColumn("suffix_min", F.least("_local", "_carry")).drop("_local", "_carry", "_p")


def p_adjust_split(tests: DataFrame, p: str = "p", family: str = "family") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg within families of any number of tests. Tests of equal
    p are adjusted alike, by the largest rank among them."""
    at = group_positions(tests, family, p).withColumn("_raw", F.col(p) * F.col("total") / (F.col("before") + F.col("n")))
    adjusted = suffix_min(at, family, p, "_raw").select(family, p, "total", "suffix_min")
    return (tests.join(adjusted, [family, p], "left")
            .withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("total")))
            .withColumn("p_bh", F.least(F.lit(1.0), F.col("suffix_min"))).drop("total", "suffix_min"))
