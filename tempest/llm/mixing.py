"""Mixing sources to target weights with DataFrame functions only.

Targets come from capped water-filling: every source gets its weight's share of the budget,
sources above ``max_epochs`` times their size are clamped there, and the excess is shared
anew by weight until none is above. A source's target is then met by whole repetitions of
all its documents and a seeded fraction of one more: documents are ordered by a hash of
their id and text, and those up to the cut where the words taken come nearest to the target are
taken once more. The cut is found on words per (source, hash bucket), so no source is ever
sorted or counted in one task.

Defined results: null text has size 0; null is a source of its own, after all others; a
null id hashes as the empty text; rows that share id and text share their repetitions; sources
without words get target 0; an empty table gives an empty result. Columns other than id,
text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.common import SALTS, all_salts, renamed, text_or_empty, write_table
from tempest.operators.stats import ordered_offsets

#: hash buckets per source in which the cut is looked for (hex digits of the hash)
CUT_DIGITS = 4


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bucket(doc_id: Column, text: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, CUT_DIGITS), 16, 10).cast("int")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight). Each round is one aggregate: the
    level is what the unclamped sources share per unit of weight, and it only rises."""
    size = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, cap, level, clamped = share * size, F.col("source_size") * F.lit(float(max_epochs)), 0.0, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        n, held, weight = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)),
                                      F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not weight:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        clamped, level = n, (budget - (held or 0.0)) / weight


def plan_mix(docs: DataFrame, weights: tuple, share: float, max_epochs: float, seed: str) -> DataFrame:
    """One row per source: source_size, target, whole (repetitions of all its documents) and
    cut (the last bucket taken once more, -1 for none)."""
    masses = write_table(docs.select("source", word_count(text_or_empty()).alias("size"), bucket(F.col("doc_id"), text_or_empty(), seed).alias("bucket"))
                         .groupBy("source", "bucket").agg(F.sum("size").alias("mass")), "mix-masses")
    sizes = masses.groupBy("source").agg(F.sum("mass").alias("source_size"))
    # weights repeat over the sources in code point order, null last
    named = ordered_offsets(sizes.filter("source is not null").withColumn("one", F.lit(1)), "source", "one")
    named = named.select("source", "source_size", F.col("offset").cast("long").alias("rank"))
    last = named.count()
    nameless = sizes.filter("source is null").select("source", "source_size", F.lit(last).cast("long").alias("rank"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    sources = write_table(named.unionByName(nameless).withColumn("weight", pick), "mix-sources")
    targets = water_fill(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = (targets.withColumn("whole", whole.cast("long"))
               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    # the cut: of the running sums (and of taking nothing) the one nearest to the rest
    upto = F.sum("mass").over(Window.partitionBy("source").orderBy("bucket"))
    sums = masses.withColumn("upto", upto).alias("m").join(
        targets.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
    gap = F.struct(F.abs(F.col("m.upto") - F.col("t.rest")).alias("gap"), F.col("m.bucket").alias("bucket"))
    cut = (sums.groupBy("t.source", "t.source_size", "t.target", "t.whole", "t.rest").agg(F.min(gap).alias("best"))
           .select("source", "source_size", "target", "whole",
                   F.when(F.col("best.gap") < F.col("rest"), F.col("best.bucket")).otherwise(-1).alias("cut")))
    return write_table(cut, "mix-plan")


def with_plan(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Rows (doc_id, text, source and others) with ``source_size``, ``target`` and ``repeats``
    of the plan; a source may hold a third of all rows, so its plan meets every salt."""
    at = rows.withColumn("bucket", bucket(F.col("doc_id"), text_or_empty(), seed))
    at = at.withColumn("salt", F.pmod(F.col("bucket"), F.lit(SALTS)).cast("int")).alias("r")
    p = all_salts(plan, "salt").alias("p")
    repeats = (F.col("p.whole") + F.when(F.col("r.bucket") <= F.col("p.cut"), 1).otherwise(0)).cast("long")
    return (at.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.salt") == F.col("p.salt")))
            .select(*[F.col(f"r.{c}") for c in rows.columns], "p.source_size", "p.target", repeats.alias("repeats")))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
        seed: str = "mix-1") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken."""
    rows = docs.select("doc_id", "text", "source")
    planned = with_plan(rows, plan_mix(rows, weights, share, max_epochs, seed), seed)
    return planned.select("doc_id", "source", word_count(text_or_empty()).alias("size"), "source_size", "target", "repeats").withColumn(
        "taken", F.col("repeats") * F.col("size"))


def repeat_documents(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
                     seed: str = "mix-1") -> DataFrame:
    """The mix itself: each document as many times as it is taken, columns unchanged. A row's
    repetitions follow from the plan of its source, so texts stay where they were read
    wherever the plan is small enough for the planner to broadcast it."""
    own = renamed(docs, "doc_id", "text", "source")
    planned = with_plan(own, plan_mix(own, weights, share, max_epochs, seed), seed).filter("repeats > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return planned.withColumn("copy", copies).select(*own.columns).toDF(*docs.columns)
