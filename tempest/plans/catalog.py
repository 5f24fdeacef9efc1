"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where
the operator is SQL-expressible, the equivalent oracle SQL for DuckDB over the same tables.

Computed doubles are rounded to 6 decimals on both sides (float sums differ by order).
Averages of 2-decimal data often sit exactly on a 7th-decimal tie, which Spark (HALF_UP on
the decimal text) and DuckDB (binary round) break differently; both sides therefore add the
same 1e-11 before rounding (``TIE_NUDGE``), far below the 1e-6 grid and far above float noise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.functions.numeric import TIE_NUDGE, round_half_up


@dataclass
class Query:
    name: str
    build: Callable
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn
    return deco


def rnd(c, digits: int = 6):
    return round_half_up(c, digits)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rnd(f.name, digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _prepared(build: Callable) -> Callable:
    """Every query runs with the UTC session time zone (dates of naive timestamps) and a
    checkpoint folder (the configured shared one, or a scratch one when unset)."""
    def run(spark, sf_dir):
        from tempest.session import checkpoint_dir

        spark.conf.set("spark.sql.session.timeZone", "UTC")
        checkpoint_dir(spark)
        return build(spark, sf_dir)
    run.__name__ = getattr(build, "__name__", "query")
    run.__doc__ = build.__doc__
    return run


def all_queries() -> dict[str, Callable]:
    _load_groups()
    return {k: _prepared(v.build) for k, v in REGISTRY.items()}


def nudge_rounding(sql: str) -> str:
    """Rewrite every ``ROUND(<expr>, d)`` into ``ROUND(1e-11 + (<expr>), d)`` (see TIE_NUDGE)."""
    out, i = [], 0
    while True:
        j = sql.find("ROUND(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + 5
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 6:k]
        head, sep, digits = inner.rpartition(",")
        if sep and digits.strip().isdigit() and head.count("(") == head.count(")"):
            out.append(sql[i:j] + f"ROUND({TIE_NUDGE} + ({nudge_rounding(head)}), {digits.strip()})")
        else:
            out.append(sql[i:j] + "ROUND(" + nudge_rounding(inner) + ")")
        i = k + 1


def all_sql() -> dict[str, str]:
    _load_groups()
    return {k: nudge_rounding(v.sql) for k, v in REGISTRY.items() if v.sql}


_LOADED = False


def _load_groups():
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    from tempest.plans import (  # noqa: F401
        q_loading, q_derive, q_series, q_aggregates, q_quality, q_stats, q_models, q_marts,
        q_streaming,
    )
