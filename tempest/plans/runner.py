"""Layer runs: raw -> staging -> analytics with quality gates and an audit record.

Modes: ``full`` replaces every layer; ``incremental`` merges rows newer than each city's
last date (unseen cities start at ``default_start``) and re-derives rows from the first
affected one (``streaming.maintained``), writing only the years they lie in; ``forecast``
replaces the forecast layers. Layers are Parquet datasets under ``base`` partitioned by
year, with the maintained tables ``history_doy`` and ``history_values`` beside them
(``read_layer`` joins what a row takes from its city's history) and quantile summaries per
city and year (``read_quantiles``); nothing is collected except
counts, touched years and the handful of quality rows.
"""

from __future__ import annotations

import datetime as _dt
import time as _time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest.operators import sketches as sk
from tempest.operators.cleaning import date_gaps, fallback_clean, numeric_columns
from tempest.operators.features import fallback_features
from tempest.operators.loading import DEFAULT_START, filter_cities, force_start, select_increment
from tempest.operators.quality import overall_status, run_all_checks
from tempest import schemas as S
from tempest.session import materialize
from tempest.sources import files, store
from tempest.streaming import maintained as mt

LAYERS, TABLES = ("raw", "staging", "analytics"), ("history_doy", "history_values")
#: quantile summaries per city and year of the staged rows
SKETCHES = "value_sketches"


def layer_paths(base: str, kind: str = "historical") -> dict:
    return {name: f"{base.rstrip('/')}/{name}_{kind}" for name in (*LAYERS, *TABLES, SKETCHES)}


def derivations(chunk_rows: int | None = None):
    """(raw -> repaired rows, repaired rows -> features). ``chunk_rows`` selects the chunked
    series operators, for series so long that one city's rows should not sit in one task."""
    from tempest.operators.cleaning import handle_missing
    from tempest.operators.features import compute_all_features

    if not chunk_rows:
        return handle_missing, compute_all_features
    from tempest.operators import chunked as ch

    return (lambda raw: ch.handle_missing_chunked(raw, chunk_rows=chunk_rows),
            lambda df: ch.compute_all_features_chunked(df, chunk_rows=chunk_rows))


class Aborted(RuntimeError):
    """A gate stopped the run; the stored layers are as they were."""


def _chosen(source: DataFrame, cities, mode, latest, force, start, end, default_start) -> DataFrame:
    """The source rows a run takes: cities, then the increment or the forced range."""
    src = files.conform(filter_cities(source, cities), S.DAILY)  # raw schema at the boundary
    if mode != "incremental":
        if start is not None:
            src = src.filter(F.col("time") >= F.lit(start))
        return src if end is None else src.filter(F.col("time") <= F.lit(end))
    if force:
        return force_start(src, start or default_start, end)
    return select_increment(src, latest, end, start or default_start)


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    if not files.path_exists(spark, path):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path).drop("year")


def read_layer(spark: SparkSession, base: str, name: str, kind: str = "historical") -> DataFrame | None:
    """A stored layer as its readers see it: staging with outlier flags, analytics also with
    the anomaly, both joined from the maintained tables. None if the layer is absent."""
    paths = layer_paths(base, kind)
    rows = _read(spark, paths[name], S.DAILY if name == "raw" else None)
    if rows is None or name == "raw":
        return rows
    values = _read(spark, paths["history_values"])
    if values is None:  # layers of another writer: they hold what they hold
        return rows
    if name == "staging":
        return mt.with_history(rows, values)
    doy = _read(spark, paths["history_doy"])
    if "day_of_year" not in rows.columns or "anomaly_score" in rows.columns:  # fallback features bring their own
        return mt.with_history(rows, values)
    return mt.with_history(rows, values, doy)


def read_quantiles(spark: SparkSession, base: str, qs=(0.25, 0.5, 0.75), first_year: int | None = None,
                   last_year: int | None = None, kind: str = "historical") -> DataFrame:
    """Quantiles per city and measure over a range of years, from the stored summaries alone."""
    return sk.quantiles(sk.read_sketches(spark, layer_paths(base, kind)[SKETCHES], first_year, last_year), qs)


def _sketch_version(staging: DataFrame, paths, versions) -> None:
    """Summaries of the years that ``staging`` holds."""
    years = staging if "year" in staging.columns else staging.withColumn("year", F.year("time"))
    versions[SKETCHES] = files.version_folder(paths[SKETCHES])
    (sk.value_sketches(years, numeric_columns(years.drop("year"))).write.mode("overwrite")
     .partitionBy("year").parquet(versions[SKETCHES]))


def _full_versions(spark, raw, paths, repair, features, notes, versions) -> None:
    """Versions of everything derived from ``raw``. A derivation that fails as a plan gives
    way to its fallback: fill only, and features that need nothing but neighbouring rows."""
    def attempt(main, other, what):
        try:
            return main()
        except PySparkException as e:
            notes.append(f"fallback {what}: {type(e).__name__}")
            return other()

    staged = attempt(lambda: files.write_version(repair(raw), paths["staging"]),
                     lambda: files.write_version(fallback_clean(raw), paths["staging"]), "cleaning")
    versions["staging"], staging = staged
    versions["analytics"], _ = attempt(lambda: files.write_version(mt.row_features(features(staging)), paths["analytics"]),
                                       lambda: files.write_version(fallback_features(staging), paths["analytics"]), "features")
    for name, df in (("history_doy", mt.doy_sums(staging)), ("history_values", mt.value_counts(staging))):
        versions[name] = files.version_folder(paths[name])
        df.write.parquet(versions[name])
    _sketch_version(staging, paths, versions)


def _delta_versions(spark, paths, batch, repair, features, versions) -> dict:
    """Versions of the touched years; returns the years written of each layer."""
    stored = mt.Stored(*[spark.read.parquet(paths[name]) for name in (*LAYERS, *TABLES)])
    d = mt.delta(stored, batch, repair, features)
    for name in TABLES:
        versions[name] = files.version_folder(paths[name])
        (d.doy if name == "history_doy" else d.values).write.parquet(versions[name])
    for name in LAYERS:
        versions[name] = files.version_folder(paths[name])
        files.replace_all(getattr(d, name), versions[name])
    if d.years:
        _sketch_version(spark.read.parquet(versions["staging"]), paths, versions)
    return {"raw": d.raw_years, "staging": d.years, "analytics": d.years, SKETCHES: d.years}


def run_layers(spark: SparkSession, source: DataFrame, base: str, mode: str = "full",
               kind: str = "historical", cities=None, as_of: _dt.date | None = None,
               default_start: _dt.date = DEFAULT_START, end=None, chunk_rows: int | None = None,
               start: _dt.date | None = None, force: bool = False) -> dict:
    """One run with an audit record whatever its outcome (``status`` of the result):

    SUCCESS     the layers hold the run's rows
    UP_TO_DATE  an incremental run found no new rows and wrote nothing
    ABORTED     the row-count gate stopped it before any layer was touched
    ERROR       something failed; the record is written and the error raised again

    New versions are written beside the old ones and put in place all together, by a list of
    moves that is written first; a run starts by carrying out a list that an earlier run left
    behind, so a crash at any point leaves either state whole. An incremental run merges into
    the stored raw layer whatever else is stored: where a derived layer is absent, all of
    them are derived anew from the merged raw rows. ``start`` and ``end`` bound the rows of
    any mode; ``force`` reloads from ``start``. If the derivation of a layer fails as a plan,
    the run goes on with the fallback cleaning or features and says so in its notes.
    """
    if mode not in ("full", "forecast", "incremental"):
        raise ValueError(f"unknown mode {mode!r}")
    started, paths, versions, notes = _time.time(), layer_paths(base, kind), {}, []
    journal = f"{base.rstrip('/')}/switch_{kind}.journal"
    repair, features = derivations(chunk_rows)
    n = {name: 0 for name in LAYERS}
    record = {"cities": 0, "status": "ERROR", "notes": ""}
    out = {"checks": None}
    try:
        if files.recover(spark, journal, paths.values()):
            notes.append("finished the switch of an earlier run")
        present = {name: files.path_exists(spark, path) for name, path in paths.items()}
        merge, derived = mode == "incremental" and present["raw"], all(present.values())
        raw_before = _read(spark, paths["raw"], S.DAILY) if merge else spark.createDataFrame([], S.DAILY)
        batch = materialize(_chosen(source, cities, mode, store.latest_dates(raw_before), force, start, end, default_start))
        new_rows, record["cities"] = batch.agg(F.count(F.lit(1)), F.count_distinct("city")).first()
        if not new_rows and merge and derived:
            record["status"] = "UP_TO_DATE"
            notes.append("no new rows")
            out |= {name: read_layer(spark, base, name, kind) for name in LAYERS}
        elif not new_rows and not merge:
            raise Aborted("row_count: the source has no rows")
        else:
            years = {}
            if merge and derived:
                try:
                    years = _delta_versions(spark, paths, batch, repair, features, versions)
                except PySparkException as e:
                    notes.append(f"derived anew: {type(e).__name__}")
                    for folder in versions.values():
                        files.drop_version(spark, folder)
                    versions.clear()
            if not years:
                raw = store.upsert(raw_before, batch) if merge else batch
                versions["raw"], raw = files.write_version(raw, paths["raw"], S.DAILY)
                _full_versions(spark, raw, paths, repair, features, notes, versions)
            moves = []
            for name, folder in versions.items():
                moves += files.year_moves(spark, folder, paths[name], years[name]) if name in years else [(folder, paths[name])]
            switched = dict(versions)
            versions.clear()  # from here on the journal decides what becomes of them
            files.switch_versions(spark, journal, moves)
            for folder in switched.values():
                files.drop_version(spark, folder)
            files.recover(spark, journal, paths.values())  # removes what stepped aside
            out |= {name: read_layer(spark, base, name, kind) for name in LAYERS}
            record["status"] = "SUCCESS"
            # gap report of the staged series (one row per city, missing dates listed)
            date_gaps(_read(spark, paths["staging"])).write.mode("overwrite").parquet(f"{base.rstrip('/')}/gap_report_{kind}")
            counts = store.layer_counts({name: _read(spark, paths[name]) for name in n})
            n |= {r["table_name"]: r["row_count"] for r in counts.collect()}
        out["checks"] = run_all_checks(out["raw"], out["staging"], out["analytics"], as_of=as_of,
                                       names=tuple(f"{name}_{kind}" for name in n))
        quality = overall_status(out["checks"]).first()["overall"]
        record["notes"] = "; ".join([*notes, f"quality={quality}"])
    except Aborted as e:
        record |= {"status": "ABORTED", "notes": str(e)}
        out |= {name: read_layer(spark, base, name, kind) for name in LAYERS}
    except Exception as e:
        record |= {"status": "ERROR", "notes": f"{type(e).__name__}: {str(e)[:500]}"}
        raise
    finally:
        for folder in versions.values():
            files.drop_version(spark, folder)
        out["audit"] = store.append_audit(spark, f"{base.rstrip('/')}/pipeline_runs", mode, record["cities"], n["raw"],
                                          n["staging"], n["analytics"], started, record["status"], record["notes"])
    return out | {"status": record["status"]}
