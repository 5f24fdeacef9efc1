"""File sources and sinks: landed CSV, panel CSV, forecast/energy JSON, Parquet layers (A1, A2,
A6, A7, A9, A14)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest import schemas as S


def landed_glob(kind: str, layout: str) -> str:
    """File name pattern of landed files of a kind."""
    if layout not in ("flat", "folders"):
        raise ValueError(f"unknown layout {layout!r}")
    return f"*_{kind}.csv" if layout == "flat" else "*.csv"


def read_city_csvs(spark: SparkSession, path: str, kind: str = "forecast",
                   schema: T.StructType = S.DAILY_CSV, dir_key: str = "city",
                   layout: str = "flat") -> DataFrame:
    """Landed files of one kind under ``path`` (recursively).

    ``layout="flat"`` reads ``<city>_<kind>.csv`` files only (files of other kinds in the
    same folder are not touched) and takes the city from the file name (lower case,
    URL-decoded: names may hold spaces). ``layout="folders"`` reads every CSV of a folder
    that holds one kind, as Spark writes it: ``<dir_key>=<name>/part-*.csv`` take the folder
    value, anything else the body's city. The body's own ``city`` column is kept as
    ``city_label``. ``time`` becomes DateType here.
    """
    df = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", landed_glob(kind, layout)).csv(path))
    fname = F.col("_metadata.file_name")
    fpath = F.col("_metadata.file_path")
    from_name = F.regexp_extract(fname, rf"^(.*)_{kind}\.csv$", 1)
    from_dir = F.regexp_extract(fpath, rf"/{dir_key}=([^/]+)/", 1)
    city = (F.when(from_name != "", from_name).when(from_dir != "", from_dir)
            .otherwise(F.col("city")))
    decoded = F.lower(F.url_decode(city))
    out = df.select(decoded.alias("city_file"), *[F.col(c) for c in df.columns])
    return conform(out.withColumnRenamed("city", "city_label")
                   .withColumn("city", F.col("city_file"))
                   .withColumn("time", F.to_date("time")),
                   S.DAILY, keep_extra=("city_label",))


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType = S.DAILY_CSV) -> DataFrame:
    """A combined panel CSV with a header; ``time`` parsed to a date."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return conform(df.withColumn("time", F.to_date("time")), S.DAILY)


def conform(df: DataFrame, schema: T.StructType = S.DAILY, keep_extra=()) -> DataFrame:
    """Force a schema: absent columns become typed nulls, extras are dropped, order fixed,
    types cast (a date given as text is parsed)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if isinstance(f.dataType, T.DateType):
                c = F.to_date(c)
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    cols += [F.col(c) for c in keep_extra if c in df.columns]
    return df.select(*cols)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for any scheme)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_first_available(spark: SparkSession, candidates, table: str | None = None) -> DataFrame | None:
    """First existing Parquet path among ``candidates``, else the catalog table, else None."""
    for path in candidates:
        if path_exists(spark, path):
            return spark.read.parquet(path)
    if table and spark.catalog.tableExists(table):
        return spark.table(table)
    return None


def layout_for_write(df: DataFrame, partition_by=("year",), cluster=("city", "time")) -> DataFrame:
    """Range-partition on the directory columns plus the clustering key, then sort inside
    each task: a task covers a contiguous (year, city) range, so it writes one or two year
    directories (few, large files instead of years x tasks small ones), and the Parquet
    min/max statistics of city and time become selective for later filters."""
    part = [c for c in partition_by if c in df.columns]
    clus = [c for c in cluster if c in df.columns]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *part, *clus[:1]).sortWithinPartitions(*part, *clus)


def write_layer(df: DataFrame, path: str, partition_by=("year",), mode: str = "overwrite") -> None:
    """Write a layer as Parquet partitioned by year. With dynamic partition overwrite only
    the partitions present in ``df`` are replaced."""
    out = df
    if "year" in partition_by and "year" not in df.columns:
        out = df.withColumn("year", F.year("time"))
    layout_for_write(out, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def replace_all(df: DataFrame, path: str, partition_by=("year",)) -> None:
    """Full replacement of a layer (full mode, forecasts): static overwrite of every partition."""
    out = df if "year" in df.columns else df.withColumn("year", F.year("time"))
    (layout_for_write(out, partition_by).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path))


def write_single_csv(df: DataFrame, path: str) -> None:
    """Land a small extract as one CSV file of the given name (not a folder of parts)."""
    spark = df.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex[:12]}"
    df.coalesce(1).write.option("header", True).csv(folder)
    parts, fs = _fs_path(spark, folder)
    part = next(f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    if not fs.rename(part, _fs_path(spark, path)[0]):
        raise OSError(f"{path} could not be written")
    fs.delete(parts, True)


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_version(df: DataFrame, path: str, schema: T.StructType | None = None) -> tuple[str, DataFrame]:
    """Write a full new version of the layer at ``path`` beside it. Returns its folder and
    the version read back (with the explicit schema, so an empty version reads as well)."""
    folder = version_folder(path)
    replace_all(df, folder)
    names = df.schema if schema is None else schema
    back = df.sparkSession.read.schema(T.StructType([f for f in names.fields if f.name != "year"])).parquet(folder)
    return folder, back.drop("year")


def version_folder(path: str) -> str:
    return f"{path.rstrip('/')}.next-{uuid.uuid4().hex[:12]}"


def year_moves(spark: SparkSession, folder: str, path: str, years) -> list:
    """Moves that put the written years of a version in place of a layer's; a year of
    ``years`` that the version does not hold any more leaves the layer."""
    parent, fs = _fs_path(spark, folder)
    written = {f.getPath().getName() for f in fs.listStatus(parent)} if fs.exists(parent) else set()
    names = [f"year={y}" for y in years]
    return [(f"{folder}/{n}" if n in written else None, f"{path.rstrip('/')}/{n}") for n in names]


def switch_versions(spark: SparkSession, journal: str, moves: list) -> None:
    """Put written versions in place, all or none: the list of moves (new folder or None,
    place) is written to ``journal`` first, and a run that finds a journal carries it out to
    its end (``recover``). Needs a file system whose rename of a folder is atomic."""
    draft, fs = _fs_path(spark, f"{journal}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(moves).encode()))
    out.close()
    if not fs.rename(draft, _fs_path(spark, journal)[0]):
        raise OSError(f"{journal} could not be written")
    _carry_out(spark, journal, moves)


def _carry_out(spark: SparkSession, journal: str, moves: list) -> None:
    for folder, place in moves:
        target, fs = _fs_path(spark, place)
        new = _fs_path(spark, folder)[0] if folder else None
        if new is not None and not fs.exists(new):
            continue  # moved before
        if fs.exists(target):
            layer, _, name = place.rpartition("/") if "/year=" in place else (place, "", "")
            aside = _fs_path(spark, "/".join(filter(None, [f"{layer}.old-{uuid.uuid4().hex[:12]}", name])))[0]
            fs.mkdirs(aside.getParent())
            if not fs.rename(target, aside):
                raise OSError(f"{place} could not be moved aside")
        fs.mkdirs(target.getParent())
        if new is not None and not fs.rename(new, target):
            raise OSError(f"{folder} could not be moved to {place}")
    path, fs = _fs_path(spark, journal)
    fs.delete(path, False)


def recover(spark: SparkSession, journal: str, paths) -> bool:
    """Bring the layers at ``paths`` into one consistent state after a run that broke off: a
    journal is carried out to its end; without one, a layer that is missing while an older
    version stands aside gets that back. Leftover versions are removed. True if a journal
    was found."""
    path, fs = _fs_path(spark, journal)
    found = bool(fs.exists(path))
    if found:
        text = spark.read.text(journal, wholetext=True).first()[0]
        _carry_out(spark, journal, [tuple(m) for m in json.loads(text)])
    fs.delete(_fs_path(spark, f"{journal}.draft")[0], False)
    for layer in paths:
        target = _fs_path(spark, layer)[0]
        if not fs.exists(target.getParent()):
            continue
        beside = [f for f in fs.listStatus(target.getParent()) if f.getPath().getName().startswith(target.getName() + ".")]
        old = [f for f in beside if f.getPath().getName().startswith(target.getName() + ".old-")]
        if old and not fs.exists(target):
            fs.rename(max(old, key=lambda f: f.getModificationTime()).getPath(), target)
        for f in beside:
            if fs.exists(f.getPath()):
                fs.delete(f.getPath(), True)
    return found


def drop_version(spark: SparkSession, folder: str) -> None:
    path, fs = _fs_path(spark, folder)
    fs.delete(path, True)


def read_forecast_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{"cities": {city: [day, ...]}}`` documents -> one row per (city, day).
    The city key is matched case-insensitively downstream: ``city_key`` is lower case.
    ``multi_line=False`` reads one document per line (many documents split across tasks)."""
    doc = spark.read.schema(S.FORECAST_DOC).option("multiLine", multi_line).json(path)
    per_city = doc.select(F.explode("cities").alias("city", "days"))
    days = per_city.select("city", F.posexplode("days").alias("pos", "d"))
    return days.select(F.col("city"), F.lower("city").alias("city_key"), "pos",
                       F.to_date("d.date").alias("date"), "d.temperature_2m_max",
                       "d.temperature_2m_min", "d.relative_humidity_2m_mean",
                       "d.weather_category", "d.impact_score", "d.persistence_alert_level")


def read_energy_json(spark: SparkSession, path: str, multi_line: bool = True):
    """Energy documents -> (hourly rows, model metric rows)."""
    doc = spark.read.schema(S.ENERGY_DOC).option("multiLine", multi_line).json(path)
    hours = (doc.select(F.explode("locations").alias("city", "rows"))
             .select("city", F.explode("rows").alias("r")).select("city", "r.*"))
    metrics = doc.select(F.explode("model_metrics").alias("m")).select("m.*")
    return hours, metrics
