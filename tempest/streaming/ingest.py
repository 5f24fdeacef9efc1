"""Incremental ingestion of newly landed files (M1) with Structured Streaming.

A file-source stream over the landing folder feeds ``foreachBatch``: each micro-batch is
merged into the store with the keyed upsert (A8); with ``only_newer`` it is first reduced
to rows newer than the store's last date per city (A11), the fetch-side rule of
incremental loads (landed files may arrive in any order, so it is off by default). Upsert is idempotent, so a micro-batch replayed after a failure leaves the
store unchanged; the stream's checkpoint records which files were consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest import schemas as S
from tempest.operators.loading import select_increment
from tempest.sources import files, store


def landed_stream(spark: SparkSession, landing: str, kind: str = "historical",
                  max_files_per_trigger: int | None = None, dir_key: str = "city",
                  layout: str = "flat") -> DataFrame:
    """Rows of landed files of one kind (layouts as in ``files.read_city_csvs``) and their
    ``seq``: modification time and name of the file, so later files win."""
    reader = (spark.readStream.schema(S.DAILY_CSV).option("header", True)
              .option("recursiveFileLookup", True).option("pathGlobFilter", files.landed_glob(kind, layout)))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(landing)
    fname, fpath = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    from_name = F.regexp_extract(fname, rf"^(.*)_{kind}\.csv$", 1)
    from_dir = F.regexp_extract(fpath, rf"/{dir_key}=([^/]+)/", 1)
    city = F.lower(F.url_decode(F.when(from_name != "", from_name).when(from_dir != "", from_dir)
                                .otherwise(F.col("city"))))
    seq = F.struct(F.col("_metadata.file_modification_time").alias("at"), fpath.alias("file"))
    return files.conform(raw.withColumn("city", city).withColumn("time", F.to_date("time")).withColumn("seq", seq),
                         S.DAILY, keep_extra=("seq",))


def upsert_batch(spark: SparkSession, store_path: str, end=None, only_newer: bool = False):
    """foreachBatch handler: (optional) increment selection against the store, then upsert.
    The rows carry the id of the batch that brought them (``batch_id``)."""
    def handle(batch: DataFrame, batch_id: int):
        batch = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        if only_newer and files.path_exists(spark, store_path):
            latest = store.latest_dates(spark.read.parquet(store_path))
            new = select_increment(batch, latest, end)
        else:
            new = batch
        store.upsert_to_path(spark, store_path, new, seq="seq" if "seq" in new.columns else None)
    return handle


def ingest_available(spark: SparkSession, landing: str, store_path: str, checkpoint: str,
                     kind: str = "historical", max_files_per_trigger: int | None = None,
                     dir_key: str = "city", end=None, only_newer: bool = False,
                     layout: str = "flat") -> DataFrame:
    """Process every file landed so far (availableNow) and return the store."""
    q = (landed_stream(spark, landing, kind, max_files_per_trigger, dir_key, layout).writeStream
         .foreachBatch(upsert_batch(spark, store_path, end, only_newer))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(store_path)
