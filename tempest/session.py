"""Session construction and cluster-shared paths."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. On a cluster these come from spark-defaults; the
# builder only fills what is unset so a cluster configuration always wins.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Parquet datasets written per layer are replaced partition by partition.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tempest", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TEMPEST_DRIVER_MEMORY", "8g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage (written tables, streams' progress).

    ``spark.checkpoint.dir`` names a folder every executor can reach and is always used as
    given. Only a local session may leave it unset (tests): it gets a scratch folder, removed
    when the process ends. Elsewhere an unset folder is an error, since executors would not
    find what the driver's disk holds.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tempest-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    if getattr(spark.sparkContext, "_tempest_checkpoint_dir", None) != configured:
        spark.sparkContext.setCheckpointDir(configured)
        spark.sparkContext._tempest_checkpoint_dir = configured
    return configured


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tempest-{spark.sparkContext.applicationId}"


def materialize(df):
    """Cut the lineage of a DataFrame that is read many times: a Parquet table in the shared
    folder, computed once (a checkpoint computes its plan twice), compressed, with statistics
    the planner can use, and safe from lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Remove this application's intermediate tables; call it when no result that was built
    from them is needed any more (the command line does at the end of a run)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
