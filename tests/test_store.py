import datetime as dt
import time

from pyspark.sql import functions as F

from tempest.operators.loading import ingest_status, ingest_summary, select_increment
from tempest.sources import store

D0 = dt.date(2021, 5, 1)
SCHEMA = "city string, time date, x double, seq int"


def test_upsert_batch_wins_and_last_in_batch_wins(spark):
    target = spark.createDataFrame([("a", D0, 1.0, 0), ("a", D0 + dt.timedelta(days=1), 1.0, 0)], SCHEMA).drop("seq")
    batch = spark.createDataFrame([("a", D0, 2.0, 1), ("a", D0, 3.0, 2), ("b", D0, 9.0, 1)], SCHEMA)
    out = {(r["city"], r["time"]): r["x"] for r in store.upsert(target, batch, seq="seq").collect()}
    assert out == {("a", D0): 3.0, ("a", D0 + dt.timedelta(days=1)): 1.0, ("b", D0): 9.0}


def test_upsert_twice_equals_once(spark, scratch):
    batch = spark.createDataFrame([("a", D0, 2.0, 1), ("b", D0, 9.0, 1)], SCHEMA).drop("seq")
    path = f"{scratch}/store"
    once = sorted(store.upsert_to_path(spark, path, batch).collect())
    twice = sorted(store.upsert_to_path(spark, path, batch).collect())
    assert once == twice and len(once) == 2


def test_increment_unseen_city_and_up_to_date(spark):
    batch = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), 1.0, 0) for i in range(3)]
                                  + [("new", dt.date(2019, 12, 31), 1.0, 0), ("new", dt.date(2020, 1, 1), 1.0, 0)], SCHEMA)
    latest = spark.createDataFrame([("a", D0 + dt.timedelta(days=1))], "city string, last_date date")
    got = sorted((r["city"], r["time"]) for r in select_increment(batch, latest).collect())
    assert got == [("a", D0 + dt.timedelta(days=2)), ("new", dt.date(2020, 1, 1))]


def test_audit_run_ids_increment(spark, scratch):
    path = f"{scratch}/runs"
    a = store.append_audit(spark, path, "full", 1, 10, 9, 9, time.time(), "SUCCESS").first()
    b = store.append_audit(spark, path, "incremental", 1, 2, 2, 2, time.time(), "SUCCESS").first()
    assert (a["run_id"], b["run_id"]) == (1, 2)
    assert spark.read.parquet(path).count() == 2


def test_ingest_status_equals_the_summary_of_the_increment(spark):
    d = dt.date
    source = spark.createDataFrame([("a", d(2020, 1, 5)), ("a", d(2020, 1, 9)), ("b", d(2020, 1, 3)), ("c", d(2020, 1, 20)),
                                    ("d", d(2020, 1, 2)), ("e", None)], "city string, time date")
    latest = spark.createDataFrame([("a", d(2020, 1, 4)), ("b", d(2020, 1, 3)), ("f", d(2020, 1, 1))], "city string, last_date date")
    for end in (d(2020, 1, 10), None):
        got = {r["city"]: r["status"] for r in ingest_status(source, latest, end, d(2020, 1, 1)).collect()}
        everyone = source.select("city").unionByName(latest.select("city"))
        want = ingest_summary(everyone, select_increment(source, latest, end, d(2020, 1, 1)))
        assert got == {r["city"]: r["status"] for r in want.collect()}
        assert (got["a"], got["b"], got["c"], got["f"]) == ("updated", "skipped", "skipped" if end else "updated", "skipped")
    assert ingest_status(source.limit(0), latest.limit(0)).count() == 0
