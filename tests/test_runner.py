import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tempest import schemas as S
from tempest.plans import runner
from tempest.sources import files
from tempest.streaming.ingest import ingest_available
from tests.test_cli import _land


def panel(spark, days, start=dt.date(2024, 1, 1), cities=("baku", "ganja"), t=10.0):
    rows = []
    for c in cities:
        for i in range(days):
            v = {m: float(i % 7 + 1) for m in S.MEASURES}
            v["temperature_2m_mean"] = t + i
            rows.append((c, start + dt.timedelta(days=i), 40.0, 49.0, *[v[m] for m in S.MEASURES], 1))
    return spark.createDataFrame(rows, S.DAILY)


def statuses(spark, base):
    return [r["status"] for r in spark.read.parquet(f"{base}/pipeline_runs").orderBy("run_id").collect()]


def test_empty_source_leaves_the_store_alone(spark, scratch):
    base = f"{scratch}/layers"
    assert runner.run_layers(spark, panel(spark, 40), base)["status"] == "SUCCESS"
    res = runner.run_layers(spark, panel(spark, 40).filter("false"), base)
    assert res["status"] == "ABORTED" and res["raw"].count() == 80
    assert statuses(spark, base) == ["SUCCESS", "ABORTED"]


def test_unknown_city_keeps_all(spark, scratch):
    res = runner.run_layers(spark, panel(spark, 35), f"{scratch}/layers", cities=["Nowhere"])
    assert res["raw"].select("city").distinct().count() == 2
    res = runner.run_layers(spark, panel(spark, 35), f"{scratch}/layers", cities=["BAKU", "Nowhere"])
    assert [r["city"] for r in res["raw"].select("city").distinct().collect()] == ["baku"]


def test_crash_between_layers(spark, scratch, monkeypatch):
    base = f"{scratch}/layers"
    runner.run_layers(spark, panel(spark, 40), base)
    before = runner.run_layers(spark, panel(spark, 0), base, "incremental")["analytics"].count()

    def broken(*a, **k):
        raise RuntimeError("lost")
    monkeypatch.setattr(runner.mt, "delta", broken)
    with pytest.raises(RuntimeError):
        runner.run_layers(spark, panel(spark, 60), base, "incremental")
    monkeypatch.undo()
    assert spark.read.parquet(f"{base}/raw_historical").count() == 80
    assert spark.read.parquet(f"{base}/analytics_historical").count() == before
    assert not [f for f in os.listdir(base) if ".next-" in f or ".old-" in f]
    assert statuses(spark, base) == ["SUCCESS", "UP_TO_DATE", "ERROR"]
    res = runner.run_layers(spark, panel(spark, 60), base, "incremental")
    assert res["status"] == "SUCCESS" and res["raw"].count() == res["analytics"].count() == 120


def test_first_incremental_run_honours_its_limits(spark, scratch):
    res = runner.run_layers(spark, panel(spark, 100), f"{scratch}/layers", "incremental",
                            default_start=dt.date(2024, 1, 11), end=dt.date(2024, 2, 19))
    assert res["raw"].agg(F.min("time"), F.max("time")).first() == (dt.date(2024, 1, 11), dt.date(2024, 2, 19))


def test_forced_reload(spark, scratch):
    base = f"{scratch}/layers"
    runner.run_layers(spark, panel(spark, 40), base)
    res = runner.run_layers(spark, panel(spark, 40, t=50.0), base, "incremental", start=dt.date(2024, 2, 1), force=True)
    got = {r["time"]: r["temperature_2m_mean"] for r in res["raw"].filter("city = 'baku'").collect()}
    assert got[dt.date(2024, 1, 31)] == 40.0 and got[dt.date(2024, 2, 1)] == 81.0


def test_kinds_and_order_of_landed_files(spark, scratch):
    land = f"{scratch}/landing"
    _land(land, "baku", dt.date(2024, 1, 1), 5, 10)
    _land(land, "baku", dt.date(2024, 1, 1), 9, 30, kind="forecast")
    _land(f"{land}/later", "baku", dt.date(2024, 1, 3), 5, 20)
    os.utime(f"{land}/baku_historical.csv", (1_000_000_000, 1_000_000_000))
    assert files.read_city_csvs(spark, land, "historical").count() == 10
    assert files.read_city_csvs(spark, land, "forecast").count() == 9
    store = ingest_available(spark, land, f"{scratch}/store", f"{scratch}/ck")
    got = {str(r["time"]): (r["temperature_2m_mean"], r["batch_id"]) for r in store.collect()}
    assert len(got) == 7 and got["2024-01-02"] == (11.0, 0) and got["2024-01-03"] == (20.0, 0)


def without_gaps(df):
    return {tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}


def same(a, b):
    return without_gaps(a.select(*sorted(a.columns))) == without_gaps(b.select(*sorted(a.columns)))


def year_files(base, name):
    return {(d, f) for d in os.listdir(f"{base}/{name}") if d.startswith("year=") for f in os.listdir(f"{base}/{name}/{d}") if f.endswith(".parquet")}


def test_stored_raw_rows_outlive_a_lost_layer(spark, scratch):
    """Raw stored, analytics absent: an incremental run merges and derives anew."""
    import shutil

    base = f"{scratch}/layers"
    runner.run_layers(spark, panel(spark, 40), base)
    shutil.rmtree(f"{base}/analytics_historical")
    res = runner.run_layers(spark, panel(spark, 60), base, "incremental")
    assert res["status"] == "SUCCESS" and res["raw"].count() == res["analytics"].count() == 120
    shutil.rmtree(f"{base}/history_doy_historical")
    res = runner.run_layers(spark, panel(spark, 60), base, "incremental")  # nothing new, yet the table is missing
    assert res["status"] == "SUCCESS" and same(res["analytics"], runner.run_layers(spark, panel(spark, 60), f"{scratch}/full")["analytics"])


def test_touched_years_only(spark, scratch):
    """Late rows, null runs at the end, a new city: equal to one full run; other years keep their files."""
    start, base = dt.date(2022, 12, 1), f"{scratch}/layers"
    whole = panel(spark, 500, start, cities=("baku", "ganja", "sheki"))
    wet = (F.dayofyear("time") % 9 == 0) & (F.col("city") == "baku")
    whole = whole.withColumn("temperature_2m_mean", F.when(~wet, F.col("temperature_2m_mean") % 13))
    whole = whole.withColumn("pressure_msl_mean", F.when(~F.col("time").between("2024-01-20", "2024-02-20"), F.col("pressure_msl_mean")))
    late = F.col("time").between("2024-02-03", "2024-02-05")
    runner.run_layers(spark, whole.filter((F.col("city") != "sheki") & (F.col("time") <= "2024-02-10") & ~late), base)
    before = {name: year_files(base, f"{name}_historical") for name in ("raw", "staging", "analytics", "value_sketches")}
    res = runner.run_layers(spark, whole.filter("city != 'sheki'"), base, "incremental", start=dt.date(2024, 2, 3), force=True, end=dt.date(2024, 2, 5))
    assert res["status"] == "SUCCESS"
    res = runner.run_layers(spark, whole.filter("city != 'sheki'"), base, "incremental")
    for name, had in before.items():
        now = year_files(base, f"{name}_historical")
        assert {f for f in now if f[0] != "year=2024"} == {f for f in had if f[0] != "year=2024"} and now != had
    full = runner.run_layers(spark, whole.filter("city != 'sheki'"), f"{scratch}/full")
    assert same(res["analytics"], full["analytics"]) and same(res["staging"], full["staging"])
    for years in ((None, None), (2023, 2023), (2024, None)):
        a, b = (runner.read_quantiles(spark, x, (0.1, 0.5), *years) for x in (base, f"{scratch}/full"))
        assert sorted(a.drop("quantiles").collect()) == sorted(b.drop("quantiles").collect())
    got = runner.read_quantiles(spark, base, (0.5,), 2023, 2023).filter("city = 'baku' and variable = 'temperature_2m_mean'").first()
    days = sorted(r[0] for r in res["staging"].filter("city = 'baku' and year(time) = 2023").select("temperature_2m_mean").collect())
    assert got["n"] == 365 and abs(days.index(got["quantiles"][0]) / 365 - 0.5) < 0.1
    res = runner.run_layers(spark, whole, base, "incremental", default_start=start)
    assert same(res["analytics"], runner.run_layers(spark, whole, f"{scratch}/full")["analytics"])


def test_failing_plans_give_way_to_the_fallback(spark, scratch, monkeypatch):
    def wrong(raw):
        return raw.withColumn("city", F.raise_error(F.lit("no such repair")).cast("string"))
    monkeypatch.setattr(runner, "derivations", lambda chunk_rows: (wrong, wrong))
    res = runner.run_layers(spark, panel(spark, 40), f"{scratch}/layers")
    notes = spark.read.parquet(f"{scratch}/layers/pipeline_runs").first()["notes"]
    assert res["status"] == "SUCCESS" and "fallback cleaning" in notes and "fallback features" in notes
    assert res["analytics"].count() == 80 and "anomaly_score" in res["analytics"].columns


class Lost(RuntimeError):
    pass


def test_a_switch_interrupted_anywhere_is_finished(spark, scratch, monkeypatch):
    real = files._fs_path
    for stop in range(8):
        base = f"{scratch}/{stop}"
        layers = [f"{base}/a", f"{base}/b"]
        for path in layers:
            for year in (1, 2):
                spark.range(1).selectExpr("'old' as v", f"{year} as year").write.mode("append").partitionBy("year").parquet(path)
        new = [files.version_folder(p) for p in layers]
        spark.range(1).selectExpr("'new' as v", "1 as year").write.partitionBy("year").parquet(new[0])
        spark.range(1).selectExpr("'new' as v", "3 as year").write.partitionBy("year").parquet(new[1])
        moves = [(new[0], layers[0]), *files.year_moves(spark, new[1], layers[1], [2, 3])]
        left = [stop]

        class Fs:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return getattr(self.fs, name)

            def rename(self, a, b):
                if not left[0]:
                    raise Lost
                left[0] -= 1
                return self.fs.rename(a, b)

        monkeypatch.setattr(files, "_fs_path", lambda s, p: (lambda x: (x[0], Fs(x[1])))(real(s, p)))
        try:
            files.switch_versions(spark, f"{base}/switch", moves)
        except Lost:
            pass
        monkeypatch.setattr(files, "_fs_path", real)
        files.recover(spark, f"{base}/switch", layers)
        got = [{(r["v"], r["year"]) for r in spark.read.parquet(p).collect()} for p in layers]
        old, done = {("old", 1), ("old", 2)}, [{("new", 1)}, {("old", 1), ("new", 3)}]
        assert got == ([old, old] if stop == 0 else done), stop
        assert sorted(f for f in os.listdir(base) if not f.startswith(".")) == ["a", "b"]


def test_an_aside_version_is_put_back(spark, scratch):
    spark.range(3).write.parquet(f"{scratch}/a.old-1")
    spark.range(1).write.parquet(f"{scratch}/a.next-1")
    assert not files.recover(spark, f"{scratch}/switch", [f"{scratch}/a"])
    assert spark.read.parquet(f"{scratch}/a").count() == 3 and os.listdir(scratch) == ["a"]


def test_run_ids_are_claimed(spark, scratch):
    from tempest.sources import store

    assert [store.claim_run_id(spark, f"{scratch}/runs") for _ in range(3)] == [1, 2, 3]
