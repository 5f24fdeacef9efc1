import json
import os

from tempest.sources import files

HEADER = ("time,city,latitude,longitude,temperature_2m_max,temperature_2m_min,temperature_2m_mean,"
          "apparent_temperature_max,precipitation_sum,rain_sum,snowfall_sum,wind_speed_10m_max,wind_gusts_10m_max,"
          "relative_humidity_2m_mean,cloud_cover_mean,pressure_msl_mean,shortwave_radiation_sum,weather_code")


def test_city_from_file_name_with_space(spark, scratch):
    for name, label in (("bandar-e anzali", "Bandar-E Anzali"), ("baku", "Baku")):
        with open(os.path.join(scratch, f"{name}_forecast.csv"), "w") as fh:
            fh.write(HEADER + "\n")
            fh.write(f"2026-04-21,{label},37.4,49.4,20,10,15,19,0,0,0,12,20,70,40,1012,18,3\n")
    df = files.read_city_csvs(spark, scratch, "forecast")
    got = sorted((r["city"], r["city_label"], r["weather_code"]) for r in df.collect())
    assert got == [("baku", "Baku", 3), ("bandar-e anzali", "Bandar-E Anzali", 3)]
    assert dict(df.dtypes)["time"] == "date"


def test_forecast_json_case_insensitive_key(spark, scratch):
    doc = {"cities": {"Baku": [{"date": "2026-04-21", "temperature_2m_max": 21.0, "temperature_2m_min": 11.0,
                                "relative_humidity_2m_mean": 60.0, "weather_category": "Rain",
                                "impact_score": 5.0, "persistence_alert_level": 0}]}}
    p = os.path.join(scratch, "forecast.json")
    with open(p, "w") as fh:
        json.dump(doc, fh, indent=2)
    r = files.read_forecast_json(spark, p).first()
    assert (r["city_key"], r["temperature_2m_max"], str(r["date"])) == ("baku", 21.0, "2026-04-21")


def test_read_first_available(spark, scratch):
    assert files.read_first_available(spark, [f"{scratch}/raw.parquet"]) is None
    spark.range(3).write.parquet(f"{scratch}/raw_historical.parquet")
    df = files.read_first_available(spark, [f"{scratch}/raw.parquet", f"{scratch}/raw_historical.parquet"])
    assert df.count() == 3


def test_energy_json_both_solar_names(spark, scratch):
    from tempest.operators.aggregates import energy_daily

    doc = {"locations": {"Baku": [
        {"year": 2026, "month": 4, "day": 21, "hour": 0, "Envision_wind_kWh": 1.005, "Fuhrlander_wind_kWh": None,
         "Jinko_Solar_solar_kWh": 2.0, "Trina_Solar_kWh": 1.0},
        {"year": 2026, "month": 4, "day": 21, "hour": 1, "Envision_wind_kWh": 2.0, "Fuhrlander_wind_kWh": 1.0,
         "Jinko_Solar_kWh": 0.5, "Trina_Solar_kWh": None},
        {"year": None, "month": 4, "day": 21, "hour": 2, "Envision_wind_kWh": 100.0}]},
        "model_metrics": [{"target": "temperature_2m", "test_r2": 0.9, "test_rmse": 1.1}]}
    p = os.path.join(scratch, "energy.json")
    with open(p, "w") as fh:
        json.dump(doc, fh)
    hours, metrics = files.read_energy_json(spark, p)
    d = energy_daily(hours).first()
    assert (d["wind"], d["solar"], d["total"]) == (4.01, 3.5, 7.51)
    assert metrics.first()["test_rmse"] == 1.1


def test_pick_model_metrics(spark, scratch):
    from tempest.operators.aggregates import pick_model_metrics

    m = spark.createDataFrame([("temperature_2m", 0.9, 1.1), ("wind_speed_10m", 0.7, 2.0)],
                              "target string, test_r2 double, test_rmse double")
    r = pick_model_metrics(m).first()
    assert (r["temp_r2"], r["wind_rmse"], r["solar_r2"]) == (0.9, 2.0, 0.0)
