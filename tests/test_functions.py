import datetime as dt

from pyspark.sql import functions as F

from tempest.functions import calendar as cal
from tempest.functions import weather as wx


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_degree_days_keep_null(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,)], "t double")
    out = rows(df.select(wx.heating_degree_days("t").alias("hdd"), wx.cooling_degree_days("t").alias("cdd")))
    assert out == [{"hdd": 8.0, "cdd": 0.0}, {"hdd": 0.0, "cdd": 2.0}, {"hdd": None, "cdd": None}]


def test_impact_score_caps_and_null_operands(spark):
    df = spark.createDataFrame([(40.0, 30.0, 80.0), (70.0, 50.0, 90.0), (None, 25.0, None)],
                               "temperature_2m_max double, wind_speed_10m_max double, relative_humidity_2m_mean double")
    got = [r[0] for r in df.select(wx.impact_score()).collect()]
    assert got == [30.0 + 20.0 + 10.0, 100.0, 10.0]


def test_weather_category_and_condition_group(spark):
    df = spark.createDataFrame([(0,), (2,), (45,), (63,), (77,), (82,), (96,), (7,)], "weather_code int")
    cats = [r[0] for r in df.select(wx.weather_category()).collect()]
    assert cats == ["Clear Sky", "Cloudy", "Fog", "Rain", "Snowfall", "Rain Showers", "Thunderstorm", "Cloudy"]
    t = spark.createDataFrame([("Heavy Rain",), ("light snow showers",), ("Mist",), ("Sunny",), (None,), ("odd",)], "c string")
    groups = [r[0] for r in t.select(wx.condition_group("c")).collect()]
    assert groups == ["Rain", "Snowfall", "Fog", "Clear Sky", "Cloudy", "Cloudy"]


def test_season_year_december_january(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 31),), (dt.date(2021, 1, 1),), (dt.date(2021, 3, 1),)], "time date")
    out = rows(df.select(cal.season_year().alias("sy"), cal.season(F.month("time")).alias("s")))
    assert out == [{"sy": 2020, "s": "winter"}, {"sy": 2020, "s": "winter"}, {"sy": 2021, "s": "spring"}]


def test_leap_day_and_weekend(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2020, 3, 1),), (dt.date(2021, 3, 1),)], "time date")
    out = rows(df.select(F.dayofyear("time").alias("doy"), cal.is_weekend().alias("we"), cal.date_ord().alias("o")))
    assert out == [{"doy": 60, "we": 1, "o": 20200229}, {"doy": 61, "we": 1, "o": 20200301},
                   {"doy": 60, "we": 0, "o": 20210301}]


def test_canonical_city_names(spark):
    df = spark.createDataFrame([("  bandar-e anzali ",), ("BAKU",), ("sumqayit",)], "c string")
    assert [r[0] for r in df.select(wx.canonical_city("c")).collect()] == ["Bandar-e Anzali", "Baku", "Sumqayit"]


def test_ratios_on_zero_precipitation(spark):
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 1.0)], "p double, r double")
    assert [r[0] for r in df.select(wx.safe_ratio("r", "p")).collect()] == [None, 0.25]


def test_impact_band(spark):
    df = spark.createDataFrame([(None,), (39.9,), (40.0,), (70.0,)], "s double")
    assert [r[0] for r in df.select(wx.impact_band("s")).collect()] == ["unknown", "low", "medium", "high"]


def test_city_alias_resolution(spark):
    from tempest.operators.joins import resolve_city_aliases

    df = spark.createDataFrame([("Sumqayit", 1), ("Gakh", 2), ("Baku", 3)], "city string, v int")
    assert sorted((r["city"], r["v"]) for r in resolve_city_aliases(df).collect()) == [
        ("Baku", 3), ("Kakh", 2), ("Sumgayit", 1)]
