"""Days of calendars that no DATE can hold, from a model's time axis to its components."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trendloom.functions import calendar
from trendloom.operators import eof, fields

LENGTHS = {"360_day": 360, "noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366}


def month_days(name, month):
    if name == "360_day":
        return 30
    return {2: 28 if LENGTHS[name] == 365 else 29, 4: 30, 6: 30, 9: 30, 11: 30}.get(month, 31)


def walk(name, years):
    """Every day of the years in order: (year, month, day, day of the year)."""
    for year in years:
        doy = 0
        for month in range(1, 13):
            for day in range(1, month_days(name, month) + 1):
                doy += 1
                yield year, month, day, doy


@pytest.mark.parametrize("name", sorted(LENGTHS))
def test_days_count_on_and_back_in_every_calendar(spark, name):
    rows = [(i - 2 * LENGTHS[name], *d) for i, d in enumerate(walk(name, range(1968, 1973)))]
    df = spark.createDataFrame(rows, "number int, year int, month int, day int, doy int").withColumn("cal", F.lit(name))
    parts = calendar.date_parts(F.col("number"), F.col("cal"))
    found = df.select("*", calendar.date_number(F.col("year"), F.col("month"), F.col("day"), F.col("cal")).alias("n"), calendar.day_number(F.col("year"), F.col("doy"), F.col("cal")).alias("m"), parts.alias("p"),
                      calendar.date_text(F.col("number"), F.col("cal")).alias("text"), calendar.in_season(F.col("number"), "warm", F.col("cal")).alias("warm"), calendar.season_year(F.col("number"), "warm", F.col("cal")).alias("of")).collect()
    for r in found:
        assert r.n == r.m == r.number and tuple(r.p) == (r.year, r.month, r.day, r.doy) and r.text == f"{r.year:04d}-{r.month:02d}-{r.day:02d}"
        assert r.warm == (r.month in (11, 12, 1, 2, 3)) and r.of == r.year + (r.month >= 11)


def test_real_calendars_are_dates(spark):
    rows = [((d := dt.date(1899, 12, 25) + dt.timedelta(i)), d.year, d.month, d.day, d.timetuple().tm_yday) for i in range(0, 60_000, 37)]
    df = spark.createDataFrame(rows, "date date, year int, month int, day int, doy int")
    for name in ("standard", "Gregorian", None):
        cal = F.lit(name).cast("string")
        found = df.select(F.unix_date("date").alias("want"), calendar.date_number(F.col("year"), F.col("month"), F.col("day"), cal).alias("n"), calendar.day_number(F.col("year"), F.col("doy"), cal).alias("m"),
                          calendar.date_parts(F.unix_date("date"), cal).alias("p"), "year", "month", "day", "doy").collect()
        assert all(r.want == r.n == r.m and tuple(r.p) == (r.year, r.month, r.day, r.doy) for r in found)


def test_days_that_a_calendar_does_not_have(spark):
    rows = [("noleap", 2, 29, False), ("all_leap", 2, 29, True), ("360_day", 2, 30, True), ("360_day", 1, 31, False), ("standard", 2, 29, True), ("standard", 2, 30, False), ("noleap", 13, 1, False), ("noleap", 1, 0, False)]
    df = spark.createDataFrame(rows, "cal string, month int, day int, there boolean")
    assert all((r.n is not None) == r.there for r in df.select("there", calendar.date_number(F.lit(2000), F.col("month"), F.col("day"), F.col("cal")).alias("n")).collect())
    with pytest.raises(PySparkException, match="unknown calendar: martian"):
        spark.range(1).select(calendar.known_calendar(F.lit("martian"))).collect()


def test_time_axes(spark):
    def decode(value, units, cal):
        r = spark.range(1).select(calendar.decoded_time(F.lit(value).cast("double"), units, F.lit(cal)).alias("t"), calendar.date_text(calendar.decoded_time(F.lit(value).cast("double"), units, F.lit(cal))["day"], F.lit(cal)).alias("text")).first()
        return r.text, r.t.second

    assert decode(0, "days since 1850-01-01", "360_day") == ("1850-01-01", 0)
    assert decode(59.25, "days since 1850-01-01", "360_day") == ("1850-02-30", 21600)
    assert decode(58.25, "days since 1850-1-1 12:00:00", "noleap") == ("1850-02-28", 64800)
    assert decode(59, "days since 1850-01-01", "noleap") == ("1850-03-01", 0)
    assert decode(-6, "hours since 2000-03-01T00:00:00Z", "standard") == ("2000-02-29", 64800)
    assert decode(1.5, "hours since 1999-12-31 23:00", "all_leap") == ("2000-01-01", 1800)
    assert decode(86399, "seconds since 1970-01-01", "standard") == ("1970-01-01", 86399)
    assert decode(1 / 3, "days since 1970-01-01", "standard") == ("1970-01-01", 28800)  # a third is not exact
    for bad in ("fortnights since 1850-01-01", "days after 1850-01-01", "1850-01-01"):
        with pytest.raises(ValueError, match="time axis"):
            calendar.decoded_time(F.lit(1.0), bad, F.lit("noleap"))


def model_steps(spark, name, years=3, amplitude=5.0, trend=0.4, steps=(0, 21_600, 43_200, 64_800)):
    """Six-hourly steps on 3 x 4 cells: an annual cycle of the calendar, a trend, a daily cycle that the daily mean takes out, and
    two patterns in turn."""
    lats, lons = [-20.0, -30.0, -40.0], [140.0, 145.0, 150.0, 155.0]
    per, rng = LENGTHS[name], np.random.default_rng(4)
    a = rng.normal(size=years * per)
    i, s, y, x = (v.ravel() for v in np.meshgrid(np.arange(years * per), steps, range(3), range(4), indexing="ij"))
    value = 1013.0 + amplitude * np.sin(2 * np.pi * (i % per + 1) / per) + trend * i / per + 2 * np.cos(2 * np.pi * s / 86_400) + a[i] * (y - 1) * (1 + 0.1 * x)
    table = pa.table({"variable": ["mslp"] * len(i), "day": i.astype(np.int32), "second": s.astype(np.int32), "calendar": [name] * len(i), "lat": np.array(lats)[y], "lon": np.array(lons)[x], "value": value})
    return spark.createDataFrame(table), a


@pytest.mark.parametrize("name", ["360_day", "noleap", "all_leap"])
def test_the_cycle_of_a_calendar_is_removed(spark, name):
    field, _ = model_steps(spark, name, amplitude=5.0, trend=0.0, steps=(0,))
    day = fields.daily_mean(field)
    assert set(day.columns) == {"day", "calendar", "lat", "lon", "value"}
    flat = day.filter("lat = -30")  # where the patterns are 0
    right = max(abs(r.value) for r in fields.anomaly(flat, 3).collect())
    wrong = max(abs(r.value) for r in fields.anomaly(flat, 3, year_days=365.25).collect())
    assert right < 1e-6 and (wrong > 5 * max(right, 1e-3) or name != "360_day")


@pytest.mark.parametrize("name", ["360_day", "noleap", "all_leap"])
def test_steps_of_a_model_become_components(spark, name):
    """The whole way, by numpy too: regridded, daily, without cycle and trend, scaled by what was observed, projected."""
    steps, a = model_steps(spark, name)
    grid = steps.select("lat", "lon").distinct()
    scales = spark.createDataFrame([("mslp", 3.0)], "variable string, scale double")
    matrix, cells = eof.prepare_like_observations(steps, grid, scales, harmonics=2)
    assert cells.count() == 12 and matrix.count() == len(a) * 12
    lats = np.repeat([-40.0, -30.0, -20.0], 4)
    raw = np.array([[a_ * (y - 1) * (1 + 0.1 * x) for y in (2, 1, 0) for x in range(4)] for a_ in a])
    per = LENGTHS[name]
    t = np.arange(len(a))
    raw = raw + (0.4 * t / per + 5 * np.sin(2 * np.pi * (t % per + 1) / per))[:, None]
    terms = np.stack([np.ones(len(t)), *[f(2 * np.pi * k * (t % per + 1) / per) for k in (1, 2) for f in (np.cos, np.sin)]], 1)
    raw = raw - terms @ np.linalg.lstsq(terms, raw, rcond=None)[0]
    line = np.stack([np.ones(len(t)), t / per], 1)
    raw = (raw - line @ np.linalg.lstsq(line, raw, rcond=None)[0]) / 3.0 * np.sqrt(np.cos(np.radians(lats)))
    loadings = np.random.default_rng(1).normal(size=(2, 12))
    patterns = spark.createDataFrame([(m, c, float(loadings[m, c])) for m in range(2) for c in range(12)], "mode int, cell int, loading double")
    got = eof.project(matrix, patterns).toPandas().pivot(index="day", columns="mode", values="pc").sort_index()
    assert np.allclose(got.to_numpy(), (raw - raw.mean(0)) @ loadings.T, atol=1e-6) and got.index.tolist() == t.tolist()


def test_a_shift_may_end_on_the_thirtieth_of_february(spark):
    rows = [(day, s, "360_day", -30.0, 140.0, float(day)) for day in (58, 59) for s in (0, 72_000)]
    field = spark.createDataFrame(rows, "day int, second int, calendar string, lat double, lon double, value double")
    got = fields.daily_mean(field, shift_hours=9).select(calendar.date_text(F.col("day"), F.col("calendar")).alias("text"), "value").collect()
    assert sorted((r.text, r.value) for r in got) == [("1970-02-29", 58.0), ("1970-02-30", 58.5), ("1970-03-01", 59.0)]
