"""Chunked array stores: written by Spark or by hand, and read chunk by chunk."""

import datetime as dt
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions.calendar import date_text
from trendloom.sources import stores
from trendloom.sources.zarr import Store, ZarrReader, read_zarr, write_zarr

DAY = dt.datetime(1979, 1, 1)


def by_hand(path, ascending=False, hours=240, chunk=(100, 30, 40), compressor=None, missing=(), dtype="<f4", **attributes):
    """An hourly store on a grid of 61 x 81 in which each value says where it stands."""
    lats, lons = np.linspace(-60, 0, 61), np.linspace(90, 190, 81)
    lats = lats if ascending else lats[::-1]
    values = (np.arange(hours)[:, None, None] * 1.0 + (lats[:, None] + lons) / 1000).astype(dtype)
    meta = lambda shape, chunks, kind, packer: {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "compressor": packer, "fill_value": None, "order": "C", "filters": None}
    arrays = {"mean_sea_level_pressure": (values, chunk, ["time", "latitude", "longitude"], attributes, compressor),
              "time": (np.arange(hours, dtype="<i8"), (64,), ["time"], {"units": "hours since 1979-01-01 00:00:00", "calendar": "proleptic_gregorian"}, None),
              "latitude": (lats.astype("<f8"), (61,), ["latitude"], {}, None), "longitude": (lons.astype("<f8"), (81,), ["longitude"], {}, None)}
    for name, (data, chunks, dims, extra, packer) in arrays.items():
        folder = path / name
        folder.mkdir(parents=True)
        (folder / ".zarray").write_text(json.dumps(meta(list(data.shape), list(chunks), data.dtype.str, packer)))
        (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | extra))
        for at in np.ndindex(*(-(-n // c) for n, c in zip(data.shape, chunks))):
            block = np.zeros(chunks, data.dtype)
            part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = block.tobytes()
            if (name, at) not in missing:
                (folder / ".".join(map(str, at))).write_bytes(zlib.compress(raw) if packer else raw)
    return values, lats, lons


@pytest.mark.parametrize("ascending,compressor", [(True, None), (False, {"id": "zlib", "level": 1})])
def test_a_box_and_a_period_are_read_whatever_the_order_of_latitudes(spark, tmp_path, ascending, compressor):
    values, lats, lons = by_hand(tmp_path / "s", ascending, compressor=compressor)
    rows = read_zarr(spark, str(tmp_path / "s"), "mean_sea_level_pressure", south=-20, north=-10, west=100, east=110, start="1979-01-02", stop="1979-01-02")
    got = {(r.time, r.lat, r.lon): r.value for r in rows.collect()}
    want = {(DAY + dt.timedelta(hours=h), a, o): values[h, i, j] for h in range(24, 48) for i, a in enumerate(lats) for j, o in enumerate(lons) if -20 <= a <= -10 and 100 <= o <= 110}
    assert len(want) == 24 * 11 * 9 and got == pytest.approx({k: float(v) for k, v in want.items()})
    sliced = stores.slice_year(rows, 1979, (-20, -10, 100, 110), [0, 6, 12, 18])
    assert {r.time.hour for r in sliced.collect()} == {0, 6, 12, 18} and sliced.count() * 6 == len(want)
    assert stores.slice_year(rows, 1999, (-20, -10, 100, 110), [0]).count() == 0


def test_only_chunks_that_are_wanted_are_read(spark, tmp_path):
    by_hand(tmp_path / "s")
    whole = read_zarr(spark, str(tmp_path / "s"), "mean_sea_level_pressure")
    assert whole.rdd.getNumPartitions() == 3 * 3 * 3 and whole.count() == 240 * 61 * 81
    part = read_zarr(spark, str(tmp_path / "s"), "mean_sea_level_pressure", south=-59, north=-58, west=90, east=91, start="1979-01-01", stop="1979-01-04")
    assert part.rdd.getNumPartitions() == 1
    assert read_zarr(spark, str(tmp_path / "s"), "mean_sea_level_pressure", start="2050-01-01").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read_again = read_zarr(spark, str(tmp_path / "s"), "mean_sea_level_pressure").filter("lat >= -1.5 and lon < 92 and time < timestamp '1979-01-02'")
        assert read_again.rdd.getNumPartitions() == 1 and read_again.count() == 24 * 2 * 2
        assert whole.filter("lat >= -1.5 and lon < 92 and time < timestamp '1979-01-02'").count() == 24 * 2 * 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_missing_chunks_scales_and_marks_of_missing_values(spark, tmp_path):
    name = "mean_sea_level_pressure"
    values, lats, lons = by_hand(tmp_path / "s", chunk=(120, 61, 81), missing={(name, (1, 0, 0))}, dtype="<i2", _FillValue=7, scale_factor=0.5, add_offset=100.0)
    got = {(r.time, r.lat, r.lon): r.value for r in read_zarr(spark, str(tmp_path / "s"), name, north=-60).collect()}
    at = lambda h: got[DAY + dt.timedelta(hours=h), -60.0, 90.0]
    assert at(3) == 100 + 3 * 0.5 and at(7) is None and at(130) is None


def test_a_store_says_what_it_cannot_give(spark, tmp_path):
    by_hand(tmp_path / "s")
    with pytest.raises(KeyError, match="no array wind"):
        Store(str(tmp_path / "s"), "wind")
    with pytest.raises(ValueError, match="name one variable"):
        Store(str(tmp_path / "s"), None)
    at = tmp_path / "s" / "mean_sea_level_pressure" / ".zarray"
    made = json.loads(at.read_text())
    at.write_text(json.dumps(made | {"zarr_format": 3}))
    with pytest.raises(ValueError, match="format 2"):
        Store(str(tmp_path / "s"), "mean_sea_level_pressure")
    at.write_text(json.dumps(made | {"compressor": {"id": "blosc"}}))
    store = Store(str(tmp_path / "s"), "mean_sea_level_pressure")
    reader = ZarrReader(store, {})
    with pytest.raises(ValueError, match="no decompressor for blosc"):
        list(reader.read(reader.partitions()[0]))


@pytest.mark.parametrize("time_chunk", [1, 7, 200])
def test_round_trip_by_spark(spark, tmp_path, time_chunk):
    rows = [(DAY + dt.timedelta(hours=6 * i), -30.0 - a, 140.0 + 2.5 * o, None if (i + a + o) % 11 == 0 else float(np.float32(i + a / 8 + o / 64))) for i in range(30) for a in range(3) for o in range(4)]
    field = spark.createDataFrame(rows, "time timestamp, lat double, lon double, value double").repartition(5)
    path = str(tmp_path / "out")
    assert write_zarr(field, path, "mslp", time_chunk)
    back = read_zarr(spark, path)
    assert back.rdd.getNumPartitions() == -(-30 // min(time_chunk, 30))
    assert sorted(map(repr, ((r.time, r.lat, r.lon, r.value) for r in back.collect()))) == sorted(map(repr, rows))
    before = (tmp_path / "out" / ".zmetadata").stat().st_mtime_ns
    assert not write_zarr(field.limit(3), path, "mslp") and (tmp_path / "out" / ".zmetadata").stat().st_mtime_ns == before
    assert write_zarr(field.filter("lat = -30"), path, "mslp", replace=True) and read_zarr(spark, path).count() == 120
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_round_trip_of_a_model_calendar(spark, tmp_path):
    rows = [(d, s, "360_day", -30.0, 140.0 + o, float(d)) for d in (57, 58, 59, 60) for s in (0, 43_200) for o in range(2)]
    field = spark.createDataFrame(rows, "day int, second int, calendar string, lat double, lon double, value double")
    write_zarr(field, str(tmp_path / "m"), "psl", 3)
    back = read_zarr(spark, str(tmp_path / "m"), "psl")
    assert sorted(map(tuple, back.select(*field.columns).collect())) == sorted(rows)
    assert {r[0] for r in back.select(date_text(F.col("day"), F.col("calendar"))).collect()} == {"1970-02-28", "1970-02-29", "1970-02-30", "1970-03-01"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert read_zarr(spark, str(tmp_path / "m"), "psl").filter("day = 60").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
