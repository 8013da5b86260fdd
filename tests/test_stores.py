"""Readers and writers on tiny files, and the settings of a study."""

import datetime as dt
import textwrap

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trendloom import config
from trendloom.functions.calendar import date_text
from trendloom.sources import stores


@pytest.fixture()
def field(spark):
    rows = [(dt.datetime(y, m, 1, h), float(a), float(o), float(y * 100 + m)) for y in (1979, 1980, 1981) for m in (1, 7) for h in (0, 3) for a in (-30, -35) for o in (140, 145)]
    return spark.createDataFrame(rows, "time timestamp, lat double, lon double, value double")


def test_years_are_written_read_and_missing_ones_named(spark, field, tmp_path):
    path = str(tmp_path / "mslp")
    stores.write_years(field.filter("year(time) != 1980"), path)
    with pytest.raises(FileNotFoundError, match="1980, 1982"):
        stores.read_years(spark, path, 1979, 1982)
    stores.write_years(field.filter("year(time) = 1980"), path)  # adds a year, leaves the others
    assert stores.read_years(spark, path, 1979, 1981).count() == field.count()
    stores.write_years(field.filter("year(time) = 1980 AND lat < -30"), path, replace=True)
    with pytest.raises(ValueError, match="grid differs .* 1980"):
        stores.read_years(spark, path, 1979, 1981)
    spark.range(1).selectExpr("1979 AS year", "0.0 AS other").write.partitionBy("year").parquet(str(tmp_path / "odd"))
    with pytest.raises(KeyError, match="value"):
        stores.read_years(spark, str(tmp_path / "odd"), 1979, 1979)


def test_a_year_is_sliced_from_its_own_folder_and_outside_there_is_nothing(spark, field, tmp_path):
    path = str(tmp_path / "store")
    stores.write_years(field.withColumn("level", F.lit(500)), path)
    store = spark.read.parquet(path)
    got = stores.slice_year(store, 1980, (-32, -28, 138, 142), [0], level=500, to_height=True)
    assert got.count() == 2 and {round(r.value * 9.80665) for r in got.collect()} == {198001, 198007}
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()
    assert stores.slice_year(store, 2050, (-90, 90, 0, 360), [0]).count() == 0
    assert stores.slice_year(field, 1980, (-90, 90, 0, 360), [0, 3]).count() == 16  # a field without folders


def test_downloads_keep_levels_apart_and_join_versions(spark):
    rows = [(dt.datetime(2000, 1, 1), 500, v, -30.0, 140.0, z) for v, z in ((1, 5500 * 9.80665), (5, None))] + [(dt.datetime(2000, 1, 1), 850, 1, -30.0, 140.0, 1500 * 9.80665)]
    both = spark.createDataFrame(rows, "valid_time timestamp, pressure_level int, expver int, latitude double, longitude double, z double")
    got = {r.level: r.value for r in stores.normalise_download(both).collect()}
    assert got == {500: pytest.approx(5500), 850: pytest.approx(1500)}
    one = stores.normalise_download(both.filter("pressure_level = 500"), to_height=False)
    assert one.columns == ["time", "lat", "lon", "value"] and one.first().value == pytest.approx(5500 * 9.80665)
    with pytest.raises(KeyError, match="no variable t"):
        stores.normalise_download(both, "t")


def test_request_has_the_area_north_first_and_longitudes_up_to_180():
    made = stores.request("geopotential", 1999, [0, 6], (-60, -10, 90, 200), 500)
    assert made["area"] == [-10, 90, -60, -160] and made["year"] == "1999" and made["time"] == ["00:00", "06:00"] and made["pressure_level"] == "500"
    assert len(made["month"]) == 12 and len(made["day"]) == 31 and "pressure_level" not in stores.request("msl", 1999, [0], (0, 1, 0, 1))


def test_monthly_index_stops_at_the_first_odd_line(spark, tmp_path):
    path = tmp_path / "index.txt"
    line = lambda year, v: f"{year} " + " ".join(f"{v + m / 100:.2f}" for m in range(12))
    path.write_text("\n".join([" 1950 1953", line(1950, 26), line(1951, 27).replace("27.00", "-99.99").replace("27.05", "-99.99"), " -99.99", line(1953, 28)]))
    got = {r.day: r.value for r in stores.read_monthly_index(spark, str(path)).collect()}
    assert len(got) == 22 and got[dt.date(1950, 12, 1)] == pytest.approx(26.11) and dt.date(1951, 1, 1) not in got and dt.date(1953, 1, 1) not in got
    path.write_text("no data here\nnor here")
    with pytest.raises(PySparkException, match="no data rows"):
        stores.read_monthly_index(spark, str(path)).collect()


def test_catalogues_and_balanced_ensembles(spark):
    rows = spark.createDataFrame([("m1", "hist", "psl"), ("m1", "ssp", "psl"), ("m2", "hist", "psl"), ("m2", "hist", "psl"), ("m3", "ssp", "tas")], "source string, experiment string, variable string")
    found = stores.search_catalogue(rows, variable="psl", experiment=["hist", "ssp"])
    assert found.count() == 4 and [r[0] for r in stores.having_all(found, "source", "experiment", ["hist", "ssp"]).collect()] == ["m1"]
    assert stores.exactly_one(rows, source="m1", experiment="ssp").variable == "psl"
    with pytest.raises(KeyError):
        stores.exactly_one(rows, source="m9")
    with pytest.raises(ValueError, match="more than one"):
        stores.exactly_one(rows, source="m2")


def test_label_files_and_their_order(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2000, 1, 1, 12), "b-1")], "ts timestamp, SWT string").write.parquet(str(tmp_path / "labels"))
    assert stores.read_labels(spark, str(tmp_path / "labels"), "SWT").first().label == "b-1"
    with pytest.raises(KeyError, match="no column label"):
        stores.read_labels(spark, str(tmp_path / "labels"))
    spark.createDataFrame([(["b", "a"],)], "names array<string>").write.parquet(str(tmp_path / "order"))
    assert [(r.code, r.name) for r in stores.type_order(spark, str(tmp_path / "order")).collect()] == [(0, "b"), (1, "a")]


def test_results_are_stored_by_name_and_variant(spark, field, tmp_path):
    work, table = str(tmp_path), spark.range(3).toDF("cell")
    stores.write_eof(work, "detrended", **{n: table for n in stores.EOF})
    assert sorted(p.name for p in (tmp_path / "eof-detrended").iterdir()) == sorted(stores.EOF)
    assert stores.read_tables(spark, stores.tagged(work, "eof", "detrended"), ["cells"])["cells"].count() == 3
    stores.write_types(work, labels=table, centroids=table)
    stores.write_types(work, labels=table.limit(1), centroids=table)  # replaces
    assert stores.read_tables(spark, stores.tagged(work, "types"), ["labels"])["labels"].count() == 1
    stores.write_composites(work, **{n: table for n in stores.COMPOSITES})
    stores.write_model(work, "m1", "future", **{n: table for n in stores.MODEL})
    assert (tmp_path / "models-future" / "m1" / "frequencies").is_dir() and (tmp_path / "composites" / "runs").is_dir()
    with pytest.raises(KeyError):
        stores.write_model(work, "m1", labels=table)
    daily = field.select(F.to_date("time").alias("day"), "lat", "lon", "value").distinct()
    stores.write_anomalies(daily, work, "mslp")
    assert stores.read_anomalies(spark, work, "mslp").count() == daily.count()


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "domain.yaml").write_text(textwrap.dedent("""
        typing: {lat_north: -10.0, lat_south: -60.0, lon_west: 90.0, lon_east: 180.0}
        target: {lat_north: -33.0, lat_south: -40.0, lon_west: 140.0, lon_east: 150.0}
        period: {start: "1979-01-01", end: "2025-12-31"}
        sampling: {hours: [0, 6, 12, 18]}"""))
    (tmp_path / "sources.yaml").write_text("a: {store: 'gs://x', variables: {z: geopotential}, levels: {z: 500}}\nb: {base_url: 'https://y', variables: [rain]}")
    monkeypatch.setenv("STUDY", str(tmp_path))
    domain = config.load_domain("$STUDY/domain.yaml")
    assert domain.typing == config.Box(-60, -10, 90, 180) and domain.hours == (0, 6, 12, 18) and domain.end == "2025-12-31"
    sources = config.load_sources("$STUDY/sources.yaml")
    assert sources["a"].variables == {"z": "geopotential"} and sources["a"].options == {"levels": {"z": 500}} and sources["b"].variables == {"rain": "rain"}
    with pytest.raises(KeyError, match="no address"):
        config.sources_of({"c": {}})
    with pytest.raises(ValueError, match="south below"):
        config.Box(1, 0, 0, 1)
    folders = config.Folders("$STUDY/raw", "$STUDY/work")
    with pytest.raises(FileNotFoundError, match="mounted"):
        folders.check()
    (tmp_path / "raw").mkdir()
    folders.check()
    folders.make()
    assert sorted(p.name for p in (tmp_path / "work").iterdir()) == ["anomalies", "composites", "eof", "models", "types"]


def test_bands_meet_without_overlap():
    tropics, subtropics, midlatitudes, southeast = (b.box for b in config.BANDS)
    assert tropics.south == subtropics.north and subtropics.south == midlatitudes.north and (southeast.west, southeast.east) == (140, 150)
    assert [b.season for b in config.BANDS] == ["warm", "all", "cool", "cool"]


def test_a_killed_run_goes_on_and_a_complete_year_is_left_as_it_is(spark, field, tmp_path, monkeypatch):
    path = str(tmp_path / "mslp")
    moved, real = [], stores.move

    def dies_at_the_second_year(session, a, b):
        if len(moved) == 1:
            raise KeyboardInterrupt
        moved.append(b)
        real(session, a, b)

    monkeypatch.setattr(stores, "move", dies_at_the_second_year)
    with pytest.raises(KeyboardInterrupt):
        stores.write_years(field, path)
    monkeypatch.setattr(stores, "move", real)
    assert stores.complete_years(spark, path) == [1979]
    assert sorted(r.year for r in spark.read.parquet(path).select("year").distinct().collect()) == [1979]  # what is not shown yet isn't read
    half = tmp_path / "mslp" / "year=1980"  # a folder that no ledger knows is no year
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"torn")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "mslp" / "year=1979").iterdir()}
    changed = field.withColumn("value", F.col("value") + F.when(F.year("time") == 1979, 1000).otherwise(0))
    assert stores.write_years(changed, path, years_at_once=1) == [1980, 1981]
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "mslp" / "year=1979").iterdir()} == before
    assert stores.complete_years(spark, path) == [1979, 1980, 1981] and not (tmp_path / "mslp" / "_staging").exists()
    assert stores.read_years(spark, path, 1979, 1981).count() == field.count() and stores.write_years(changed, path) == []
    assert stores.write_years(changed.filter("year(time) = 1979"), path, replace=True) == [1979]
    assert spark.read.parquet(path).filter("year = 1979").agg(F.min("value")).first()[0] > 100_000


def test_index_texts_end_with_the_years_of_their_first_line(spark, tmp_path):
    path = tmp_path / "index.txt"
    path.write_text("1950 1951\n" + "".join(f"{y} " + " ".join(["1.5"] * 12) + "\n" for y in (1950, 1951, 1952)))
    assert stores.read_monthly_index(spark, str(path)).count() == 24


def test_a_model_is_loaded_in_its_own_calendar(spark, tmp_path):
    rows = [(m, y, t + 0.25, a, o, 1.0 * (m == "r1") * (y == 1990)) for m in ("r1", "r2") for y in (1990, 1991) for t in (58.0, 59.0) for a in (-30.0, -35.0) for o in (140.0, 145.0)]
    spark.createDataFrame(rows, "member_id string, dcpp_init_year int, time double, latitude double, longitude double, psl double").write.parquet(str(tmp_path / "a"))
    times = [(dt.datetime(2000, 1, 1, 6), -30.0, 140.0, float("nan"))]
    spark.createDataFrame(times, "time timestamp, lat double, lon double, psl double").write.parquet(str(tmp_path / "b"))
    catalogue = spark.createDataFrame([("A", "historical", "mon", str(tmp_path / "a"), "days since 1850-01-01", "360_day"), ("B", "historical", "mon", str(tmp_path / "b"), None, None), ("B", "historical", "day", str(tmp_path / "b"), None, None)],
                                      "source_id string, experiment_id string, table_id string, path string, units string, calendar string")
    steps = stores.load_model(catalogue, "A", "historical", "psl")
    assert steps.columns == ["day", "second", "calendar", "lat", "lon", "value"] and steps.count() == 8 and stores.calendar_of(steps) == "360_day"
    assert {r.value for r in steps.collect()} == {1.0} and {r.second for r in steps.collect()} == {21_600}
    assert {r[0] for r in steps.select(date_text(F.col("day"), F.col("calendar"))).collect()} == {"1850-02-29", "1850-02-30"}
    moments = stores.load_model(catalogue, "B", "historical", "psl", table_id="day")
    assert moments.columns == ["time", "lat", "lon", "value"] and moments.first().value is None and stores.calendar_of(moments) == "standard"
    with pytest.raises(KeyError, match="2 models"):
        stores.load_model(catalogue, "A", "ssp585", "psl")
    with pytest.raises(ValueError, match="more than one"):
        stores.load_model(catalogue, "B", "historical", "psl")
    with pytest.raises(KeyError, match="no column tas"):
        stores.load_model(catalogue, "A", "historical", "tas")
    assert stores.decoded_steps(spark.createDataFrame([(None, 1.0)], "time double, value double"), "days since 1850-01-01", "noleap").count() == 0
