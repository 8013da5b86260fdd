"""Yearly stores of gridded fields as partitioned Parquet, index text files, label files and model catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.calendar import decoded_time, known_calendar
from trendloom.functions.checks import unless
from trendloom.functions.statistics import clean
from trendloom.operators.fields import at_hours, geopotential_height, in_box
from trendloom.session import mark, move, names_in, remove

FIELD = "time timestamp, lat double, lon double, value double"


#: Beside the years of a store: a file for each that is complete, and what a run has written and not yet shown.
LEDGER, STAGING = "_complete", "_staging"


def complete_years(spark: SparkSession, path: str) -> list[int]:
    """The years that a store has in whole, by its ledger."""
    return [int(name) for name in names_in(spark, f"{path}/{LEDGER}") if name.isdigit()]


def write_years(field: DataFrame, path: str, time: str = "time", replace: bool = False, years_at_once: int = 8) -> list[int]:
    """Writes a field by year and returns the years written. A year that is complete already is left as it is, unless `replace`.

    Years go in groups of years_at_once, one job each, into a folder that readers don't see; then each year's folder is renamed
    into its place and noted in the ledger. So a run that is killed leaves whole years, or none of a year, and the next run goes
    on with those that the ledger lacks: what stands in the place of one is replaced. One run at a time may write to a store.
    """
    spark = field.sparkSession
    rows = field.withColumn("year", F.year(time))
    remove(spark, f"{path}/{STAGING}")  # of a run that was killed
    done = [] if replace else complete_years(spark, path)
    ledger = spark.createDataFrame([(y,) for y in done], "year int")
    rows = rows.join(F.broadcast(ledger), "year", "left_anti")  # a row a year
    todo = sorted(r[0] for r in rows.select("year").distinct().collect() if r[0] is not None)
    for at in range(0, len(todo), years_at_once):
        group = todo[at : at + years_at_once]
        own = rows.filter(F.col("year").isin(group))
        own.repartition("year", F.pmod(F.xxhash64("lat", "lon"), F.lit(16))).write.partitionBy("year").parquet(f"{path}/{STAGING}")
        for year in group:
            remove(spark, f"{path}/{LEDGER}/{year}")
            remove(spark, f"{path}/year={year}")
            move(spark, f"{path}/{STAGING}/year={year}", f"{path}/year={year}")
            mark(spark, f"{path}/{LEDGER}/{year}")
        remove(spark, f"{path}/{STAGING}")
    return todo


def read_years(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The field of all years from start to end. An error names each missing year, or the years whose grid differs."""
    rows = spark.read.parquet(path).filter(F.col("year").between(start, end))
    if "value" not in rows.columns:
        raise KeyError(f"{path} has no column value")
    grids = rows.select("year", "lat", "lon").distinct().groupBy("year").agg(
        F.sum(F.xxhash64(F.col("lat").cast("double"), F.col("lon").cast("double")).cast("decimal(38,0)")).alias("grid"))
    found = {r.year: r.grid for r in grids.collect()}  # a row a year
    if missing := [y for y in range(start, end + 1) if y not in found]:
        raise FileNotFoundError(f"missing years: {', '.join(map(str, missing))}")
    if odd := [y for y, g in sorted(found.items()) if g != found[start]]:
        raise ValueError(f"the grid differs from that of {start} in: {', '.join(map(str, odd))}")
    return harmonised(rows)


def harmonised(rows: DataFrame) -> DataFrame:
    """Only (time, [level,] lat, lon, value), coordinates as double, NaN as null; `latitude`, `longitude`, `valid_time` and
    `pressure_level` are taken for lat, lon, time and level. Any other column is left out."""
    for old, new in (("latitude", "lat"), ("longitude", "lon"), ("valid_time", "time"), ("pressure_level", "level")):
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return rows.select("time", *[c for c in ("level",) if c in rows.columns], F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), clean(F.col("value")).alias("value"))


def normalise_download(rows: DataFrame, variable: str = "z", to_height: bool = True) -> DataFrame:
    """A field from (valid_time, [pressure_level, expver,] latitude, longitude, variable): versions of one value collapse to the
    greatest that is not missing. Values of several levels stay apart; a level that every row has is no column of the result."""
    if variable not in rows.columns:
        raise KeyError(f"no variable {variable}")
    rows = harmonised(rows.withColumnRenamed(variable, "value"))
    if "level" in rows.columns and rows.agg(F.count_distinct("level")).first()[0] <= 1:
        rows = rows.drop("level")
    rows = rows.groupBy(*[c for c in rows.columns if c != "value"]).agg(F.max("value").alias("value"))
    return rows.withColumn("value", geopotential_height(F.col("value"))) if to_height else rows


def slice_year(field: DataFrame, year: int, box: tuple[float, float, float, float], hours: Sequence[int], level: int | None = None, to_height: bool = False) -> DataFrame:
    """One year of a store, in a box (south, north, west, east) and at some hours; empty outside of what the store covers."""
    rows = field.filter((F.col("time") >= F.make_timestamp_ltz(F.lit(year), *map(F.lit, (1, 1, 0, 0, 0)))) & (F.col("time") < F.make_timestamp_ltz(F.lit(year + 1), *map(F.lit, (1, 1, 0, 0, 0)))))
    if "year" in field.columns:  # the folders of a store
        rows = rows.filter(F.col("year") == year)
    if level is not None:
        rows = rows.filter(F.col("level") == level)
    rows = at_hours(in_box(rows, *box), hours)
    return rows.withColumn("value", geopotential_height(F.col("value"))) if to_height else rows


def describe(field: DataFrame) -> DataFrame:
    """(start, stop, moments, cells, rows, gigabytes): what a store covers, at four bytes a value."""
    return field.agg(F.min("time").alias("start"), F.max("time").alias("stop"), F.count_distinct("time").alias("moments"), F.count_distinct("lat", "lon").alias("cells"),
                     F.count("*").alias("rows"), (F.count("*") * 4 / 1e9).alias("gigabytes"))


def find_variables(names: DataFrame, patterns: Sequence[str], name: str = "name") -> DataFrame:
    """Distinct names that contain any of the patterns, whatever the case, sorted."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.lower(name), F.lit(p.lower()))
    return names.filter(hit).select(name).distinct().orderBy(name)


def request(variable: str, year: int, hours: Sequence[int], box: tuple[float, float, float, float], level: int | None = None) -> dict:
    """What to ask of a server that selects before it sends: the area as north, west, south, east, longitudes up to 180."""
    south, north, west, east = box
    wrap = lambda x: x - 360 if x > 180 else x
    out = {"variable": variable, "year": str(year), "month": [f"{m:02d}" for m in range(1, 13)], "day": [f"{d:02d}" for d in range(1, 32)],
           "time": [f"{h:02d}:00" for h in hours], "area": [north, wrap(west), south, wrap(east)]}
    return out | ({"pressure_level": str(level)} if level is not None else {})


def read_monthly_index(spark: SparkSession, path: str, missing_below: float = -90.0) -> DataFrame:
    """(day, value) from a text of a first line with the first and last year, then lines of a year and twelve values, up to the
    first line that is not one or whose year lies outside (without two years in the first line any year will do).

    Values under missing_below are left out. A file without a line of values is an error when it is read. The file has a line a
    year, so it is numbered as a whole.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    parts = lines.select("at", F.split(F.trim("line"), r"\s+").alias("p"))
    span = parts.filter("at = 0").select(F.coalesce(F.col("p")[0].try_cast("int"), F.lit(1)).alias("first"), F.coalesce(F.try_element_at("p", F.lit(2)).try_cast("int"), F.lit(9999)).alias("last"))
    parts = parts.filter("at > 0").join(F.broadcast(span), how="cross")  # one row
    good = (F.size("p") == 13) & F.col("p")[0].try_cast("int").between(F.col("first"), F.col("last")) & F.forall("p", lambda x: x.try_cast("double").isNotNull())
    first_bad = parts.filter(~F.coalesce(good, F.lit(False))).agg(F.coalesce(F.min("at"), F.lit(1 << 30)).alias("stop"))
    kept = parts.join(F.broadcast(first_bad), how="cross").filter(F.col("at") < F.col("stop"))  # one row
    kept = unless(kept, kept.agg(F.count("*").alias("n")), F.col("n") == 0, f"no data rows in {path}")
    months = kept.select(F.col("p")[0].cast("int").alias("year"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    return months.select(F.make_date("year", F.col("m") + 1, F.lit(1)).alias("day"), F.col("v").cast("double").alias("value")).filter(F.col("value") >= missing_below)


def search_catalogue(catalogue: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted value, or one of the wanted values."""
    for name, value in wanted.items():
        catalogue = catalogue.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return catalogue


def having_all(catalogue: DataFrame, member: str, of: str, wanted: Sequence[str]) -> DataFrame:
    """Members that occur with every wanted value: a relational division by counting."""
    rows = catalogue.filter(F.col(of).isin(*wanted))
    return rows.groupBy(member).agg(F.count_distinct(of).alias("n")).filter(F.col("n") == len(set(wanted))).select(member).orderBy(member)


def exactly_one(catalogue: DataFrame, **wanted):
    """The one row that is wanted; an error if there is none or more."""
    rows = search_catalogue(catalogue, **wanted).limit(2).collect()
    if not rows:
        raise KeyError(f"nothing for {wanted}")
    if len(rows) > 1:
        raise ValueError(f"more than one for {wanted}")
    return rows[0]


def decoded_steps(rows: DataFrame, units: str, calendar: str | None = None) -> DataFrame:
    """rows with (day, second, calendar) in place of their numeric `time`, which counts in `units` (`days since 1850-01-01`) in the
    calendar named, or in that of a column `calendar`. A row whose time is missing has no day and is left out."""
    name = known_calendar(F.col("calendar") if calendar is None else F.lit(calendar))
    moment = decoded_time(F.col("time").cast("double"), units, F.col("calendar"))
    rows = rows.filter("time is not null").withColumn("calendar", name).withColumn("_at", moment)
    rest = [c for c in rows.columns if c not in ("time", "calendar", "_at", "day", "second")]
    return rows.select(F.col("_at.day").alias("day"), F.col("_at.second").alias("second"), "calendar", *rest)


def load_model(catalogue: DataFrame, source_id: str, experiment_id: str, variable: str = "value", **wanted) -> DataFrame:
    """The steps of one model and experiment: (day, second, calendar, lat, lon, value), or (time, lat, lon, value) if its times are moments.

    catalogue: a row a store with source_id, experiment_id and path, and for times that are numbers units and calendar (null: the
    standard one); `wanted` names further columns. No row, or more than one, is an error. Of several members, then of several
    starting years of a forecast, the first in order is taken. Coordinates may be called latitude and longitude.
    """
    try:
        row = exactly_one(catalogue, source_id=source_id, experiment_id=experiment_id, **wanted).asDict()
    except KeyError:
        models = catalogue.select("source_id").distinct().count()
        raise KeyError(f"{source_id} has no {experiment_id}; the catalogue has {models} models") from None
    rows = catalogue.sparkSession.read.parquet(row["path"])
    if variable not in rows.columns:
        raise KeyError(f"{row['path']} has no column {variable}")
    for axis in ("member_id", "dcpp_init_year"):
        if axis in rows.columns:
            rows = rows.join(F.broadcast(rows.agg(F.min(axis).alias(axis))), axis).drop(axis)  # one row
    for old, new in (("latitude", "lat"), ("longitude", "lon")):
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    rows = rows.select("time", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), clean(F.col(variable)).alias("value"))
    return rows if dict(rows.dtypes)["time"].startswith("timestamp") else decoded_steps(rows, row["units"], row.get("calendar") or "standard")


def calendar_of(steps: DataFrame) -> str:
    """The calendar of a model's steps; `standard` for moments."""
    return steps.select("calendar").first()[0] if "calendar" in steps.columns else "standard"


def read_labels(spark: SparkSession, path: str, column: str = "label") -> DataFrame:
    """(ts, label) of a published label series."""
    rows = spark.read.parquet(path)
    if column not in rows.columns:
        raise KeyError(f"{path} has no column {column}")
    return rows.select("ts", F.col(column).alias("label"))


def type_order(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) from the stored order of the types."""
    return spark.read.parquet(path).select(F.posexplode("names").alias("code", "name"))


def tagged(work: str, name: str, tag: str = "") -> str:
    """The folder of a made store, of a variant where a tag is given."""
    return f"{work.rstrip('/')}/{name}{tag and '-' + tag}"


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A store of several tables; each replaces the one of its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


#: The tables of each made store.
EOF, TYPES, MODEL = ("spectrum", "pcs", "patterns", "cells", "scales"), ("labels", "centroids"), ("labels", "frequencies", "unexplained")
COMPOSITES = ("maps", "seasonal_counts", "transitions", "runs")


def write_anomalies(field: DataFrame, work: str, variable: str) -> None:
    """The daily anomalies (day, lat, lon, value) of a variable, by year; replaces what was there."""
    write_years(field, f"{tagged(work, 'anomalies')}/{variable}", "day", replace=True)


def read_anomalies(spark: SparkSession, work: str, variable: str) -> DataFrame:
    return spark.read.parquet(f"{tagged(work, 'anomalies')}/{variable}").select("day", "lat", "lon", "value")


def write_eof(work: str, tag: str = "", **tables: DataFrame) -> None:
    write_tables({n: tables[n] for n in EOF}, tagged(work, "eof", tag))


def write_types(work: str, tag: str = "", **tables: DataFrame) -> None:
    write_tables({n: tables[n] for n in TYPES}, tagged(work, "types", tag))


def write_composites(work: str, tag: str = "", **tables: DataFrame) -> None:
    write_tables({n: tables[n] for n in COMPOSITES}, tagged(work, "composites", tag))


def write_model(work: str, source: str, tag: str = "", **tables: DataFrame) -> None:
    write_tables({n: tables[n] for n in MODEL}, f"{tagged(work, 'models', tag)}/{source}")
