"""Gridded fields in long form: (time or day, lat, lon, value), one row a cell and moment.

A field on a calendar without real dates has `calendar`, the name of it, and `day`, the number of the day in it; its steps also have
`second`, the seconds since the start of the day. Both go through all operators here. NaN is a missing value everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.calendar import DEFAULT_YEAR_DAYS, date_parts, shifted_day, year_length
from trendloom.functions.checks import unless
from trendloom.functions.statistics import area_weight, clean, eof_weight, intercept, slope, weighted_mean

#: Standard gravity, metres per second squared; Earth's radius in metres a degree, and its rotation in radians a second.
GRAVITY, METRES_A_DEGREE, ROTATION = 9.80665, 111_320.0, 7.2921e-5


def in_box(field: DataFrame, south: float, north: float, west: float, east: float, margin: float = 0.0) -> DataFrame:
    """Cells inside a box, edges included, widened by `margin` degrees; longitudes count from 0 to 360 or from -180, as the box does."""
    lon = F.pmod(F.col("lon"), F.lit(360.0)) if west >= 0 else F.col("lon")
    return field.filter(F.col("lat").between(min(south, north) - margin, max(south, north) + margin) & lon.between(west - margin, east + margin))


def at_hours(field: DataFrame, hours: Sequence[int], time: str = "time") -> DataFrame:
    return field.filter(F.hour(time).isin(*hours))


def between_days(rows: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Both ends included; reading it is an error if nothing is left."""
    kept = rows.filter(F.to_date(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return unless(kept, kept.agg(F.count("*").alias("n")), F.col("n") == 0, f"no rows between {start} and {end}")


def geopotential_height(geopotential: Column) -> Column:
    return geopotential / GRAVITY


def daily_mean(field: DataFrame, keys: Sequence[str] = ("lat", "lon"), time: str = "time", shift_hours: int = 0) -> DataFrame:
    """(day, *keys, value): partial sums before one shuffle on day and cell. Days without a step have no row.

    Steps with a calendar give (day, calendar, *keys, value); a shift may end on a day that no DATE has, such as 30 February.
    """
    if "calendar" in field.columns:
        day = F.col("day") + F.floor((F.col("second") + 3600 * shift_hours) / 86_400)
        return field.groupBy(day.cast("int").alias("day"), "calendar", *keys).agg(F.avg(clean(F.col("value"))).alias("value"))
    return field.groupBy(shifted_day(F.col(time), shift_hours).alias("day"), *keys).agg(F.avg(clean(F.col("value"))).alias("value"))


def coarsen(field: DataFrame, factor: int, keys: Sequence[str] = ("day",)) -> DataFrame:
    """Means of factor x factor blocks of cells in order of the axes; a trailing partial block is left out."""
    if factor <= 1:
        return field

    def axis(name: str) -> DataFrame:  # an axis has as many rows as the grid has lines, whatever the days
        points = field.select(name).distinct()
        block = F.floor((F.row_number().over(Window.orderBy(name)) - 1) / factor)
        points = points.withColumn("block", block)
        sizes = Window.partitionBy("block")
        return points.select(name, F.avg(name).over(sizes).alias(f"new_{name}"), F.count("*").over(sizes).alias("size")).filter(F.col("size") == factor).drop("size")

    joined = field.join(F.broadcast(axis("lat")), "lat").join(F.broadcast(axis("lon")), "lon")
    return joined.groupBy(*keys, F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon")).agg(F.avg(clean(F.col("value"))).alias("value"))


def spatial_mean(field: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    return field.groupBy(*keys).agg(weighted_mean(clean(F.col("value")), area_weight(F.col("lat"))).alias("value"))


def regional_mean(field: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """The area-weighted mean over cells that have a value at every moment; the others count nowhere."""
    field = field.withColumn("value", clean(F.col("value")))
    moments = field.select(*keys).distinct().agg(F.count("*").alias("moments"))
    whole = field.groupBy("lat", "lon").agg(F.count("value").alias("n")).join(F.broadcast(moments), F.col("n") == F.col("moments")).select("lat", "lon")  # one row
    return spatial_mean(field.join(whole, ["lat", "lon"], "left_semi"), keys)


def standardise_cells(field: DataFrame) -> DataFrame:
    """Each cell by its own standard deviation; a constant cell becomes null. The deviations are summed before the shuffle."""
    field = field.withColumn("value", clean(F.col("value")))
    scales = field.groupBy("lat", "lon").agg(F.stddev_pop("value").alias("_scale"))
    return field.join(scales, ["lat", "lon"]).withColumn("value", F.try_divide("value", "_scale")).select(*field.columns)


def variable_scales(field: DataFrame) -> DataFrame:
    """(variable, scale): one standard deviation over all moments and cells of a variable."""
    scales = field.groupBy("variable").agg(F.stddev_pop(clean(F.col("value"))).alias("scale"))
    fails = F.raise_error(F.concat(F.lit("a variable without variance cannot be standardised: "), F.coalesce("variable", F.lit("null")))).cast("double")
    return scales.select("variable", F.when(F.col("scale") > 0, F.col("scale")).otherwise(fails).alias("scale"))


def harmonic_terms(day_of_year: Column, harmonics: int, year_days: Column | float = DEFAULT_YEAR_DAYS) -> list[Column]:
    """A constant, then a cosine and a sine of each harmonic of the year."""
    angle = 2 * math.pi * day_of_year / year_days
    return [F.lit(1.0), *[f(k * angle) for k in range(1, harmonics + 1) for f in (F.cos, F.sin)]]


def _fit(field: DataFrame, terms: list[Column], keys: Sequence[str]) -> DataFrame:
    """(*keys, beta): normal equations from one aggregation, solved where the sums of a cell are; gaps count per cell."""
    n = len(terms)
    named = field.withColumn("value", clean(F.col("value"))).filter(F.col("value").isNotNull()).select(*keys, "value", *[t.alias(f"_x{i}") for i, t in enumerate(terms)])
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(n) for j in range(i, n)] + [F.sum(F.col(f"_x{i}") * F.col("value")) for i in range(n)]
    moments = named.groupBy(*keys).agg(F.array(*sums).alias("sums"))

    @F.pandas_udf("array<double>")
    def solve(rows):
        import pandas as pd

        flat = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, n * (n + 1) // 2 + n))
        left, (a, b) = np.zeros((len(flat), n, n)), np.triu_indices(n)
        left[:, a, b] = left[:, b, a] = flat[:, : len(a)]
        beta = (np.linalg.pinv(left, hermitian=True) @ flat[:, len(a) :, None])[..., 0] if len(flat) else flat
        return pd.Series(list(beta))

    return moments.select(*keys, solve("sums").alias("beta"))


def _fitted(terms: list[Column]) -> Column:
    return sum((F.col("beta")[i] * t for i, t in enumerate(terms)), F.lit(0.0))


def day_of_year(field: DataFrame) -> Column:
    """From a column `doy`, a calendar's day, or a date."""
    if "doy" in field.columns:
        return F.col("doy")
    return date_parts(F.col("day"), F.col("calendar"))["doy"] if "calendar" in field.columns else F.dayofyear("day")


def climatology(field: DataFrame, harmonics: int = 3, keys: Sequence[str] = ("lat", "lon"), year_days: Column | float | None = None) -> DataFrame:
    """The field with its fitted annual cycle in `climatology`. With a column `calendar` the
    length of the year follows from it; the day of the year is `doy` where there is such a column, else that of `day`."""
    if year_days is None:
        year_days = year_length(F.col("calendar")) if "calendar" in field.columns else DEFAULT_YEAR_DAYS
    terms = harmonic_terms(day_of_year(field), harmonics, year_days)
    field = field.withColumn("value", clean(F.col("value")))
    return field.join(_fit(field, terms, keys), list(keys), "left").withColumn("climatology", _fitted(terms)).drop("beta")


def anomaly(field: DataFrame, harmonics: int = 3, keys: Sequence[str] = ("lat", "lon"), year_days: Column | float | None = None) -> DataFrame:
    """The value less its cell's annual cycle."""
    return climatology(field, harmonics, keys, year_days).withColumn("value", F.col("value") - F.col("climatology")).drop("climatology")


def detrend(field: DataFrame, keys: Sequence[str] = ("lat", "lon"), degree: int = 1) -> DataFrame:
    """The value less its cell's polynomial in time; time counts in years, of the field's calendar where it has one."""
    x = F.col("day") / year_length(F.col("calendar")) if "calendar" in field.columns else F.unix_date("day") / DEFAULT_YEAR_DAYS
    field = field.withColumn("value", clean(F.col("value")))
    if degree == 1:
        lines = field.groupBy(*keys).agg(slope(F.col("value"), x, 2).alias("_b"), intercept(F.col("value"), x, 2).alias("_a"))
        return field.join(lines, list(keys), "left").withColumn("value", F.col("value") - (F.col("_a") + F.col("_b") * x)).drop("_a", "_b")
    low, high = field.agg(F.min(x), F.max(x)).first()
    centred = (x - F.lit((low + high) / 2)) / F.lit(max(high - low, 1e-9))
    terms = [F.pow(centred, F.lit(d)) for d in range(degree + 1)]
    return field.join(_fit(field, terms, keys), list(keys), "left").withColumn("value", F.col("value") - _fitted(terms)).drop("beta")


def gradient_wind(field: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(*keys, lat, lon, wind): the geostrophic north wind of a height field times gravity, by centred differences along each line of
    latitude. A cell without a value has no wind and is no neighbour: the next cell with a value is taken, at its own distance."""
    field = field.withColumn("value", clean(F.col("value")))
    line = Window.partitionBy(*keys, "lat").orderBy("lon")
    rise = F.coalesce(F.lead("value").over(line), F.col("value")) - F.coalesce(F.lag("value").over(line), F.col("value"))
    run = F.coalesce(F.lead("lon").over(line), F.col("lon")) - F.coalesce(F.lag("lon").over(line), F.col("lon"))
    across = METRES_A_DEGREE * F.cos(F.radians("lat"))
    turning = 2 * ROTATION * F.sin(F.radians("lat"))
    known = field.filter("value is not null").select(*keys, "lat", "lon", F.try_divide(F.try_divide(rise, run), across * turning).alias("wind"))
    return known.unionByName(field.filter("value is null").select(*keys, "lat", "lon", F.lit(None).cast("double").alias("wind")))


def _spans(sources: DataFrame, name: str, ring: bool) -> DataFrame:
    """(lo, hi, from_, to_): each source coordinate with the next one, and where they lie; hi is null behind the last.

    On a ring of 360 degrees coordinates lie at their rest by 360, so conventions may differ, and of two at one place the lesser
    counts. The widest gap there is the outside, unless it is no wider than one and a half of the others' mean: then the ring is closed.
    """
    place = F.pmod(F.col(name), F.lit(360.0)) if ring else F.col(name)
    points = sources.groupBy(place.cast("double").alias("from_")).agg(F.min(name).alias("lo"))
    order, whole = Window.orderBy("from_"), Window.partitionBy()  # an axis, not a field
    spans = points.select("lo", "from_", F.lead("lo").over(order).alias("hi"), F.lead("from_").over(order).alias("to_"))
    if not ring:
        return spans
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.select("lo", "from_", F.coalesce("hi", first("lo")).alias("hi"), F.coalesce("to_", first("from_") + 360).alias("to_"))
    gap = F.col("to_") - F.col("from_")
    spans = spans.select("*", gap.alias("gap"), F.max(gap).over(whole).alias("widest"), F.count("*").over(whole).alias("n"))
    others = F.try_divide(360 - F.col("widest"), F.col("n") - 1)
    outside = (F.row_number().over(Window.orderBy(F.desc("gap"), "from_")) == 1) & ~F.coalesce(F.col("widest") <= 1.5 * others, F.lit(False))
    return spans.select("lo", "from_", F.when(~outside, F.col("hi")).alias("hi"), F.when(~outside, F.col("to_")).alias("to_"))


def _brackets(targets: DataFrame, sources: DataFrame, name: str, ring: bool = False) -> DataFrame:
    """For each target coordinate its one or two source neighbours with their linear weights; none outside the sources."""
    place = (F.pmod(F.col(name), F.lit(360.0)) if ring else F.col(name)).cast("double")
    at = F.explode(F.array(place, place + 360)) if ring else place  # the last span of a ring lies across 360
    held = targets.select(name, at.alias("at")).join(F.broadcast(_spans(sources, name, ring)), (F.col("at") == F.col("from_")) | (F.col("at") > F.col("from_")) & (F.col("at") < F.col("to_")))
    share = F.when(F.col("at") == F.col("from_"), F.lit(0.0)).otherwise((F.col("at") - F.col("from_")) / (F.col("to_") - F.col("from_")))
    sides = F.explode(F.array(F.struct(F.col("lo").alias("at"), (1 - share).alias("w")), F.struct(F.col("hi").alias("at"), share.alias("w"))))
    return held.select(name, sides.alias("side")).select(F.col(name).alias(f"to_{name}"), F.col("side.at").alias(name), F.col("side.w").alias(f"w_{name}")).filter(F.col(f"w_{name}") > 0)


def regrid(field: DataFrame, grid: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """Bilinear values at the cells of `grid` (lat, lon); null outside the field's hull and beside a missing neighbour.

    Longitudes are places on a ring: -170 and 190 are one, and a field that goes all around has no edge. Cells keep the names that
    `grid` gives them. A result without any value is an error when it is read. Both axes are joined as small tables of neighbours,
    so each row of the field goes to the at most few targets it weighs in.
    """
    field = field.withColumn("value", clean(F.col("value")))
    axes = [_brackets(grid.select(n).distinct(), field.select(n).distinct(), n, ring=n == "lon") for n in ("lat", "lon")]
    spread = field.join(F.broadcast(axes[0]), "lat").join(F.broadcast(axes[1]), "lon").withColumn("w", F.col("w_lat") * F.col("w_lon"))
    made = spread.groupBy(*keys, F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")).agg(
        F.when(F.abs(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))) - 1) < 1e-9, F.sum(F.col("value") * F.col("w"))).alias("value"))
    frame = field.select(*keys).distinct().join(grid.select("lat", "lon").distinct(), how="cross")  # a row a cell of the result; Spark sends the smaller side
    known = made.agg(F.count("value").alias("known"))
    return unless(frame.join(made, [*keys, "lat", "lon"], "left"), known, F.col("known") == 0, "the regridded field has no value: its domain and that of the grid do not meet")


def weighted(field: DataFrame) -> DataFrame:
    """Values times the root of the area weight."""
    return field.withColumn("value", clean(F.col("value")) * eof_weight(F.col("lat")))
