"""Climate indices, their share in frequency trends, and their removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.calendar import half_year, in_season, season_name, season_year
from trendloom.functions.checks import unless
from trendloom.functions.quantiles import exact_quantiles
from trendloom.functions.statistics import clean, correlation, slope
from trendloom.operators.scan import in_parts, with_previous
from trendloom.session import Workspace


def zscores(series: DataFrame, name: str = "value") -> DataFrame:
    """(day, name): the value less the mean of the whole series, by its standard deviation; both are summed in all tasks."""
    own = series.select("day", clean(F.col("value")).alias("value"))
    whole = own.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return own.join(F.broadcast(whole), how="cross").select("day", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")).alias(name))  # one row


def band_mean(field: DataFrame, centre: float, half_width: float) -> DataFrame:
    """(day, value): the mean over each line of latitude in a band, then over the lines."""
    rows = field.filter(F.abs(F.col("lat") - centre) <= half_width)
    means = rows.groupBy("day", "lat").agg(F.avg(clean(F.col("value"))).alias("value")).groupBy("day").agg(F.avg("value").alias("value"))
    return unless(means, means.agg(F.count("*").alias("n")), F.col("n") == 0, f"no cell within {half_width} degrees of {centre}")


def sam_proxy(field: DataFrame, north: float = -40.0, south: float = -60.0, half_width: float = 2.5) -> DataFrame:
    """(day, value): the standardised northern band less the standardised southern one."""
    a, b = (zscores(band_mean(field, c, half_width), n) for c, n in ((north, "north"), (south, "south")))
    return a.join(b, "day").select("day", (F.col("north") - F.col("south")).alias("value"))


def ridge_index(field: DataFrame, centre: float = -37.5, half_width: float = 5.0) -> DataFrame:
    return zscores(band_mean(field, centre, half_width))


def seasonal_mean(index: DataFrame, season: str | None = None) -> DataFrame:
    """(year, value) of a daily or monthly index (day, value); partial seasons stay."""
    season_name(season)
    kept = index.filter(in_season(F.col("day"), season))
    return kept.groupBy(season_year(F.col("day"), season).alias("year")).agg(F.avg(clean(F.col("value"))).alias("value"))


def _shared(table: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of a yearly table in years that the index has too, with its value as x; a table without seasons is one season."""
    if "season" not in table.columns:
        table = table.withColumn("season", F.lit("all"))
    return table.join(index.select("year", F.col("value").alias("x")), "year")


def _centre(rows: DataFrame) -> DataFrame:
    """(season, centre): the mean of the index over the shared years of each season."""
    return rows.select("season", "year", "x").distinct().groupBy("season").agg(F.avg("x").alias("centre"))


def regress_on_index(table: DataFrame, index: DataFrame) -> DataFrame:
    """(season, type, slope, r) of frequencies on an index, over the years that both have; r is null where a type never changes."""
    y, x = F.col("frequency"), F.col("x")
    return _shared(table, index).groupBy("season", "type").agg(slope(y, x).alias("slope"), F.when(F.regr_count(y, x) >= 3, correlation(y, x)).alias("r"))


def residual_trend(table: DataFrame, index: DataFrame) -> DataFrame:
    """(season, type, before, after): the trend of a frequency, and what is left of it without its response to the index."""
    of_type, year = Window.partitionBy("season", "type"), F.col("year").cast("double")
    rows = _shared(table, index)
    rows = rows.join(F.broadcast(_centre(rows)), "season")  # a row a season
    b = F.when(F.regr_count("frequency", "x").over(of_type) >= 3, F.regr_slope("frequency", "x").over(of_type))
    rows = rows.withColumn("rest", F.col("frequency") - b * (F.col("x") - F.col("centre")))
    return rows.groupBy("season", "type").agg(slope(F.col("frequency"), year).alias("before"), slope(F.col("rest"), year).alias("after"))


def attributable_fraction(table: DataFrame, index: DataFrame) -> DataFrame:
    """(season, type, slope, r, index_trend, predicted_trend, observed_trend, ratio); no ratio where the observed trend is under a
    tenth of the season's largest. The index trend is over all years of the index."""
    year = F.col("year").cast("double")
    trend = index.agg(slope(F.col("value"), year).alias("index_trend"))
    table = table if "season" in table.columns else table.withColumn("season", F.lit("all"))
    observed = table.groupBy("season", "type").agg(slope(F.col("frequency"), year).alias("observed_trend"))
    rows = regress_on_index(table, index).join(observed, ["season", "type"]).join(F.broadcast(trend), how="cross")  # one row
    predicted, seen = F.col("slope") * F.col("index_trend"), F.abs("observed_trend")
    ratio = F.when(seen > 0.1 * F.max(seen).over(Window.partitionBy("season")), predicted / F.col("observed_trend"))
    return rows.select("season", "type", "slope", "r", "index_trend", predicted.alias("predicted_trend"), "observed_trend", ratio.alias("ratio"))


def remove_index(table: DataFrame, index: DataFrame, least_years: int = 10) -> DataFrame:
    """The yearly table without the linear response of both series to an index; frequencies cut at 0 and summing to 1 again."""
    rows = _shared(table, index)
    if rows.select("year").distinct().count() < least_years:
        raise ValueError(f"fewer than {least_years} shared years")
    of_type = Window.partitionBy("season", "type")
    rows = rows.join(F.broadcast(_centre(rows)), "season")  # a row a season

    def rest(name: str) -> Column:
        b = F.when(F.regr_count(name, "x").over(of_type) >= 3, F.regr_slope(name, "x").over(of_type))
        return F.col(name) - F.coalesce(b, F.lit(0.0)) * (F.col("x") - F.col("centre"))

    rows = rows.withColumns({"raw": F.greatest(rest("frequency"), F.lit(0.0)), "type_mean": rest("type_mean")})
    share = F.coalesce(F.try_divide("raw", F.sum("raw").over(Window.partitionBy("season", "year"))), F.lit(0.0))
    return rows.select("season", "year", "type", share.alias("frequency"), "type_mean", "n")


def offset_spread(impact: DataFrame, labels: DataFrame, offsets: Sequence[int], least: int = 2) -> DataFrame:
    """(offset, spread, gap): how far the means of the types lie apart when labels are moved by so many days.

    The spread is the standard deviation of the means weighted by their days, the gap greatest less least; null under
    `least` types. Days are summed first, so the offsets multiply days and not rows. Squares are of what the means differ from
    their centre: as differences of squares a spread of 0 may come out as some 1e-7.
    """
    daily = impact.groupBy(F.to_date("day").alias("day")).agg(F.sum(clean(F.col("value"))).alias("total"), F.count(clean(F.col("value"))).alias("n"))
    moved = labels.select("day", "type").withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    moved = moved.select(F.date_add("day", F.col("offset")).alias("day"), "type", "offset")
    means = daily.join(moved, "day").groupBy("offset", "type").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").withColumn("m", F.col("total") / F.col("n"))
    of_offset = Window.partitionBy("offset")  # a row a type
    means = means.withColumn("apart", F.col("m") - F.sum("total").over(of_offset) / F.sum("n").over(of_offset))
    many = F.count("*") >= least
    spread = F.sqrt(F.sum(F.col("n") * F.col("apart") * F.col("apart")) / F.sum("n"))
    return means.groupBy("offset").agg(F.when(many, spread).alias("spread"), F.when(many, F.max("m") - F.min("m")).alias("gap"))


def best_offset(spreads: DataFrame) -> DataFrame:
    return spreads.filter("spread is not null").agg(F.max_by("offset", F.struct("spread", -F.col("offset"))).alias("offset"))


def hot_days(series: DataFrame, percentile: float = 90.0, by_half: bool = True) -> DataFrame:
    """(day, value, hot): 1 where the value is over the percentile of its half-year, or of the whole series. The percentile is exact,
    by rank, and no task holds the values of a half."""
    half = half_year(F.col("day")) if by_half else F.lit("all")
    rows = series.select("day", clean(F.col("value")).alias("value")).withColumn("half", half)
    limits = exact_quantiles(rows, ["half"], [percentile / 100]).select("half", F.col("quantile").alias("limit_"))
    return rows.join(F.broadcast(limits), "half").select("day", "value", (F.col("value") > F.col("limit_")).cast("int").alias("hot"))  # two rows


def lag_correlation(series: DataFrame, by: Sequence[str] = (), at: str = "day") -> DataFrame:
    """(*by, r): the correlation of each value with the next, over pairs of which neither is missing.

    Without `by` all rows are one series, which is dealt out in stretches; with it, a series is a task's, and many are spread.
    """
    value = clean(F.col("value")).alias("value")
    if by:
        rows = series.select(*by, at, value).select(*by, "value", F.lead("value").over(Window.partitionBy(*by).orderBy(at)).alias("next"))
        return rows.groupBy(*by).agg(correlation(F.col("value"), F.col("next")).alias("r"))
    with Workspace(series.sparkSession, "lags") as space:
        rows = with_previous(in_parts(series.select(at, value), [at], space), [at], ["value"])
        return space.finish(rows.agg(correlation(F.col("_previous.value"), F.col("value")).alias("r")))
