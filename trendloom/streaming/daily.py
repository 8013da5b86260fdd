"""Daily means over a stream, with a watermark for late steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.statistics import clean


def daily_mean_stream(steps: DataFrame, keys: Sequence[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """(day, *keys, value, n) once a day is complete; the state holds the days inside the watermark only."""
    days = steps.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys)
    found = days.agg(F.avg(clean(F.col("value"))).alias("value"), F.count("*").alias("n"))
    return found.select(F.to_date("window.start").alias("day"), *keys, "value", "n")
