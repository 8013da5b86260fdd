"""Label series: strings with a fixed order, codes by day, and their alignment with other series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.checks import unless


def regime(label: Column) -> Column:
    """What stands before the first dash."""
    return F.split_part(label, F.lit("-"), F.lit(1))


def encode(rows: DataFrame, order: Sequence[str] | None, label: str = "label") -> DataFrame:
    """Adds `type`: the place of the label in a fixed order. A label that is not in it is an error; without an order,
    the distinct labels sorted are the order, so they have to be few."""
    if order is None:
        order = sorted(r[0] for r in rows.select(label).distinct().limit(10_001).collect() if r[0] is not None)
        if len(order) > 10_000:
            raise ValueError("more than 10000 distinct labels; give their order")
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    unknown = F.raise_error(F.concat(F.lit("label without a code: "), F.coalesce(F.col(label), F.lit("null"))))
    return rows.withColumn("type", F.when(place > 0, (place - 1).cast("int")).otherwise(unknown.cast("int")))


def by_day(rows: DataFrame, ts: str = "ts", shift_days: int = 0) -> DataFrame:
    """Adds `day`, the day of ts moved by whole days."""
    return rows.withColumn("day", F.date_add(F.to_date(ts), shift_days))


def load_labels(rows: DataFrame, grouping: str, order: Sequence[str] | None = None, start: str | None = None, end: str | None = None, shift_days: int = 0) -> DataFrame:
    """(day, type) from (ts, label), grouped by 'regime' or 'type'."""
    if grouping not in ("regime", "type"):
        raise ValueError("grouping must be regime or type")
    if grouping == "regime":
        rows = rows.withColumn("label", regime(F.col("label")))
    out = encode(by_day(rows, shift_days=shift_days), order).select("day", "type")
    if start or end:
        out = out.filter(F.col("day").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))
        out = unless(out, out.agg(F.count("*").alias("n")), F.col("n") == 0, "no label in the period")
    return out


def align_to(rows: DataFrame, reference: DataFrame, day: str = "day") -> DataFrame:
    """The rows on days that the reference has; an error if there is none."""
    kept = rows.join(reference.select(day).distinct(), day, "left_semi")
    return unless(kept, kept.agg(F.count("*").alias("n")), F.col("n") == 0, "the series share no day")


def look_up(impact: DataFrame, labels: DataFrame, day: str = "day") -> DataFrame:
    """(day, type, value) where every day of the impact has to have a label."""
    known = labels.select(day, "type", F.lit(True).alias("_known"))
    fails = F.raise_error(F.concat(F.lit("a day without a label: "), F.coalesce(F.col(day).cast("string"), F.lit("null"))))
    return impact.join(known, day, "left").select(day, F.when(F.col("_known"), F.col("type")).otherwise(fails.cast(dict(labels.dtypes)["type"])).alias("type"), "value")
