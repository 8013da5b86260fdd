"""Runs, transitions and seasonal counts of a label series (day, type), and mean fields by type."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.statistics import clean
from trendloom.operators.decompose import codes
from trendloom.operators.scan import in_parts, with_previous, with_running_sum
from trendloom.session import Workspace


def composite(field: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(type, lat, lon, value): the mean field of each type, dense over the codes; a day of the field without a label is an error."""
    known = labels.select("day", F.col("type").alias("_type"), F.lit(True).alias("_known"))
    fails = F.raise_error(F.concat(F.lit("a day of the field without a label: "), F.coalesce(F.col("day").cast("string"), F.lit("null")))).cast(dict(labels.dtypes)["type"])
    own = field.join(known, "day", "left").withColumn("type", F.when(F.col("_known"), F.col("_type")).otherwise(fails))
    found = own.groupBy("type", "lat", "lon").agg(F.avg(clean(F.col("value"))).alias("value"))
    frame = field.select("lat", "lon").distinct().join(F.broadcast(codes(field.sparkSession, k)), how="cross")
    return frame.join(found, ["type", "lat", "lon"], "left").select("type", "lat", "lon", "value")


def seasonal_counts(labels: DataFrame, k: int) -> DataFrame:
    """(type, month, n), dense."""
    found = labels.groupBy("type", F.month("day").alias("month")).agg(F.count("*").alias("n"))
    months = labels.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    frame = codes(labels.sparkSession, k).join(F.broadcast(months), how="cross")
    return frame.join(found, ["type", "month"], "left").select("type", "month", F.coalesce("n", F.lit(0)).alias("n"))


def run_lengths(labels: DataFrame, series: Sequence[str] = (), at: str = "day") -> DataFrame:
    """(*series, type, start, length) of each longest run of one type, by the order of rows; gaps in time don't end it.

    Without `series` all rows are one sequence, which is dealt out in stretches; with the columns that tell sequences apart, a
    sequence is a task's, and many are spread.
    """
    if not series:
        with Workspace(labels.sparkSession, "runs") as space:
            parts = with_previous(in_parts(labels.select(at, "type"), [at], space), [at], ["type"])
            changed = F.when(F.col("_previous").isNull() | ~F.col("type").eqNullSafe(F.col("_previous.type")), 1).otherwise(0)
            marked = space.written(parts.select("_part", at, "type", changed.alias("changed")), "marked")
            runs = with_running_sum(marked, [at], F.col("changed"), "run")
            return space.finish(runs.groupBy("run").agg(F.first("type").alias("type"), F.min(at).alias("start"), F.count("*").alias("length")).drop("run"))
    order = Window.partitionBy(*series).orderBy(at)
    changed = (~F.col("type").eqNullSafe(F.lag("type").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    runs = labels.select(*series, at, "type", changed.alias("changed")).withColumn("run", F.sum("changed").over(order))
    return runs.groupBy(*series, "run").agg(F.first("type").alias("type"), F.min(at).alias("start"), F.count("*").alias("length")).drop("run")


def persistence(labels: DataFrame, k: int, series: Sequence[str] = (), at: str = "day") -> DataFrame:
    """(type, mean_run, median_run, runs), dense; a type without runs has null and 0."""
    found = run_lengths(labels, series, at).groupBy("type").agg(F.avg("length").alias("mean_run"), F.median("length").alias("median_run"), F.count("*").alias("runs"))
    return codes(labels.sparkSession, k).join(found, "type", "left").select("type", "mean_run", "median_run", F.coalesce("runs", F.lit(0)).alias("runs"))


def transitions(labels: DataFrame, k: int, normalise: bool = False, series: Sequence[str] = (), at: str = "day") -> DataFrame:
    """(type, type_to, n), dense; with normalise n is the share of its row, 0 in an empty row."""
    if series:
        step = labels.select("type", F.lead("type").over(Window.partitionBy(*series).orderBy(at)).alias("type_to")).filter("type_to is not null")
        found = step.groupBy("type", "type_to").agg(F.count("*").alias("n"))
    else:  # one long sequence, in stretches
        with Workspace(labels.sparkSession, "steps") as space:
            step = with_previous(in_parts(labels.select(at, "type"), [at], space), [at], ["type"]).filter("_previous is not null and type is not null")
            found = space.finish(step.groupBy(F.col("_previous.type").alias("type"), F.col("type").alias("type_to")).agg(F.count("*").alias("n")))
    types = codes(labels.sparkSession, k)
    frame = types.join(F.broadcast(types.select(F.col("type").alias("type_to"))), how="cross")
    dense = frame.join(found, ["type", "type_to"], "left").select("type", "type_to", F.coalesce("n", F.lit(0)).alias("n"))
    if normalise:
        dense = dense.withColumn("n", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy("type"))), F.lit(0.0)))
    return dense


def matrix(table: DataFrame, k: int, row: str = "type", column: str = "type_to", value: str = "n") -> np.ndarray:
    """A k x k table on the driver; k is a number of types, so it is small."""
    out = np.zeros((k, k))
    for r in table.select(row, column, value).collect():
        out[r[0], r[1]] = r[2]
    return out


def cyclic_order(steps: np.ndarray) -> list[int]:
    """The types in the order of a walk that starts with the strongest change and goes on to the likeliest type not yet met."""
    open_ = np.where(np.eye(len(steps), dtype=bool), -np.inf, steps)
    walk = [int(open_.argmax()) // len(steps)]
    while len(walk) < len(steps):
        open_[:, walk[-1]] = -np.inf
        left = [j for j in range(len(steps)) if j not in walk]
        walk.append(left[int(np.argmax(open_[walk[-1], left]))])
    return walk


def cyclic_asymmetry(table: DataFrame, order: Sequence[int], without: float = 0.0) -> DataFrame:
    """(asymmetry): steps forward less steps back around the cycle, over both; `without` where there are no such steps."""
    k, place = len(order), {t: i for i, t in enumerate(order)}
    at = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    turn = F.pmod(at[F.col("type_to")] - at[F.col("type")], F.lit(k))
    ahead, back = (F.coalesce(F.sum(F.when((turn == t) & (F.col("type") != F.col("type_to")), F.col("n"))), F.lit(0)) for t in (1, k - 1))
    if k == 2:
        back = F.lit(0)
    return table.agg(F.coalesce(F.try_divide(ahead - back, ahead + back), F.lit(without)).cast("double").alias("asymmetry"))


def sequence_report(labels: DataFrame, k: int, without: float = 0.0) -> dict[str, float]:
    """Mean runs and their spread over the types, the mean share of days that stay, and the asymmetry, `without` where nothing turns."""
    table = transitions(labels, k)
    shares, runs = matrix(transitions(labels, k, normalise=True), k), [r.mean_run for r in persistence(labels, k).collect() if r.mean_run is not None]
    order = cyclic_order(matrix(table, k))
    return {"mean_run": float(np.mean(runs)), "run_spread": float(np.std(runs)), "mean_stay": float(np.trace(shares) / k), "asymmetry": cyclic_asymmetry(table, order, without).first()[0]}
