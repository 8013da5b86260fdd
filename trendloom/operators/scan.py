"""Looks back along one long order without a task that holds all of it.

Rows are dealt out by ranges of the order, so each part is a stretch of it. A window over a part looks back within the part; what it
would see of the parts before is their last row or their sum, a row a part, which goes to every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import Workspace


def in_parts(rows: DataFrame, order: Sequence[str], space: Workspace, name: str = "ordered") -> DataFrame:
    """rows with `_part`, the number of their stretch of the order; written, so that every later look at them sees the same parts."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return space.written(dealt.withColumn("_part", F.spark_partition_id()), name)


def with_previous(parts: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds `_previous`, a struct of the columns of the row before in the whole order; null for the first row."""
    own = F.struct(*columns)
    lasts = parts.groupBy("_part").agg(F.max_by(own, F.struct(*order)).alias("last"))
    before = lasts.select("_part", F.lag("last").over(Window.orderBy("_part")).alias("_carried"))  # a row a part
    within = F.lag(own).over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn("_previous", F.coalesce(within, F.col("_carried"))).drop("_carried")


def with_running_sum(parts: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to this one."""
    totals = parts.groupBy("_part").agg(F.sum(value).alias("total"))
    before = totals.select("_part", (F.sum("total").over(Window.orderBy("_part")) - F.col("total")).alias("_carried"))  # a row a part
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "_part").withColumn(name, within + F.col("_carried")).drop("_carried")
