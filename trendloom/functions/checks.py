"""Errors as a part of a plan: raised while the rows are made, without a job before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unless(rows: DataFrame, facts: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows, or an error when they are read if `bad` holds in a row of `facts`, an aggregate that is a row or a few.

    The facts go along as a branch of a union that gives no row; what they share with the rows' own plan is shuffled once. Every
    column of the branch fails, so that a filter or join above, which null wouldn't pass, can't take the branch away.
    """
    fails = facts.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    return rows.unionByName(fails.select(*[F.when(bad, F.raise_error(message).cast(f.dataType)).alias(f.name) for f in rows.schema]))
