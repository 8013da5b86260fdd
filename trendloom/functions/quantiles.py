"""Exact quantiles by distributed rank selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from trendloom.functions.statistics import clean

#: Bits of a value's order that one pass tells apart; with 16, a group has at most 65,536 counts in a pass.
BITS = 16
_SIGN = np.uint64(1 << 63)


@F.pandas_udf(LongType())
def ordered_bits(value: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles: the bits of a double, all turned around for negative ones, read as signed."""
    bits = (value.to_numpy(np.float64) + 0.0).view(np.uint64)
    bits = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    return pd.Series((bits ^ _SIGN).view(np.int64))


@F.pandas_udf(DoubleType())
def of_ordered_bits(order: pd.Series) -> pd.Series:
    """The inverse of ordered_bits."""
    bits = order.to_numpy(np.int64).view(np.uint64) ^ _SIGN
    return pd.Series(np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64))


def exact_quantiles(rows: DataFrame, by: Sequence[str], probabilities: Sequence[float], value: str = "value") -> DataFrame:
    """(*by, probability, quantile) of each group, between neighbours in order as far as the probability lies between their ranks.

    Missing values count nowhere; a group without any has no row. No task sorts a group or holds its values: in each of
    64 / BITS passes the rows that share the leading bits found so far are counted by their next bits, and running sums of the
    counts, at most 2 ** BITS a group and rank, tell where each wanted rank goes on.
    """
    known = rows.select(*by, clean(F.col(value)).alias("_v")).filter("_v is not null").select(*by, ordered_bits("_v").alias("_order"))
    counts = known.groupBy(*by).agg(F.count("*").alias("_n"))
    wanted = counts.select(*by, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"))
    place = (F.col("_n") - 1) * F.col("probability")
    ranks = F.explode(F.array(*[F.struct(F.floor(place).alias("rank"), (1 - (place - F.floor(place))).alias("share")), F.struct(F.ceil(place).alias("rank"), (place - F.floor(place)).alias("share"))]))
    wanted = wanted.select(*by, "probability", ranks.alias("x")).filter("x.share > 0").select(*by, "probability", "x.share", F.col("x.rank").alias("_rank"), F.lit(0).cast("long").alias("_prefix"))
    by = list(by)
    for done in range(0, 64, BITS):
        prefix = F.shiftright(F.col("_order"), 64 - done) if done else F.lit(0).cast("long")
        digit = F.shiftrightunsigned(F.shiftleft(F.col("_order"), done), 64 - BITS) if done else F.shiftright(F.col("_order"), 64 - BITS)
        rows_in = known.select(*by, prefix.alias("_prefix"), digit.alias("_digit"))
        if done:
            rows_in = rows_in.join(wanted.select(*by, "_prefix").distinct(), [*by, "_prefix"], "left_semi")
        found = rows_in.groupBy(*by, "_prefix", "_digit").agg(F.count("*").alias("_c"))
        running = F.sum("_c").over(Window.partitionBy(*by, "_prefix").orderBy("_digit"))
        found = found.select(*by, "_prefix", "_digit", (running - F.col("_c")).alias("_before"), running.alias("_to"))
        step = wanted.join(found, [*by, "_prefix"]).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_to")))
        longer = F.shiftleft(F.col("_prefix"), BITS).bitwiseOR(F.col("_digit")) if done else F.col("_digit")
        wanted = step.select(*by, "probability", "share", (F.col("_rank") - F.col("_before")).alias("_rank"), longer.alias("_prefix"))
    return wanted.groupBy(*by, "probability").agg(F.sum(of_ordered_bits("_prefix") * F.col("share")).alias("quantile"))
