"""Aggregates that treat missing and constant values as the operators need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """As double; NaN becomes null, so that no aggregate counts it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Least-squares slope; null under `least` complete pairs."""
    return F.when(F.regr_count(y, x) >= least, F.regr_slope(y, x))


def intercept(y: Column, x: Column, least: int = 3) -> Column:
    return F.when(F.regr_count(y, x) >= least, F.regr_intercept(y, x))


def correlation(y: Column, x: Column) -> Column:
    """Pearson's r over complete pairs; null if either is constant."""
    both = y.isNotNull() & x.isNotNull()
    return F.try_divide(F.covar_pop(y, x), F.stddev_pop(F.when(both, y)) * F.stddev_pop(F.when(both, x)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows with a value; null if they weigh nothing."""
    known = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(known))


def area_weight(lat: Column) -> Column:
    """Share of area: the cosine of the latitude, 0 beyond the poles."""
    return F.greatest(F.cos(F.radians(lat)), F.lit(0.0))


def eof_weight(lat: Column) -> Column:
    """Root of the area weight, so that products of two weighted values weigh by area."""
    return F.sqrt(area_weight(lat))
