"""Annual to monthly: seasonal spread of totals and of indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.lookup import lookup_join, null_safe_join, unique_lookup
from tidemark.operators.monthly import year_total


def spread_annual(
    annual: DataFrame, weights: DataFrame, keys: list[str], renormalise: bool = False
) -> DataFrame:
    """Months of each (series, year) row of ``annual``: annual value times the mean
    weight of the month. The weights are not rescaled unless asked, so the year total
    is taken again from the months."""
    years = F.transform(
        F.sequence(F.lit(1), F.lit(12)), lambda m: F.make_date(F.col(C.YEAR), m, F.lit(1))
    )
    w = weights
    if renormalise:
        total = weights.groupBy(*keys).agg(F.sum(C.SHARE).alias("total__v"))
        w = null_safe_join(weights, total, keys)
        w = w.withColumn(C.SHARE, F.try_divide(F.col(C.SHARE), F.col("total__v"))).drop("total__v")
    d = F.col(C.DATE)
    months = annual.select(
        *keys, C.YEAR, F.col(C.VALUE).alias("annual__v"), F.explode(years).alias(C.DATE)
    ).select(
        "*", F.quarter(d).alias(C.QUARTER), F.date_format(d, "MMM").alias(C.MONTH)
    )
    out = (
        months.join(w, [*keys, C.MONTH], "left")
        .withColumn(C.VALUE, F.col("annual__v") * F.col(C.SHARE))
        .drop("annual__v")
    )
    return year_total(out, keys)


def spread_indicators(
    monthly: DataFrame, annual: DataFrame, columns: list[str], on: list[str] | None = None
) -> DataFrame:
    """Annual indicators times the month weight, all columns in one projection.

    Percentages are weighted as well; the caller picks the columns. A year without
    indicators gives nulls. The indicators are few rows on few keys, so the months of all
    series are not shuffled by year.
    """
    on = on or [C.YEAR]
    dim = unique_lookup(annual.select(*on, *[F.col(f"`{c}`") for c in columns]), on)
    joined = lookup_join(monthly, dim, on)
    keep = [F.col(f"`{c}`") for c in monthly.columns]
    return joined.select(*keep, *[(F.col(f"`{c}`") * F.col(C.SHARE)).alias(c) for c in columns])
