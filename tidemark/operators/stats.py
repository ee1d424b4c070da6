"""Correlation, least squares, residual anomalies, mean fill and trends, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.lookup import lookup_join


def pearson(df: DataFrame, keys: list[str], x: str, y: str, name: str = "correlation") -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(x, y).alias(name))


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of ``y`` on ``x`` per key, as plain map-side combined aggregates."""
    cx, cy = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept")
    )


def _fitted(keys: list[str], x: str, y: str) -> Column:
    """Value on the least squares line of its key, as window aggregates."""
    w = Window.partitionBy(*keys)
    cx, cy = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    return F.regr_slope(cy, cx).over(w) * cx + F.regr_intercept(cy, cx).over(w)


def with_residuals(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Fitted value and residual beside each row of an annual table.

    One row per key and year, so a window holds the years of one series only; the input
    is computed once, where an aggregate joined back would compute it twice.
    """
    return df.withColumn("recettes_predites", _fitted(keys, x, y)).withColumn(
        "écart", F.col(f"`{y}`") - F.col("recettes_predites")
    )


def residual_anomalies(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Label rows whose residual is beyond one sample standard deviation of its key.

    Adds the correlation of the key too; all windows share one shuffle.
    """
    w = Window.partitionBy(*keys)
    gap = F.col("écart")
    label = (
        F.when(gap < -F.col("seuil"), C.ANOMALY_LOW)
        .when(gap > F.col("seuil"), C.ANOMALY_HIGH)
        .otherwise(C.ANOMALY_NORMAL)
    )
    return (
        with_residuals(df, keys, x, y)
        .withColumn("seuil", F.stddev_samp(gap).over(w))
        .withColumn("correlation", F.corr(F.col(f"`{x}`"), F.col(f"`{y}`")).over(w))
        .withColumn("type anomalie", label)
    )


def fill_with_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replace missing values by the mean of their key; no task holds a whole key."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean__v"))
    return (
        lookup_join(df, means, keys)
        .withColumn(value, F.coalesce(F.col(value), F.col("mean__v")))
        .drop("mean__v")
    )


def trend(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    horizon: int = 4,
    noise: float = 0.5,
    seed: int = 42,
    last_year: Column | None = None,
) -> DataFrame:
    """Linear trend on the year for the next ``horizon`` years, plus uniform noise.

    Raises when a value is missing. One aggregate for all values, then an explode of the
    future years of each series.
    """
    year = F.col(C.YEAR).cast("double")
    fits = []
    for i, v in enumerate(values):
        c = F.col(f"`{v}`").cast("double")
        complete = F.count(c) == F.count(F.lit(1))
        message = f"missing values in {v}"
        fits.append(
            F.when(complete, F.regr_slope(c, year))
            .otherwise(F.raise_error(F.lit(message)).cast("double"))
            .alias(f"slope__{i}")
        )
        fits.append(F.regr_intercept(c, year).alias(f"intercept__{i}"))
    last = F.max(C.YEAR) if last_year is None else last_year
    future = (
        df.groupBy(*keys)
        .agg(*fits, last.alias("last__y"))
        .withColumn(C.YEAR, F.explode(F.sequence(F.col("last__y") + 1, F.col("last__y") + horizon)))
    )
    out = []
    for i, v in enumerate(values):
        value = F.col(f"slope__{i}") * F.col(C.YEAR) + F.col(f"intercept__{i}")
        if noise:
            # From the hash of the row, so that a task run twice adds the same noise.
            unit = F.pmod(F.xxhash64(F.lit(seed + i), *keys, C.YEAR), F.lit(2**40)) / 2**40
            value = value + (unit * 2 - 1) * noise
        out.append(value.alias(v))
    return future.select(*keys, C.YEAR, *out)
