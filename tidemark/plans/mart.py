"""The monthly mart: sources to one table that every report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.disagg import spread_annual, spread_indicators
from tidemark.operators.forecast import extend_indicators, fit_lag_forest, recursive_forecast
from tidemark.operators.monthly import annual_sum, seasonal_weights, union_sources, with_share
from tidemark.session import materialise


def unify(sources: dict[str, DataFrame], keys: list[str], prefer: list[str] | None = None) -> DataFrame:
    """Clean monthly sources to one series table; shares are taken per source."""
    shared = {name: with_share(df, keys) for name, df in sources.items()}
    return union_sources(shared, keys, prefer)


def nowcast_annual(
    monthly: DataFrame, keys: list[str], first_train: int, last_train: int, missing: list[int],
    seed_from: str = "last_row", **forest,
) -> DataFrame:
    """Forecast annual values of the missing years of every series."""
    annual = annual_sum(monthly, keys, [C.VALUE])
    model = fit_lag_forest(annual, keys, first_train, last_train, **forest)
    return recursive_forecast(model, annual, keys, missing, seed_from=seed_from)


def build_monthly_mart(
    sources: dict[str, DataFrame],
    indicators: DataFrame,
    keys: list[str],
    first_train: int,
    last_train: int,
    missing: list[int],
    indicator_cut: int,
    columns: list[str] = C.INDICATORS,
    prefer: list[str] | None = None,
    seed_from: str = "last_row",
    lag_trees: int = 300,
    indicator_trees: int = 100,
) -> DataFrame:
    """Unify, nowcast missing years, spread them over months, add and extend indicators."""
    monthly = materialise(unify(sources, keys, prefer), "monthly")
    annual = nowcast_annual(
        monthly, keys, first_train, last_train, missing, seed_from, trees=lag_trees
    )
    weights = seasonal_weights(monthly, keys, last_train)
    filled = monthly.unionByName(spread_annual(annual, weights, keys), allowMissingColumns=True)
    mart = materialise(
        spread_indicators(filled, indicators, columns).select(
            *keys, C.DATE, C.YEAR, C.QUARTER, C.MONTH,
            *[F.col(f"`{c}`") for c in columns], C.VALUE,
        ),
        "mart",
    )
    return extend_indicators(mart, columns, keys, indicator_cut, trees=indicator_trees)


def write_mart(mart: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One write, read by all reports; year is the partition column they filter on."""
    mart.hint("rebalance", F.col(C.YEAR)).write.mode(mode).partitionBy(C.YEAR).parquet(path)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
