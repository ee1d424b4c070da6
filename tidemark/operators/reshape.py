"""Wide to long, long to wide, and calendar spines."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.calendar import clean_header, parse_month, with_calendar
from tidemark.functions.numbers import parse_number


def month_headers(df: DataFrame, full_names: bool = False) -> dict[str, datetime.date]:
    """The columns whose header names a month, with its first day. Headers are known when the plan
    is built, so each is parsed once, not in every cell."""
    headers = df.sparkSession.createDataFrame([(c,) for c in df.columns], "header string")
    day = parse_month(clean_header(F.col("header"), full_names))
    found = {r["header"]: r["day"] for r in headers.select("header", day.alias("day")).collect()}
    return {c: found[c] for c in df.columns if found[c] is not None}


def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide to long, nulls kept."""
    return df.unpivot(
        [F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], name, value
    )


def unpivot_months(df: DataFrame, full_names: bool = False, strip_nbsp: bool = False) -> DataFrame:
    """Wide monthly sheet to the long calendar form; a column whose header is no month stays beside
    every row."""
    months = month_headers(df, full_names)
    ids = [F.col(f"`{c}`") for c in df.columns if c not in months]
    cells = [F.struct(F.lit(day).alias(C.DATE), F.col(f"`{c}`").alias("cell__v")) for c, day in months.items()]
    long = df.select(*ids, F.inline(F.array(*cells)))
    number = parse_number(F.col("cell__v"), strip_nbsp).alias(C.VALUE)
    return with_calendar(long.select(*ids, number, F.col(C.DATE)))


def pivot_months(df: DataFrame, keys: list[str], value: str = C.VALUE) -> DataFrame:
    """Year by month table of sums with the twelve months as columns.

    The months are given, so no job runs to find them; one conditional sum per month
    needs one shuffle. A cell of only missing values is 0, an absent cell null.
    """
    def cell(m):
        hit = F.col(C.MONTH) == m
        filled = F.coalesce(F.sum(F.when(hit, F.col(value))), F.lit(0.0))
        return F.when(F.count(F.when(hit, 1)) > 0, filled).alias(m)

    return df.groupBy(*keys, C.YEAR).agg(*[cell(m) for m in C.MONTHS])


def unpivot_pivoted(df: DataFrame, keys: list[str], value: str = C.VALUE) -> DataFrame:
    return melt(df, [*keys, C.YEAR], C.MONTHS, C.MONTH, value)


def calendar_spine(series: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every month of the years for each row of ``series``, by exploding sequences."""
    dates = F.sequence(
        F.lit(f"{first_year}-01-01").cast("date"),
        F.lit(f"{last_year}-12-01").cast("date"),
        F.expr("interval 1 month"),
    )
    return with_calendar(series.select("*", F.explode(dates).alias(C.DATE)))
