"""Row filters, the validated membership filter and metadata predicates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.text import parse_int_list
from tidemark.operators.lookup import lookup_join


def drop_missing(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Drop rows with missing cells; NaN counts as missing."""
    return df.na.drop(how=how, subset=subset)


def year_range(df: DataFrame, lo: int, hi: int, year: str = C.YEAR) -> DataFrame:
    return df.where(F.col(year).between(lo, hi))


def validated_filter(
    df: DataFrame, column: str, requested: str | list[int]
) -> tuple[DataFrame, list[int], bool]:
    """Keep the requested values if every one occurs, else keep the whole table.

    Returns ``(rows, invalid values, format ok)``. A text is read by ``parse_int_list``. The one
    job it runs on the table returns at most as many rows as values were requested.
    """
    if isinstance(requested, str):
        typed = df.sparkSession.createDataFrame([(requested,)], "text string").select(parse_int_list(F.col("text")).alias("p"))
        values, ok = typed.first()["p"]
        if not ok:
            return df, [], False
    else:
        values = list(requested)
    if not values:
        return df, [], True
    found = {
        r[0]
        for r in df.where(F.col(column).isin(values)).select(column).distinct().toLocalIterator()
    }
    invalid = [v for v in values if v not in found]
    return (df if invalid else df.where(F.col(column).isin(values))), invalid, True


def invalid_values(requested: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Requested values that do not occur (anti-join form, for long request tables)."""
    return requested.join(df.select(column).distinct(), column, "left_anti")


def latest_period(
    df: DataFrame, period: str = C.YEAR, keys: list[str] | None = None
) -> DataFrame:
    """Rows of the last period, over all rows or per key.

    The maximum is a partial aggregate; the rows are never gathered per key.
    """
    if not keys:
        return df.where(F.col(period) == df.agg(F.max(period)).scalar())
    last = df.groupBy(*keys).agg(F.max(period).alias(period))
    return lookup_join(df, last, [*keys, period], "left_semi")


def metadata_predicate(
    ranges: list[tuple[int, int, str]],
    source: str = C.VECTOR_SOURCE,
    fold_type: bool = True,
    year: Column | None = None,
    type_: Column | None = None,
    source_col: Column | None = None,
) -> Column:
    """``source = s AND (any of: year between lo and hi AND type = t)``.

    Stored types are lower-case, so a type such as ``Prévision arrivée`` matches only
    with ``fold_type``. Without ranges only the source is tested.
    """
    y = F.col(f"metadata.{C.YEAR}") if year is None else year
    t = F.col("metadata.type") if type_ is None else type_
    s = F.col("metadata.source") if source_col is None else source_col
    pred = s == source
    if ranges:
        terms = []
        for lo, hi, wanted in ranges:
            same = F.lower(t) == wanted.lower() if fold_type else t == wanted
            terms.append(y.between(lo, hi) & same)
        pred = pred & reduce(or_, terms)
    return pred


def derived_k(
    years: tuple[int, int] | None = None,
    specific_years: tuple[int, int] | None = None,
    quarters: tuple[int, int] | None = None,
    k: int | None = None,
) -> int:
    """Number of results: a given ``k``, else the sum of the inclusive range widths, one
    more with quarters, else 20."""
    if k is not None:
        return k
    k = sum(hi - lo + 1 for lo, hi in filter(None, (years, specific_years, quarters)))
    if quarters:
        k += 1
    return k if k > 0 else C.DEFAULT_TOP_K


def derived_k_column(ranges: Column, has_quarter: Column) -> Column:
    """Column form over ``array<struct<lo int, hi int>>``."""
    widths = F.aggregate(
        ranges, F.lit(0), lambda acc, r: acc + r["hi"] - r["lo"] + F.lit(1)
    )
    k = widths + F.when(has_quarter, F.lit(1)).otherwise(F.lit(0))
    return F.when(k > 0, k).otherwise(F.lit(C.DEFAULT_TOP_K))


def total_or_zero(df: DataFrame, column: str) -> Column:
    """Sum of a column, or 0 when the table has no such column."""
    return F.coalesce(F.sum(column), F.lit(0.0)) if column in df.columns else F.lit(0.0)




def _new_year(df: DataFrame, date: str, year: int) -> Column:
    return F.lit(f"{year}-01-01").cast(df.schema[date].dataType)


def date_years(df: DataFrame, date: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Inclusive year range on a raw date column, written on the column itself so that it
    reaches the scan; either side may be open."""
    if lo is not None:
        df = df.where(F.col(date) >= _new_year(df, date, lo))
    if hi is not None:
        df = df.where(F.col(date) < _new_year(df, date, hi + 1))
    return df


def date_year_in(df: DataFrame, date: str, years: list[int]) -> DataFrame:
    """Rows of the listed years, as date ranges that reach the scan."""
    ranges = [
        (F.col(date) >= _new_year(df, date, y)) & (F.col(date) < _new_year(df, date, y + 1))
        for y in years
    ]
    return df.where(reduce(or_, ranges, F.lit(False)))
