"""One query per dashboard element, over the monthly mart.

``rows`` is the filtered mart (range filter, balance added, incomplete rows dropped);
``selected`` the same after the year and quarter filters. ``keys`` are the series columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.numbers import pct_label, thousands
from tidemark.operators.filters import latest_period, total_or_zero, validated_filter, year_range
from tidemark.operators.monthly import (
    annual_sum,
    pct_change,
    quarters_with_year_total,
    sign_class,
    with_balance,
)
from tidemark.operators.reshape import melt, pivot_months
from tidemark.operators.stats import residual_anomalies

KPI_COLUMNS = {
    "arrivees": C.VALUE,
    "recettes": C.RECEIPTS,
    "depenses": C.EXPENSES,
    "soldes": C.BALANCE,
}


def filtered(mart: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    rows = mart if lo is None or hi is None else year_range(mart, lo, hi)
    return with_balance(rows).na.drop("any")


def select_periods(
    rows: DataFrame, years: str | list[int] = "", quarters: str | list[int] = ""
) -> tuple[DataFrame, DataFrame, dict]:
    """Year filter, then quarter filter on its result; each falls back to its input.

    Returns (by year, by year and quarter, messages)."""
    by_year, bad_years, years_ok = validated_filter(rows, C.YEAR, years)
    by_quarter, bad_quarters, quarters_ok = validated_filter(by_year, C.QUARTER, quarters)
    messages = {
        "invalid_years": bad_years,
        "years_ok": years_ok,
        "invalid_quarters": bad_quarters,
        "quarters_ok": quarters_ok,
    }
    return by_year, by_quarter, messages


def kpis(rows: DataFrame, sep: str = ",") -> DataFrame:
    """One row of formatted totals."""
    totals = rows.agg(*[total_or_zero(rows, c).alias(n) for n, c in KPI_COLUMNS.items()])
    return totals.select(*[thousands(F.col(n), sep).alias(n) for n in KPI_COLUMNS])


def kpi_latest(rows: DataFrame) -> DataFrame:
    return kpis(latest_period(rows), " ")


def scatter(monthly: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Annual arrivals of the unfiltered series against annual receipts of the mart."""
    receipts = annual_sum(rows, keys, [C.RECEIPTS]).withColumnRenamed(C.RECEIPTS, "Recettes")
    return annual_sum(monthly, keys, [C.VALUE]).join(receipts, [*keys, C.YEAR])


def anomalies(monthly: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation and the years off the regression line, per series."""
    flagged = residual_anomalies(scatter(monthly, rows, keys), keys, C.VALUE, "Recettes")
    return flagged.where(F.col("type anomalie") != C.ANOMALY_NORMAL).drop(
        "recettes_predites", "seuil"
    )


def quarters(selected: DataFrame, keys: list[str], value: str = C.VALUE) -> DataFrame:
    return quarters_with_year_total(selected, keys, value)


def heatmap(rows: DataFrame, keys: list[str]) -> DataFrame:
    return pivot_months(rows, keys)


def balance(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Receipts and expenses stacked in long form, with the balance of the year."""
    annual = with_balance(annual_sum(selected, keys, [C.RECEIPTS, C.EXPENSES]))
    return melt(annual, [*keys, C.YEAR, C.BALANCE], [C.RECEIPTS, C.EXPENSES], "Type", "Valeurs")


def components(rows: DataFrame, keys: list[str], columns: list[str], choice: str) -> DataFrame:
    """Annual sums of one chosen column, or of all when the choice is none of them."""
    return annual_sum(rows, keys, [choice] if choice in columns else columns)


def yoy(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Annual sums with the change to the previous year, its colour and its label."""
    out = pct_change(annual_sum(rows, keys, [column]), keys, column)
    return out.withColumn("color", sign_class(F.col("pct_change"))).withColumn(
        "label", pct_label("pct_change")
    )


def by_type(selected: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Annual sums of several columns in long form."""
    return melt(annual_sum(selected, keys, columns), [*keys, C.YEAR], columns, name, "Montant (USD)")


def annual_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    return annual_sum(rows, keys, [C.VALUE, C.RECEIPTS, C.EXPENSES, C.BALANCE])
