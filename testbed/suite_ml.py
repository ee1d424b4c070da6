"""Forests, recursive forecasts and the forecast reports.

The oracle engine has no forests. Next to each query of fitted values, which the driver counts,
one shows what SQL can tell: rows, years and known values exactly, and whether every fitted
value lies between the smallest and the largest label, as a mean of labels must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testbed.registry import query, rounded
from testbed.roles import KEYS, SEGMENT_KEYS, indicators, mart, orders, segment_monthly
from testbed.sqlparts import D, IND, V, Y, q, sql
from tidemark import constants as C
from tidemark.operators import forecast as fc
from tidemark.operators import monthly as mon
from tidemark.operators.monthly import monthly_totals
from tidemark.plans import reports
from tidemark.plans.mart import build_monthly_mart

FIRST_TRAIN, LAST_TRAIN = 1998, 2000
#: Years forecast although 2001 is known, as after a gap in the sources.
GAP = [1999, 2000]
MISSING = [2002, 2003, 2004]
CUT = 1999
ARRIVALS, FITTED, BALANCE_FITTED = "Arrivées", "Prévision Arrivées", "Valeur"


def _history(spark, sf):
    """Annual values of every (priority, segment)."""
    return mon.annual_sum(segment_monthly(spark, sf), SEGMENT_KEYS, [C.VALUE], decimals=2)


def _train_rows(rows: DataFrame) -> DataFrame:
    lagged = mon.with_lags(rows, SEGMENT_KEYS).na.drop(subset=[C.VALUE, *fc.LAGS])
    return lagged.where(F.col(C.YEAR).between(FIRST_TRAIN, LAST_TRAIN))


def _inside(values: DataFrame, value: str, labels: DataFrame, label: str) -> DataFrame:
    """Add the range of the labels, and whether the value lies in it."""
    span = labels.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    slack = 1e-9 * max(abs(span["low"]), abs(span["high"]))
    value = F.col(f"`{value}`")
    return values.withColumns({
        "low": F.lit(span["low"]), "high": F.lit(span["high"]),
        "inside": value.isNull() | value.between(span["low"] - slack, span["high"] + slack),
    })


_SEGMENT_YEARS = f"""SELECT series, segment, {Y}, CAST(sum(CAST({V} AS DECIMAL(18,2))) AS DOUBLE) AS {V} FROM segments GROUP BY 1, 2, 3"""
_LAGGED = f"""SELECT *, {', '.join(f'lag({V}, {i}) OVER (PARTITION BY series, segment ORDER BY {Y}) AS lag{i}' for i in (1, 2, 3))}
    FROM ({_SEGMENT_YEARS})"""
_TRAIN = f"SELECT * FROM ({_LAGGED}) WHERE {Y} BETWEEN {FIRST_TRAIN} AND {LAST_TRAIN} AND lag3 IS NOT NULL"


@query("rf_lag_train_rows", sql(_TRAIN, "segments"))
def rf_lag_train_rows(spark, sf):
    """The rows that the lag forest is trained on."""
    return _train_rows(_history(spark, sf))


@query("rf_lag_fit")
def rf_lag_fit(spark, sf):
    """Fitted values of the lag forest beside all rows with three known years before."""
    rows = _history(spark, sf)
    model = fc.fit_lag_forest(rows, SEGMENT_KEYS, FIRST_TRAIN, LAST_TRAIN)
    lagged = mon.with_lags(rows, SEGMENT_KEYS).na.drop(subset=fc.LAGS)
    out = fc.predict(model, lagged, fc.LAGS, "fitted").select(*SEGMENT_KEYS, C.YEAR, C.VALUE, "fitted")
    return rounded(out, 2, C.VALUE, "fitted")


@query(
    "forest_exact",
    sql(f"SELECT series, segment, {Y}, round({V}, 2) AS {V}, round({V}, 2) AS fitted FROM ({_TRAIN})", "segments"),
)
def forest_exact(spark, sf):
    """One tree of full depth without bootstrap gives back the labels of rows whose inputs differ."""
    rows = _train_rows(_history(spark, sf))
    train = fc.training_frame(rows, fc.LAGS, [C.VALUE], [*SEGMENT_KEYS, C.YEAR])
    model = fc.fit_forest(train, fc.LAGS, C.VALUE, trees=1, bootstrap=False)
    out = fc.predict(model, rows, fc.LAGS, "fitted").select(*SEGMENT_KEYS, C.YEAR, C.VALUE, "fitted")
    return rounded(out, 2, C.VALUE, "fitted")


ORIGINS = [1998, 1999, 2000]


@query(
    "forecast_holdout",
    sql(
        f"WITH lagged AS ({_LAGGED}) " + " UNION ALL ".join(
            f"""SELECT a.series, a.segment, a.{Y}, {o} AS origin, round(a.{V}, 2) AS actual, round(a.lag1, 2) AS last,
                round(t.slope * {o + 1} + t.intercept, 4) AS trend, round(abs(a.lag1 - a.{V}), 2) AS last_error,
                round(abs(t.slope * {o + 1} + t.intercept - a.{V}), 4) AS trend_error FROM lagged a LEFT JOIN (
                    SELECT series, segment, regr_slope({V}, {Y}) AS slope, regr_intercept({V}, {Y}) AS intercept
                    FROM lagged WHERE {Y} <= {o} GROUP BY 1, 2) t ON t.series = a.series AND t.segment = a.segment
                WHERE a.{Y} = {o + 1}"""
            for o in ORIGINS
        ),
        "segments",
    ),
)
def forecast_holdout(spark, sf):
    """Forecasts of one year from three origins: errors of the trend and of the last value. Those of
    the forest, which SQL can't tell, are in ``forecast_holdout_errors``."""
    out = fc.rolling_holdout(_history(spark, sf), SEGMENT_KEYS, ORIGINS).drop("forest", "forest_error")
    # A trend of a few years of cents often ends in half a cent: four digits, so that it isn't rounded there.
    return rounded(rounded(out, 2, "actual", "last", "last_error"), 4, "trend", "trend_error")


@query("forecast_holdout_errors")
def forecast_holdout_errors(spark, sf):
    """Mean absolute error of each way, over all series of an origin."""
    out = fc.rolling_holdout(_history(spark, sf), SEGMENT_KEYS, ORIGINS)
    means = [F.round(F.avg(f"{how}_error"), 2).alias(f"{how}_error") for how in ("forest", "trend", "last")]
    return out.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), *means)


def _recursive(spark, sf):
    """Both ways to start: from the last row, after the gap, and from the last year before it."""
    rows = _history(spark, sf)
    model = fc.fit_lag_forest(rows, SEGMENT_KEYS, FIRST_TRAIN, LAST_TRAIN)
    parts = [
        fc.recursive_forecast(model, rows, SEGMENT_KEYS, GAP, seed_from=how).withColumn("seed_from", F.lit(how))
        for how in ("last_row", "before_gap")
    ]
    return parts[0].unionByName(parts[1]), rows


@query("recursive_forecast")
def recursive_forecast(spark, sf):
    return rounded(_recursive(spark, sf)[0], 2, C.VALUE)


@query(
    "recursive_forecast_checked",
    sql(
        f"""WITH train AS ({_TRAIN}), known AS (SELECT DISTINCT series, segment FROM segments)
            SELECT series, segment, {Y}, seed_from, (SELECT min({V}) FROM train) AS low, (SELECT max({V}) FROM train) AS high, TRUE AS inside
            FROM known CROSS JOIN (SELECT CAST(unnest([{GAP[0]}, {GAP[1]}]) AS INTEGER) AS {Y})
            CROSS JOIN (SELECT unnest(['last_row', 'before_gap']) AS seed_from)""",
        "segments",
    ),
)
def recursive_forecast_checked(spark, sf):
    out, rows = _recursive(spark, sf)
    return _inside(out, C.VALUE, _train_rows(rows), C.VALUE).drop(C.VALUE)


def _extended(spark, sf):
    return fc.extend_indicators(mart(spark, sf), C.INDICATORS, KEYS, CUT)


@query("indicator_extend")
def indicator_extend(spark, sf):
    return rounded(_extended(spark, sf), 4, *C.INDICATORS)


@query(
    "indicator_extend_checked",
    sql(
        f"""SELECT series, {D}, {Y}, {', '.join(f'CASE WHEN {Y} <= {CUT} THEN round({c}, 4) END AS {c}' for c in IND)},
            TRUE AS inside FROM mart""",
        "mart",
    ),
)
def indicator_extend_checked(spark, sf):
    """Values up to the cut; after it, whether all lie in the range of the values up to it."""
    past = mart(spark, sf).where(F.col(C.YEAR) <= CUT).where(F.col(C.VALUE).isNotNull())
    spans = [f(f"`{c}`") for c in C.INDICATORS for f in (F.min, F.max)]
    spans = past.agg(*spans).first()
    inside = F.lit(True)
    for i, c in enumerate(C.INDICATORS):
        lo, hi = spans[2 * i], spans[2 * i + 1]
        slack = 1e-9 * max(abs(lo), abs(hi))
        inside = inside & (F.col(f"`{c}`").isNull() | F.col(f"`{c}`").between(lo - slack, hi + slack))
    known = F.col(C.YEAR) <= CUT
    shown = {c: F.when(known, F.round(f"`{c}`", 4)) for c in C.INDICATORS}
    out = _extended(spark, sf).withColumn("inside", known | inside).withColumns(shown)
    return out.select(*KEYS, C.DATE, C.YEAR, *[f"`{c}`" for c in C.INDICATORS], "inside")


def _years_sql(value: str, actual: str, digits: int = 2) -> str:
    """History, then four years after the last of the series; the range of all labels."""
    return f"""WITH a AS (SELECT series, {Y}, {value} AS v FROM filt GROUP BY 1, 2)
        SELECT series, {Y}, v AS {q(actual)}, (SELECT min(v) FROM a) AS low, (SELECT max(v) FROM a) AS high, TRUE AS inside FROM (
            SELECT series, {Y}, round(v, {digits}) AS v FROM a UNION ALL
            SELECT series, CAST(unnest(generate_series(max({Y}) + 1, max({Y}) + 4)) AS INTEGER), NULL FROM a GROUP BY 1)"""


_ARRIVALS_SQL = f"CAST(sum(CAST({V} AS DECIMAL(18,2))) AS DOUBLE)"
_BALANCE_SQL = f"sum({q(C.RECEIPTS)}) - sum({q(C.EXPENSES)})"


@query("forecast_4y")
def forecast_4y(spark, sf):
    out = fc.forecast_arrivals(reports.filtered(mart(spark, sf)), KEYS)
    return rounded(out, 2, ARRIVALS, FITTED)


@query("forecast_4y_checked", sql(_years_sql(_ARRIVALS_SQL, ARRIVALS).replace("(SELECT min(v)", "(SELECT round(min(v), 2)").replace("(SELECT max(v)", "(SELECT round(max(v), 2)"), "filt"))
def forecast_4y_checked(spark, sf):
    out = fc.forecast_arrivals(reports.filtered(mart(spark, sf)), KEYS)
    checked = _inside(out, FITTED, out.where(F.col(ARRIVALS).isNotNull()), ARRIVALS).drop(FITTED)
    return rounded(checked, 2, ARRIVALS, "low", "high")


@query("forecast_balance_4y")
def forecast_balance_4y(spark, sf):
    out = fc.forecast_balance(reports.filtered(mart(spark, sf)), KEYS)
    return rounded(out, 2, C.BALANCE, BALANCE_FITTED)


@query("forecast_balance_4y_checked", sql(_years_sql(_BALANCE_SQL, C.BALANCE, 4).replace("(SELECT min(v)", "(SELECT round(min(v), 4)").replace("(SELECT max(v)", "(SELECT round(max(v), 4)"), "filt"))
def forecast_balance_4y_checked(spark, sf):
    out = fc.forecast_balance(reports.filtered(mart(spark, sf)), KEYS)
    checked = _inside(out, BALANCE_FITTED, out.where(F.col(C.BALANCE).isNotNull()), C.BALANCE).drop(BALANCE_FITTED)
    return rounded(checked, 4, C.BALANCE, "low", "high")  # balances have four decimals, so none lies between two


@query(
    "forecast_filtered",
    sql(
        f"""SELECT series, {Y}, round(CAST(sum(CAST({V} AS DECIMAL(18,2))) AS DOUBLE), 2) AS {q(ARRIVALS)} FROM filt WHERE {Y} <= 1999 GROUP BY 1, 2
            UNION ALL SELECT series, CAST(unnest(generate_series(top + 1, top + 4)) AS INTEGER), NULL
            FROM (SELECT DISTINCT series FROM filt WHERE {Y} <= 1999) CROSS JOIN (SELECT max({Y}) AS top FROM mart)""",
        "filt",
    ),
)
def forecast_filtered(spark, sf):
    """A range of years is selected, yet the forecast begins after the last year of the whole table."""
    table = mart(spark, sf)
    last = table.agg(F.max(C.YEAR)).first()[0]
    out = fc.forecast_arrivals(reports.filtered(table, 1995, 1999), KEYS, last_year=last, trees=40)
    return rounded(out.drop(FITTED), 2, ARRIVALS)


def _mart(spark, sf):
    """The whole pipeline: two sources, three missing years, indicators extended."""
    done = F.col("o_orderstatus") == "F"
    known = orders(spark, sf)
    sources = {
        name: monthly_totals(part, KEYS, "o_orderdate", F.col("o_totalprice"), decimals=2)
        for name, part in {"sheet": known.where(done), "scrape": known.where(~done)}.items()
    }
    return build_monthly_mart(
        sources, indicators(spark, sf), KEYS, FIRST_TRAIN, LAST_TRAIN, MISSING, LAST_TRAIN + 1
    )


@query("monthly_mart")
def monthly_mart(spark, sf):
    return rounded(_mart(spark, sf), 4, *C.INDICATORS, C.VALUE)


@query(
    "monthly_mart_known",
    f"""SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS {D}, CAST(year(o_orderdate) AS INTEGER) AS {Y},
        round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS {V} FROM orders GROUP BY 1, 2, 3, o_orderstatus = 'F'""",
)
def monthly_mart_known(spark, sf):
    """All months of the mart that are not forecast, once per source."""
    out = _mart(spark, sf).where(~F.col(C.YEAR).isin(MISSING))
    return rounded(out.select(*KEYS, C.DATE, C.YEAR, C.VALUE), 2, C.VALUE)
