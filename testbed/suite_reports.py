"""One query per dashboard element, and the annual-to-monthly operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed.registry import query, rounded
from testbed.roles import KEYS, annual, indicators, mart, monthly, shared
from testbed.sqlparts import IND, TOT, D, M, P, QT, V, Y, calendar, q, sql
from tidemark import constants as C
from tidemark.operators import disagg
from tidemark.operators import monthly as mon
from tidemark.plans import reports
from tidemark.plans.mart import read_mart, write_mart
from tidemark.session import materialise, shared_dir

# Years that are whole sum back to the indicator, which has four decimals: rounding to
# four is stable, rounding to two could sit on a tie.
ALL = [*C.INDICATORS, C.VALUE]


def _rows(spark, sf):
    return reports.filtered(mart(spark, sf))


def _stored_rows(spark, sf):
    """Written once, as the selections look at the table before they filter it."""
    return materialise(_rows(spark, sf), "mart")


def _sums(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"round(sum({q(c)}), {digits}) AS {q(c)}" for c in columns)


_KPI = {"arrivees": C.VALUE, "recettes": C.RECEIPTS, "depenses": C.EXPENSES, "soldes": C.BALANCE}


@query(
    "report_kpi_selected",
    sql(
        "SELECT "
        + ", ".join(f"format('{{:,.0f}}', sum({q(c)})) AS {n}" for n, c in _KPI.items())
        + f" FROM filt WHERE {Y} IN (1996, 1997, 1999)",
        "filt",
    ),
)
def report_kpi_selected(spark, sf):
    by_year, _, _ = reports.select_periods(_stored_rows(spark, sf), "1996, 1997 1999")
    return reports.kpis(by_year)


@query(
    "report_kpi_latest",
    sql(
        "SELECT "
        + ", ".join(f"replace(format('{{:,.0f}}', sum({q(c)})), ',', ' ') AS {n}" for n, c in _KPI.items())
        + f" FROM filt WHERE {Y} = (SELECT max({Y}) FROM filt)",
        "filt",
    ),
)
def report_kpi_latest(spark, sf):
    return reports.kpi_latest(_rows(spark, sf))


@query(
    "report_filtered",
    sql(
        f"SELECT series, {D}, {Y}, {QT}, {M}, "
        + ", ".join(f"round({q(c)}, 2) AS {q(c)}" for c in [*ALL, C.BALANCE])
        + f" FROM filt WHERE {Y} BETWEEN 1996 AND 2000",
        "filt",
    ),
)
def report_filtered(spark, sf):
    return rounded(reports.filtered(mart(spark, sf), 1996, 2000), 2, *ALL, C.BALANCE)


@query("report_scatter", sql(f'SELECT series, {Y}, round({V}, 2) AS {V}, round("Recettes", 2) AS "Recettes" FROM points', "points"))
def report_scatter(spark, sf):
    return rounded(reports.scatter(monthly(spark, sf), _rows(spark, sf), KEYS), 2, C.VALUE, "Recettes")


@query(
    "report_anomalies",
    sql(
        f"""SELECT f.series, {Y}, round({V}, 2) AS {V}, round("Recettes", 2) AS "Recettes", round(gap, 2) AS "écart",
            kind AS "type anomalie", round(r, 6) AS correlation FROM flagged f
        JOIN (SELECT series, corr({V}, "Recettes") AS r FROM points GROUP BY 1) c ON f.series = c.series
        WHERE kind <> 'Normal'""",
        "flagged",
    ),
)
def report_anomalies(spark, sf):
    out = reports.anomalies(monthly(spark, sf), _rows(spark, sf), KEYS)
    return rounded(rounded(out, 2, C.VALUE, "Recettes", "écart"), 6, "correlation")


def _quarters_sql(column: str) -> str:
    return f"""SELECT series, {Y}, {QT}, round(x, 2) AS {q(column + '_x')}, round(sum(x) OVER (PARTITION BY series, {Y}), 2) AS {q(column + '_y')}
        FROM (SELECT series, {Y}, {QT}, sum({q(column)}) AS x FROM filt WHERE {QT} IN (1, 2, 3) GROUP BY 1, 2, 3)"""


def _quarters(spark, sf, column):
    _, selected, _ = reports.select_periods(_stored_rows(spark, sf), "", "1, 2, 3")
    return rounded(reports.quarters(selected, KEYS, column), 2, f"{column}_x", f"{column}_y")


@query("report_quarters", sql(_quarters_sql(C.VALUE), "filt"))
def report_quarters(spark, sf):
    return _quarters(spark, sf, C.VALUE)


_A, _B = C.RECEIPTS_TRANSPORT, C.RECEIPTS_TRAVEL


@query(
    "report_receipts_quarters",
    sql(
        f"SELECT * FROM ({_quarters_sql(_A)}) JOIN ({_quarters_sql(_B)}) USING (series, {Y}, {QT})", "filt"
    ),
)
def report_receipts_quarters(spark, sf):
    """Transport and travel receipts in one pass over the mart."""
    _, selected, _ = reports.select_periods(_stored_rows(spark, sf), "", "1, 2, 3")
    out = mon.quarterly_sum(selected, KEYS, [_A, _B])
    out = mon.year_total(mon.year_total(out, KEYS, _A, f"{_A}_y"), KEYS, _B, f"{_B}_y")
    out = out.withColumnsRenamed({_A: f"{_A}_x", _B: f"{_B}_x"})
    return rounded(out, 2, *[f"{c}_{s}" for c in (_A, _B) for s in "xy"])


def _long_sql(columns: list[str], name: str, value: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT series, {Y}{extra}, '{c}' AS {q(name)}, round({q(c)}, 4) AS {q(value)} FROM y" for c in columns
    )


def _yearly(columns: list[str]) -> str:
    return f"WITH y AS (SELECT series, {Y}, " + ", ".join(
        f"sum({q(c)}) AS {q(c)}" for c in columns
    ) + f" FROM filt GROUP BY 1, 2) "


_BAL = f', round({q(C.RECEIPTS)} - {q(C.EXPENSES)}, 4) AS "Solde"'


@query(
    "report_balance",
    sql(_yearly([C.RECEIPTS, C.EXPENSES]) + _long_sql([C.RECEIPTS, C.EXPENSES], "Type", "Valeurs", _BAL), "filt"),
)
def report_balance(spark, sf):
    return rounded(reports.balance(_rows(spark, sf), KEYS), 4, C.BALANCE, "Valeurs")


def _components(name: str, columns: list[str]):
    """Annual sums of both components; a choice of one is a projection of it."""

    @query(name, sql(f"SELECT series, {Y}, {_sums(columns)} FROM filt GROUP BY 1, 2", "filt"))
    def run(spark, sf):
        return rounded(reports.components(_rows(spark, sf), KEYS, columns, "Les deux"), 4, *columns)


_components("report_receipts", [C.RECEIPTS_TRANSPORT, C.RECEIPTS_TRAVEL])
_components("report_expenses", [C.EXPENSES_TRANSPORT, C.EXPENSES_TRAVEL])


def _yoy(name: str, column: str):
    c = q(column)

    @query(
        name,
        sql(
            f"""SELECT series, {Y}, round(x, 4) AS {c}, round(ch, 6) AS pct_change,
                CASE WHEN ch > 0 THEN 'green' WHEN ch < 0 THEN 'red' ELSE 'blue' END AS color,
                printf('%.1f%%', ch) AS label
            FROM (SELECT series, {Y}, x, (x / nullif(lag(x) OVER (PARTITION BY series ORDER BY {Y}), 0) - 1) * 100 AS ch
                FROM (SELECT series, {Y}, sum({c}) AS x FROM filt GROUP BY 1, 2))""",
            "filt",
        ),
    )
    def run(spark, sf):
        out = reports.yoy(_rows(spark, sf), KEYS, column)
        return rounded(rounded(out, 4, column), 6, "pct_change")


_yoy("report_export_yoy", C.RECEIPTS_PCT)
_yoy("report_import_yoy", C.EXPENSES_PCT)


def _by_type(name: str, columns: list[str], label: str):
    @query(name, sql(_yearly(columns) + _long_sql(columns, label, "Montant (USD)"), "filt"))
    def run(spark, sf):
        return rounded(reports.by_type(_rows(spark, sf), KEYS, columns, label), 4, "Montant (USD)")


_by_type("report_expense_types", [C.EXPENSES_TRANSPORT, C.EXPENSES_TRAVEL], "Type de dépense")
_by_type("report_receipt_types", [C.RECEIPTS_TRANSPORT, C.RECEIPTS_TRAVEL], "Type de recette")


@query(
    "report_annual",
    sql(
        f"SELECT series, {Y}, {_sums([C.VALUE, C.RECEIPTS, C.EXPENSES, C.BALANCE])} FROM filt GROUP BY 1, 2",
        "filt",
    ),
)
def report_annual(spark, sf):
    cols = [C.VALUE, C.RECEIPTS, C.EXPENSES, C.BALANCE]
    return rounded(reports.annual_table(_rows(spark, sf), KEYS), 4, *cols)


@query(
    "report_stored_annual",
    sql(
        f"SELECT series, {Y}, {_sums([C.VALUE, C.RECEIPTS, C.EXPENSES, C.BALANCE])} FROM filt WHERE {Y} BETWEEN 1996 AND 1999 GROUP BY 1, 2",
        "filt",
    ),
)
def report_stored_annual(spark, sf):
    """The mart is written once and read back with its years pruned."""
    path = shared_dir(spark, "mart")
    write_mart(mart(spark, sf), path)
    cols = [C.VALUE, C.RECEIPTS, C.EXPENSES, C.BALANCE]
    return rounded(reports.annual_table(reports.filtered(read_mart(spark, path), 1996, 1999), KEYS), 4, *cols)


# Annual to monthly -------------------------------------------------------------------


@query(
    "seasonal_disagg",
    sql(
        f"""WITH w AS (SELECT series AS s, {M} AS mon, avg({P}) AS {P} FROM shared WHERE {Y} <= 1999 GROUP BY 1, 2),
        months AS (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS m),
        x AS (SELECT a.series, a.{Y}, make_date(a.{Y}, m, 1) AS {D}, w.{P}, a.{V} * w.{P} AS {V}
            FROM annual a CROSS JOIN months
            LEFT JOIN w ON w.s = a.series AND w.mon = strftime(make_date(a.{Y}, m, 1), '%b') WHERE a.{Y} > 1999)
        SELECT series, {D}, {calendar(D)}, round({P}, 10) AS {P}, round({V}, 2) AS {V},
            round(sum({V}) OVER (PARTITION BY series, {Y}), 2) AS {TOT} FROM x""",
        "shared", "annual",
    ),
)
def seasonal_disagg(spark, sf):
    """Years after the history, spread over months by the mean shares of the history."""
    weights = mon.seasonal_weights(shared(spark, sf), KEYS, 1999)
    given = annual(spark, sf).where(F.col(C.YEAR) > 1999)
    out = disagg.spread_annual(given, weights, KEYS)
    return rounded(rounded(out, 2, C.VALUE, C.TOTAL), 10, C.SHARE)


@query(
    "indicator_disagg",
    sql(
        f"SELECT series, {D}, " + ", ".join(f"round({c}, 4) AS {c}" for c in IND) + " FROM mart", "mart"
    ),
)
def indicator_disagg(spark, sf):
    out = disagg.spread_indicators(shared(spark, sf), indicators(spark, sf), C.INDICATORS)
    return rounded(out, 4, *C.INDICATORS).select(C.SERIES, C.DATE, *[f"`{c}`" for c in C.INDICATORS])
