"""Projections, filters, joins, aggregates, windows, reshape, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from testbed.registry import query, rounded
from testbed.roles import (
    KEYS,
    annual,
    cents,
    centroids,
    indicator_units,
    indicators,
    mart,
    monthly,
    orders,
    shared,
    table,
    year_bounds,
)
from testbed.sqlparts import TOT, D, M, P, QT, V, Y, q, rnd, sql
from tidemark import constants as C
from tidemark.operators import filters, ranking, reshape, similar, stats
from tidemark.operators import monthly as mon
from tidemark.operators.lookup import lookup_join, unique_lookup
from tidemark.operators.embed import embedding_dims
from tidemark.operators.retrieve import contexts, knn
from tidemark.plans import reports
from tidemark.session import materialise

REC, EXP = q(C.RECEIPTS), q(C.EXPENSES)


# Projections --------------------------------------------------------------------


@query(
    "rename_cols",
    f"""SELECT o_orderkey AS id, o_orderpriority AS series, CAST(o_orderdate AS DATE) AS {D},
        o_totalprice AS {V} FROM orders""",
)
def rename_cols(spark, sf):
    names = {"o_orderkey": "id", "o_orderdate": C.DATE, "o_totalprice": C.VALUE}
    out = orders(spark, sf).withColumnsRenamed(names)
    return out.select("id", C.SERIES, F.col(C.DATE).cast("date").alias(C.DATE), C.VALUE)


@query("select_cols", "SELECT l_extendedprice, l_returnflag, l_orderkey, l_linenumber FROM lineitem")
def select_cols(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_extendedprice", "l_returnflag", "l_orderkey", "l_linenumber"
    )


@query(
    "balance",
    'SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_extendedprice * (1 - l_discount), 4) AS "Solde" FROM lineitem',
)
def balance(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnsRenamed({"l_extendedprice": C.RECEIPTS})
    rows = rows.withColumn(C.EXPENSES, F.col(C.RECEIPTS) * (1 - F.col("l_discount")))
    return rounded(mon.with_balance(rows), 4, C.BALANCE).select("l_orderkey", "l_linenumber", C.BALANCE)


@query(
    "monthly_share",
    sql(
        f"SELECT series, {D}, {Y}, {QT}, {M}, {V}, {rnd(TOT, 2)}, {rnd(P, 10)} FROM shared",
        "shared",
    ),
)
def monthly_share(spark, sf):
    out = rounded(rounded(shared(spark, sf), 2, C.TOTAL), 10, C.SHARE)
    return out.select(C.SERIES, C.DATE, C.YEAR, C.QUARTER, C.MONTH, C.VALUE, C.TOTAL, C.SHARE)


@query("weighted_value", sql(f"SELECT series, {D}, round({V} * {P}, 4) AS weighted FROM shared", "shared"))
def weighted_value(spark, sf):
    weighted = F.round(F.col(C.VALUE) * F.col(C.SHARE), 4).alias("weighted")
    return shared(spark, sf).select(C.SERIES, C.DATE, weighted)


@query(
    "tag_union",
    sql(
        f"""SELECT 'global' AS type, series, {Y}, {M}, {V}, CAST(NULL AS DOUBLE) AS "Solde" FROM monthly
        UNION ALL SELECT 'prévision arrivée', series, {Y}, NULL, round({V}, 2), NULL FROM annual
        UNION ALL SELECT 'prévision solde', NULL, {Y}, NULL, NULL, {REC} - {EXP} FROM indic""",
        "monthly", "annual", "indic",
    ),
)
def tag_union(spark, sf):
    tables = {
        C.DOC_TYPES["global"]: monthly(spark, sf).select(C.SERIES, C.YEAR, C.MONTH, C.VALUE),
        C.DOC_TYPES["arrivals"]: rounded(annual(spark, sf), 2, C.VALUE),
        C.DOC_TYPES["balance"]: mon.with_balance(indicators(spark, sf)).select(C.YEAR, C.BALANCE),
    }
    tagged = [df.withColumn("type", F.lower(F.lit(name))) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


@query(
    "metric_select",
    sql(
        f"""SELECT 'transport' AS choice, {Y}, {q(C.RECEIPTS_TRANSPORT)}, NULL::DOUBLE AS {q(C.RECEIPTS_TRAVEL)} FROM indic
        UNION ALL SELECT 'voyage', {Y}, NULL, {q(C.RECEIPTS_TRAVEL)} FROM indic
        UNION ALL SELECT 'les deux', {Y}, {q(C.RECEIPTS_TRANSPORT)}, {q(C.RECEIPTS_TRAVEL)} FROM indic""",
        "indic",
    ),
)
def metric_select(spark, sf):
    rows = indicators(spark, sf)
    both = [C.RECEIPTS_TRANSPORT, C.RECEIPTS_TRAVEL]
    choices = {"transport": both[0], "voyage": both[1], "les deux": "Les deux"}
    parts = [
        reports.components(rows, [], both, choice).withColumn("choice", F.lit(name))
        for name, choice in choices.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


_YOY = f"""SELECT series, {Y}, {V}, ({V} / nullif(lag({V}) OVER (PARTITION BY series ORDER BY {Y}), 0) - 1) * 100 AS ch FROM annual"""


@query(
    "sign_class",
    sql(
        f"""SELECT series, {Y}, CASE WHEN ch > 0 THEN 'green' WHEN ch < 0 THEN 'red' ELSE 'blue' END AS color
        FROM ({_YOY})""",
        "annual",
    ),
)
def sign_class(spark, sf):
    out = mon.pct_change(annual(spark, sf), KEYS, C.VALUE)
    return out.select(C.SERIES, C.YEAR, mon.sign_class(F.col("pct_change")).alias("color"))


@query(
    "yoy_pct",
    sql(f"SELECT series, {Y}, round({V}, 2) AS {V}, round(ch, 6) AS pct_change FROM ({_YOY})", "annual"),
)
def yoy_pct(spark, sf):
    out = mon.pct_change(annual(spark, sf), KEYS, C.VALUE)
    return rounded(rounded(out, 6, "pct_change"), 2, C.VALUE)


def _points(spark, sf):
    return reports.scatter(monthly(spark, sf), reports.filtered(mart(spark, sf)), KEYS)


@query(
    "residuals",
    sql(
        f'SELECT series, {Y}, round(fitted, 2) AS recettes_predites, round(gap, 2) AS "écart" FROM gaps',
        "gaps",
    ),
)
def residuals(spark, sf):
    out = stats.with_residuals(_points(spark, sf), KEYS, C.VALUE, "Recettes")
    return rounded(out.select(C.SERIES, C.YEAR, "recettes_predites", "écart"), 2, "recettes_predites", "écart")


@query("safe_totals", sql(f"SELECT round(sum({V}), 2) AS arrivees, 0.0::DOUBLE AS soldes FROM monthly", "monthly"))
def safe_totals(spark, sf):
    rows = monthly(spark, sf)
    return rows.agg(
        F.round(filters.total_or_zero(rows, C.VALUE), 2).alias("arrivees"),
        filters.total_or_zero(rows, C.BALANCE).alias("soldes"),
    )


# Filters ------------------------------------------------------------------------

_PIVOT = "SELECT series, {y}, {cells} FROM monthly GROUP BY 1, 2".format(
    y=Y,
    cells=", ".join(
        f"round(sum({V}) FILTER (WHERE {M} = '{m}'), 2) AS {q(m)}" for m in C.MONTHS
    ),
)


@query(
    "drop_all_null",
    sql(
        f"""SELECT * FROM ({_PIVOT}) WHERE coalesce("Sep", "Oct", "Nov", "Dec") IS NOT NULL""",
        "monthly",
    ),
)
def drop_all_null(spark, sf):
    wide = rounded(reshape.pivot_months(monthly(spark, sf), KEYS), 2, *C.MONTHS)
    return filters.drop_missing(wide, "all", ["Sep", "Oct", "Nov", "Dec"])


@query(
    "drop_any_null",
    sql(
        f"SELECT * FROM ({_PIVOT}) WHERE " + " AND ".join(f"{q(m)} IS NOT NULL" for m in C.MONTHS),
        "monthly",
    ),
)
def drop_any_null(spark, sf):
    return filters.drop_missing(rounded(reshape.pivot_months(monthly(spark, sf), KEYS), 2, *C.MONTHS))


@query(
    "year_range",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1998",
)
def year_range(spark, sf):
    return filters.date_years(table(spark, sf, "lineitem"), "l_shipdate", 1996, 1998).select(
        "l_orderkey", "l_linenumber"
    )


@query("year_cutoff", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <= 1998")
def year_cutoff(spark, sf):
    return filters.date_years(orders(spark, sf), "o_orderdate", hi=1998).select(
        "o_orderkey", "o_totalprice"
    )


@query("year_in", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1996, 1999)")
def year_in(spark, sf):
    return filters.date_year_in(orders(spark, sf), "o_orderdate", [1996, 1999]).select("o_orderkey")


@query(
    "validated_filter",
    """SELECT 'valid' AS kind, count(*) AS n, '[]' AS invalid, true AS ok FROM orders WHERE year(o_orderdate) IN (1996, 1997)
    UNION ALL SELECT 'unknown', count(*), '[1800]', true FROM orders
    UNION ALL SELECT 'format', count(*), '[]', false FROM orders
    UNION ALL SELECT 'empty', count(*), '[]', true FROM orders""",
)
def validated_filter(spark, sf):
    rows = orders(spark, sf).withColumn(C.YEAR, F.year("o_orderdate"))
    requests = {"valid": "1996, 1997", "unknown": "1800 1996", "format": "1996 x", "empty": " "}
    parts = []
    for kind, text in requests.items():
        kept, invalid, ok = filters.validated_filter(rows, C.YEAR, text)
        parts.append(
            kept.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(kind).alias("kind"), "n", F.lit(str(invalid)).alias("invalid"), F.lit(ok).alias("ok")
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "latest_period",
    "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)",
)
def latest_period(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", F.year("o_orderdate").alias(C.YEAR))
    return filters.latest_period(rows).select("o_orderkey")


# Joins --------------------------------------------------------------------------


@query(
    "left_join_annual",
    sql(
        f"""SELECT s.series, d AS {D}, round(a.{V}, 2) AS annual FROM (SELECT DISTINCT series FROM monthly) s
        CROSS JOIN (SELECT CAST(unnest(generate_series(make_date((SELECT min({Y}) FROM monthly), 1, 1),
            make_date((SELECT max({Y}) + 1 FROM monthly), 12, 1), INTERVAL 1 MONTH)) AS DATE) AS d)
        LEFT JOIN annual a ON a.series = s.series AND a.{Y} = year(d)""",
        "annual",
    ),
)
def left_join_annual(spark, sf):
    m = monthly(spark, sf)
    lo, hi = year_bounds(m)
    spine = reshape.calendar_spine(m.select(C.SERIES).distinct(), lo, hi + 1)
    totals = mon.annual_sum(m, KEYS, [C.VALUE]).withColumnRenamed(C.VALUE, "annual")
    out = spine.join(totals, [C.SERIES, C.YEAR], "left").select(C.SERIES, C.DATE, "annual")
    return rounded(out, 2, "annual")


@query(
    "inner_join_aggs",
    sql(
        f"""SELECT a.{Y}, round(a.v, 2) AS {V}, i.{REC} FROM (SELECT {Y}, sum({V}) AS v FROM monthly GROUP BY 1) a
        JOIN indic i ON a.{Y} = i.{Y}""",
        "monthly", "indic",
    ),
)
def inner_join_aggs(spark, sf):
    arrivals = rounded(mon.sum_by(monthly(spark, sf), [C.YEAR], [C.VALUE]), 2, C.VALUE)
    return arrivals.join(indicators(spark, sf).select(C.YEAR, C.RECEIPTS), C.YEAR)


@query(
    "quarter_with_year_total",
    sql(
        f"""SELECT series, {Y}, {QT}, round(x, 2) AS "Arrivees_x", round(sum(x) OVER (PARTITION BY series, {Y}), 2) AS "Arrivees_y"
        FROM (SELECT series, {Y}, {QT}, sum({V}) AS x FROM monthly GROUP BY 1, 2, 3)""",
        "monthly",
    ),
)
def quarter_with_year_total(spark, sf):
    out = mon.quarters_with_year_total(monthly(spark, sf), KEYS, C.VALUE)
    return rounded(out, 2, "Arrivees_x", "Arrivees_y")


@query(
    "indicator_lookup",
    sql(
        f"SELECT o_orderkey, {REC} FROM orders LEFT JOIN indic ON year(o_orderdate) = {Y}", "indic"
    ),
)
def indicator_lookup(spark, sf):
    dim = unique_lookup(indicators(spark, sf).select(C.YEAR, C.RECEIPTS), [C.YEAR])
    rows = orders(spark, sf).select("o_orderkey", F.year("o_orderdate").alias(C.YEAR))
    return lookup_join(rows, dim, [C.YEAR]).select("o_orderkey", C.RECEIPTS)


_WEIGHTS = f"SELECT series, {M}, avg({P}) AS w FROM shared WHERE {Y} <= 2000 GROUP BY 1, 2"


@query("seasonal_weights", sql(f"SELECT series, {M}, round(w, 10) AS {P} FROM ({_WEIGHTS})", "shared"))
def seasonal_weights(spark, sf):
    return rounded(mon.seasonal_weights(shared(spark, sf), KEYS, 2000), 10, C.SHARE)


@query(
    "weight_lookup",
    sql(
        f"""SELECT o_orderkey, round(w, 10) AS {P} FROM orders LEFT JOIN ({_WEIGHTS}) x
        ON o_orderpriority = series AND strftime(o_orderdate, '%b') = {M}""",
        "shared",
    ),
)
def weight_lookup(spark, sf):
    rows = orders(spark, sf).select(
        "o_orderkey", C.SERIES, F.date_format("o_orderdate", "MMM").alias(C.MONTH)
    )
    weights = mon.seasonal_weights(shared(spark, sf), KEYS, 2000)
    out = lookup_join(rows, weights, [C.SERIES, C.MONTH]).select("o_orderkey", C.SHARE)
    return rounded(out, 10, C.SHARE)


@query(
    "invalid_values",
    f"""SELECT DISTINCT 1990 + p_size AS {Y} FROM part
        WHERE 1990 + p_size NOT IN (SELECT year(o_orderdate) FROM orders)""",
)
def invalid_values(spark, sf):
    asked = table(spark, sf, "part").select((F.col("p_size") + 1990).alias(C.YEAR)).distinct()
    have = orders(spark, sf).select(F.year("o_orderdate").alias(C.YEAR))
    return filters.invalid_values(asked, have, C.YEAR)


def _knn_tables(spark, sf):
    docs = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )
    asked = centroids(spark, sf).select(
        F.col("label").alias("qid"), "vector", F.lit(C.DEFAULT_TOP_K).alias("k")
    )
    return docs, asked


def _knn(spark, sf):
    """The twenty vectors most like the mean of each label."""
    return knn(*_knn_tables(spark, sf))


@query("knn_topk", sql("SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM knn", "knn"))
def knn_topk(spark, sf):
    return rounded(_knn(spark, sf), 6, "score")


@query(
    "knn_lsh",
    sql("SELECT qid, count(*) AS hits, TRUE AS same_scores, TRUE AS recall_reached, TRUE AS fewer_pairs FROM knn GROUP BY 1", "knn"),
)
def knn_lsh(spark, sf):
    """The approximate search over all questions and vectors, held against the exact one: how many hits a
    question gets, whether each has its exact score, whether 0.9 of all exact hits are found, and with
    fewer pairs scored than there are."""
    docs, asked = _knn_tables(spark, sf)
    index = similar.fit_filters(docs, asked, recall=0.9, share=0.2)
    found = materialise(similar.knn_lsh(docs, asked, filters=index), "found")
    pairs = similar.candidates(docs, asked, index).count()
    both = materialise(found.join(knn(docs, asked).withColumnRenamed("score", "exact").drop("rank"), ["qid", "id"], "left"), "both")
    got, all_ = both.where("exact IS NOT NULL").count(), asked.agg(F.sum("k")).first()[0]
    return both.groupBy("qid").agg(
        F.count(F.lit(1)).alias("hits"),
        F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("exact")) < 1e-8, F.lit(True))).alias("same_scores"),
        F.lit(got >= 0.9 * all_).alias("recall_reached"),
        F.lit(pairs < docs.count() * asked.count()).alias("fewer_pairs"),
    )


@query(
    "context_concat",
    sql(
        r"""SELECT qid, string_agg('WBData : ' || trim(text, E' \t\n\r'), E'\n' ORDER BY rank) AS context
        FROM knn JOIN documents ON id = doc_id WHERE trim(text, E' \t\n\r') <> '' GROUP BY 1""",
        "knn",
    ),
)
def context_concat(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return contexts(_knn(spark, sf), texts)


# Aggregates ---------------------------------------------------------------------


@query("annual_sum", sql(f"SELECT series, {Y}, {rnd(V, 2)} FROM annual", "annual"))
def annual_sum(spark, sf):
    return rounded(annual(spark, sf), 2, C.VALUE)


@query(
    "quarterly_sum",
    f"""SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INTEGER) AS {Y}, CAST(quarter(o_orderdate) AS INTEGER) AS {QT},
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS {V} FROM orders GROUP BY 1, 2, 3""",
)
def quarterly_sum(spark, sf):
    rows = orders(spark, sf).select(
        C.SERIES,
        F.year("o_orderdate").alias(C.YEAR),
        F.quarter("o_orderdate").alias(C.QUARTER),
        cents("o_totalprice").alias(C.VALUE),
    )
    out = mon.quarterly_sum(rows, KEYS, [C.VALUE])
    return out.withColumn(C.VALUE, F.col(C.VALUE) / 100)


@query(
    "kpi_totals",
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS recettes,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS depenses
        FROM lineitem""",
)
def kpi_totals(spark, sf):
    units = indicator_units()
    return mon.exact_sums(
        table(spark, sf, "lineitem"), [], {"recettes": units["receipts"], "depenses": units["expenses"]}
    )


@query(
    "year_bounds",
    "SELECT CAST(min(year(l_shipdate)) AS INTEGER) AS first_year, CAST(max(year(l_shipdate)) AS INTEGER) AS last_year FROM lineitem",
)
def bounds(spark, sf):
    """Bounds of the dates, then their years: the scan can answer from file statistics."""
    return (
        table(spark, sf, "lineitem")
        .agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
        .select(F.year("lo").alias("first_year"), F.year("hi").alias("last_year"))
    )


@query("distinct_years", f"SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS {Y} FROM lineitem")
def distinct_years(spark, sf):
    return table(spark, sf, "lineitem").select(F.year("l_shipdate").alias(C.YEAR)).distinct()


@query(
    "pearson",
    "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY 1",
)
def pearson(spark, sf):
    out = stats.pearson(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(out, 6, "correlation")


@query(
    "ols_coeffs",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
        round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""",
)
def ols_coeffs(spark, sf):
    out = stats.ols(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(out, 4, "slope", "intercept")


@query("resid_std", sql("SELECT series, round(stddev_samp(gap), 2) AS seuil FROM gaps GROUP BY 1", "gaps"))
def resid_std(spark, sf):
    gaps = stats.with_residuals(_points(spark, sf), KEYS, C.VALUE, "Recettes")
    return rounded(gaps.groupBy(C.SERIES).agg(F.stddev_samp("écart").alias("seuil")), 2, "seuil")


@query(
    "mean_fill",
    """SELECT event_id, round(coalesce(CASE WHEN value >= 5 THEN value END,
        avg(CASE WHEN value >= 5 THEN value END) OVER (PARTITION BY event_type)), 6) AS value FROM events""",
)
def mean_fill(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("value") >= 5, F.col("value")).alias("value")
    )
    out = stats.fill_with_mean(rows, ["event_type"], "value")
    return rounded(out.select("event_id", "value"), 6, "value")


# Windows and ranks ----------------------------------------------------------------


@query(
    "year_total_window",
    f"""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderpriority, year(o_orderdate)) AS DOUBLE) AS {TOT}
        FROM orders""",
)
def year_total_window(spark, sf):
    """On raw rows, where one group may be huge: aggregate and join instead of a window."""
    rows = orders(spark, sf).select(
        "o_orderkey", C.SERIES, F.year("o_orderdate").alias(C.YEAR), cents("o_totalprice").alias("v")
    )
    out = mon.group_total(rows, [C.SERIES, C.YEAR], "v", C.TOTAL)
    return out.select("o_orderkey", (F.col(C.TOTAL) / 100).alias(C.TOTAL))


_LAGS = ", ".join(f"round(lag({V}, {i}) OVER w, 2) AS lag{i}" for i in (1, 2, 3))


@query(
    "lag_features",
    sql(
        f"SELECT series, {Y}, {rnd(V, 2)}, {_LAGS} FROM annual WINDOW w AS (PARTITION BY series ORDER BY {Y})",
        "annual",
    ),
)
def lag_features(spark, sf):
    return rounded(mon.with_lags(annual(spark, sf), KEYS), 2, C.VALUE, "lag1", "lag2", "lag3")


@query(
    "last_state",
    sql(
        f"""SELECT * FROM (SELECT series, {Y}, {rnd(V, 2)}, {_LAGS} FROM annual WINDOW w AS (PARTITION BY series ORDER BY {Y}))
        WHERE {Y} = (SELECT max({Y}) FROM annual)""",
        "annual",
    ),
)
def last_state(spark, sf):
    return rounded(mon.last_state(annual(spark, sf), KEYS), 2, C.VALUE, "lag1", "lag2", "lag3")


@query(
    "row_ids",
    "SELECT doc_id, source || '-' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id FROM documents",
)
def row_ids(spark, sf):
    return ranking.row_ids(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select(
        "doc_id", "id"
    )


@query(
    "row_ids_nulls",
    """SELECT l_orderkey, l_linenumber, concat_ws('-', nullif(l_returnflag, 'N'), row_number() OVER (
        PARTITION BY nullif(l_returnflag, 'N') ORDER BY l_orderkey * 10 + l_linenumber) - 1) AS id FROM lineitem""",
)
def row_ids_nulls(spark, sf):
    """A key that is null for half of all rows."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
    )
    return ranking.row_ids(rows, "flag", "at").select("l_orderkey", "l_linenumber", "id")


@query(
    "split_nulls",
    """SELECT k AS row_key, row_number() OVER (PARTITION BY flag ORDER BY md5('42|' || k), k) <= ceil(0.2 * count(*) OVER (PARTITION BY flag)) AS is_test
        FROM (SELECT nullif(l_returnflag, 'N') AS flag, l_orderkey * 10 + l_linenumber AS k FROM lineitem)""",
)
def split_nulls(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key")
    )
    return ranking.split_train_test(rows, ["flag"], ["row_key"]).select("row_key", "is_test")


@query(
    "train_test_split",
    sql(
        f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey)
            <= ceil(0.2 * count(*) OVER (PARTITION BY o_orderpriority)) AS is_test FROM orders"""
    ),
)
def train_test_split(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", C.SERIES)
    return ranking.split_train_test(rows, KEYS, ["o_orderkey"]).select("o_orderkey", "is_test")


@query(
    "dynamic_k",
    f"""WITH v AS (SELECT label, vec_id, 1995 + vec_id % 7 AS y, embedding[1] AS x FROM embeddings),
        k AS (SELECT label, CASE WHEN label = 0 THEN 20 ELSE max(y) - min(y) + 1 + label % 2 END AS k FROM v GROUP BY 1)
        SELECT * FROM (SELECT v.label, vec_id, CAST(row_number() OVER (PARTITION BY v.label ORDER BY x DESC, vec_id) AS INTEGER) AS rank,
            CAST(k AS INTEGER) AS k FROM v JOIN k ON v.label = k.label) WHERE rank <= k""",
)
def dynamic_k(spark, sf):
    """A range of years per label gives its k; odd labels carry a quarter filter, label 0 no range."""
    rows = table(spark, sf, "embeddings").select(
        "label", "vec_id", (F.lit(1995) + F.col("vec_id") % 7).cast("int").alias("y"),
        F.get("embedding", F.lit(0)).alias("x"),
    )
    span = F.array(F.struct(F.min("y").alias("lo"), F.max("y").alias("hi")))
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    asked = rows.groupBy("label").agg(span.alias("r")).select(
        "label",
        filters.derived_k_column(
            F.when(F.col("label") == 0, F.coalesce(none, F.array().cast("array<struct<lo:int,hi:int>>"))).otherwise(F.col("r")),
            (F.col("label") != 0) & (F.col("label") % 2 == 1),
        ).alias("k"),
    )
    order = [F.col("x").desc(), F.col("vec_id")]
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    return ranking.top_k(lookup_join(rows, asked, ["label"], "inner"), ["label"], order, F.col("k"), spread=spread).select(
        "label", "vec_id", "rank", "k"
    )


@query("embedding_dims", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions FROM embeddings ORDER BY vec_id LIMIT 3")
def dims(spark, sf):
    return embedding_dims(table(spark, sf, "embeddings"), "embedding", order="vec_id")


# Reshape, sort, sets ----------------------------------------------------------------


@query("heatmap_pivot", sql(_PIVOT, "monthly"))
def heatmap_pivot(spark, sf):
    return rounded(reshape.pivot_months(monthly(spark, sf), KEYS), 2, *C.MONTHS)


@query(
    "heatmap_long",
    sql(
        f"""SELECT s.series, s.{Y}, m.{M}, v.{V} FROM (SELECT DISTINCT series, {Y} FROM monthly) s
            CROSS JOIN (SELECT DISTINCT {M} FROM monthly) m
            LEFT JOIN monthly v ON v.series = s.series AND v.{Y} = s.{Y} AND v.{M} = m.{M}""",
        "monthly",
    ),
)
def heatmap_long(spark, sf):
    """The pivot melted back: a row for each month of each year, absent ones null."""
    return rounded(reshape.unpivot_pivoted(reshape.pivot_months(monthly(spark, sf), KEYS), KEYS), 2, C.VALUE)


@query("sorted_monthly", sql(f"SELECT series, {Y}, {D}, {V} FROM monthly ORDER BY {Y}, {D}, series", "monthly"))
def sorted_monthly(spark, sf):
    return monthly(spark, sf).select(C.SERIES, C.YEAR, C.DATE, C.VALUE).orderBy(C.YEAR, C.DATE, C.SERIES)


_SOURCES = f"""SELECT source, series, d AS {D}, v AS {V}, round(sum(v) OVER w, 2) AS {TOT}, round(v / sum(v) OVER w, 10) AS {P}
    FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'sheet' ELSE 'scrape' END AS source, o_orderpriority AS series,
            CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
          FROM orders GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY source, series, year(d))"""


def _sources(spark, sf):
    rows = orders(spark, sf)
    done = F.col("o_orderstatus") == "F"
    make = lambda part: mon.with_share(
        mon.monthly_totals(part, KEYS, "o_orderdate", F.col("o_totalprice"), decimals=2), KEYS
    )
    return {"sheet": make(rows.where(done)), "scrape": make(rows.where(~done))}


@query("union_sources", _SOURCES)
def union_sources(spark, sf):
    """Overlapping sources, shares taken in each before the union."""
    out = mon.union_sources(_sources(spark, sf), KEYS).select(
        C.SOURCE, C.SERIES, C.DATE, C.VALUE, C.TOTAL, C.SHARE
    )
    return rounded(rounded(out, 2, C.TOTAL), 10, C.SHARE)


@query(
    "union_preferred",
    f"""SELECT source, series, {D}, {V} FROM (SELECT *, row_number() OVER (PARTITION BY series, {D} ORDER BY source DESC) AS r
        FROM ({_SOURCES})) WHERE r = 1""",
)
def union_preferred(spark, sf):
    out = mon.union_sources(_sources(spark, sf), KEYS, prefer=["sheet", "scrape"])
    return out.select(C.SOURCE, C.SERIES, C.DATE, C.VALUE)


@query(
    "union_missing",
    sql(
        f"""SELECT series, {Y}, {D}, {V}, NULL::DOUBLE AS annual FROM monthly
        UNION ALL SELECT series, {Y}, NULL, NULL, round({V}, 2) FROM annual""",
        "annual",
    ),
)
def union_missing(spark, sf):
    rows = monthly(spark, sf).select(C.SERIES, C.YEAR, C.DATE, C.VALUE)
    totals = rounded(annual(spark, sf), 2, C.VALUE).withColumnRenamed(C.VALUE, "annual")
    return rows.unionByName(totals, allowMissingColumns=True)


# Seven years of whole cents give multiples of 1/2800: four decimals never sit on a tie.
_TREND = f"""SELECT series, CAST(y AS INTEGER) AS {Y}, slope * y + intercept AS v FROM (
    SELECT series, regr_slope({V}, {Y}) AS slope, regr_intercept({V}, {Y}) AS intercept,
        unnest(generate_series(max({Y}) + 1, max({Y}) + 4)) AS y FROM annual GROUP BY 1)"""


@query("trend_extrapolate", sql(f"SELECT series, {Y}, round(v, 4) AS {V} FROM ({_TREND})", "annual"))
def trend_extrapolate(spark, sf):
    return rounded(stats.trend(annual(spark, sf), KEYS, [C.VALUE], 4, noise=0), 4, C.VALUE)


@query(
    "history_future",
    sql(
        f"""SELECT series, {Y}, round({V}, 2) AS {V}, round({V}, 4) AS fitted FROM annual
        UNION ALL SELECT series, {Y}, NULL, round(v, 4) FROM ({_TREND})""",
        "annual",
    ),
)
def history_future(spark, sf):
    past = annual(spark, sf).withColumn("fitted", F.col(C.VALUE))
    future = stats.trend(past, KEYS, [C.VALUE], 4, noise=0).withColumnRenamed(C.VALUE, "fitted")
    out = mon.history_and_future(past, future, KEYS, C.VALUE, "fitted")
    return rounded(rounded(out, 2, C.VALUE), 4, "fitted")


@query(
    "anomaly_rows",
    sql(
        f"""SELECT series, {Y}, kind AS "type anomalie" FROM flagged WHERE kind <> 'Normal'""", "flagged"
    ),
)
def anomaly_rows(spark, sf):
    out = stats.residual_anomalies(_points(spark, sf), KEYS, C.VALUE, "Recettes")
    return out.where(F.col("type anomalie") != C.ANOMALY_NORMAL).select(C.SERIES, C.YEAR, "type anomalie")


@query(
    "residual_anomaly",
    sql(
        f"""SELECT series, {Y}, round({V}, 2) AS {V}, round("Recettes", 2) AS "Recettes", round(fitted, 2) AS recettes_predites,
            round(gap, 2) AS "écart", kind AS "type anomalie" FROM flagged""",
        "flagged",
    ),
)
def residual_anomaly(spark, sf):
    out = stats.residual_anomalies(_points(spark, sf), KEYS, C.VALUE, "Recettes").drop("seuil", "correlation")
    return rounded(out, 2, C.VALUE, "Recettes", "recettes_predites", "écart")
