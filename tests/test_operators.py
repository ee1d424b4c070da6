"""Operators on small frames: the edge cases and options of the data model."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import disagg, filters, lookup, ranking, reshape, stats
from tidemark.operators import monthly as mon
from tidemark.plans import reports

S = [C.SERIES]


def months(spark, rows):
    """Rows of (series, date text, value)."""
    data = [(s, dt.date.fromisoformat(d), v) for s, d, v in rows]
    df = spark.createDataFrame(data, f"series string, {C.DATE} date, {C.VALUE} double")
    from tidemark.functions.calendar import with_calendar

    return with_calendar(df)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)


def test_share_skips_missing_and_zero_totals(spark):
    df = months(
        spark,
        [("a", "2020-01-01", 1.0), ("a", "2020-02-01", 3.0), ("a", "2020-03-01", None),
         ("b", "2020-01-01", 0.0), ("c", "2020-01-01", None), ("d", "2020-01-01", float("nan"))],
    )
    out = mon.with_share(df, S)
    got = rows(out.where("series in ('a','b','c')"), "series", C.TOTAL, C.SHARE)
    assert got == sorted(
        [("a", 4.0, 0.25), ("a", 4.0, 0.75), ("a", 4.0, None), ("b", 0.0, None), ("c", 0.0, None)], key=str
    )
    assert out.where("series = 'd'").first()[C.TOTAL] == 0.0


def test_annual_sum_of_missing_values_and_keys(spark):
    df = months(spark, [("a", "2020-01-01", None), ("a", "2021-01-01", 2.0), (None, "2021-01-01", 5.0)])
    assert rows(mon.annual_sum(df, S, [C.VALUE]), "series", C.YEAR, C.VALUE) == [("a", 2020, 0.0), ("a", 2021, 2.0)]


def test_exact_sums_do_not_depend_on_layout(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 100_000 / 100).alias("x")
    )
    want = rows(df.groupBy("k").agg((F.sum(F.rint(F.col("x") * 100).cast("long")) / 100).alias("s")), "k", "s")
    for n in (1, 7):
        out = mon.exact_sums(df.repartition(n), ["k"], {"s": (F.col("x"), 2)})
        assert rows(out, "k", "s") == want


def test_exact_sums_of_the_largest_values(spark):
    """Past 9.2e18 units, with both signs, and without keys."""
    big = 9.0e14
    df = spark.createDataFrame([(big, 1)] * 40_000 + [(-2.5, 2)] * 3, "x double, k int")
    assert rows(mon.exact_sums(df, ["k"], {"s": (F.col("x"), 4)}), "k", "s") == [(1, 3.6e19), (2, -7.5)]
    assert mon.exact_sums(df, [], {"s": (F.col("x"), 4)}).first()["s"] == 3.6e19
    assert mon.exact_sums(df.where("k = 3"), ["k"], {"s": (F.col("x"), 2)}).count() == 0


def test_sources_are_kept_or_ranked(spark):
    a = mon.with_share(months(spark, [("s", "2020-01-01", 1.0), ("s", "2020-02-01", 1.0)]), S)
    b = mon.with_share(months(spark, [("s", "2020-01-01", 5.0)]), S)
    both = mon.union_sources({"a": a, "b": b}, S)
    assert rows(both, C.SOURCE, C.SHARE) == [("a", 0.5), ("a", 0.5), ("b", 1.0)]
    first = mon.union_sources({"a": a, "b": b}, S, prefer=["b"])
    assert rows(first, C.SOURCE, C.MONTH) == [("a", "Feb"), ("b", "Jan")]


def test_pivot_cells_and_round_trip(spark):
    df = months(spark, [("a", "2020-01-01", 2.0), ("a", "2020-01-01", 3.0), ("a", "2020-02-01", None)])
    wide = reshape.pivot_months(df, S)
    row = wide.first()
    assert (row["Jan"], row["Feb"], row["Mar"]) == (5.0, 0.0, None)
    full = months(spark, [("a", f"2020-{m:02d}-01", float(m)) for m in range(1, 13)])
    back = reshape.unpivot_pivoted(reshape.pivot_months(full, S), S)
    assert rows(back, "series", C.YEAR, C.MONTH, C.VALUE) == rows(full, "series", C.YEAR, C.MONTH, C.VALUE)


def test_wide_sheet(spark):
    df = spark.createDataFrame(
        [("x", "1 234,5", "7", "t")], "id string, `janv. 2015` string, `FÉVR 2015` string, note string"
    )
    assert list(reshape.month_headers(df)) == ["janv. 2015", "FÉVR 2015"]
    assert rows(reshape.unpivot_months(df), "id", "note", C.YEAR, C.MONTH, C.VALUE) == [
        ("x", "t", 2015, "Feb", 7.0), ("x", "t", 2015, "Jan", 1234.5),
    ]


def test_calendar_spine(spark):
    out = reshape.calendar_spine(spark.createDataFrame([("a",), ("b",)], "series string"), 2019, 2020)
    assert out.count() == 48
    assert rows(out.where("series = 'a'").groupBy(C.QUARTER).count(), C.QUARTER, "count") == [
        (q, 6) for q in (1, 2, 3, 4)
    ]


def test_validated_filter(spark):
    df = spark.createDataFrame([(2012,), (2013,), (2014,)], f"`{C.YEAR}` int")
    check = lambda text: filters.validated_filter(df, C.YEAR, text)
    assert (check("")[0].count(), *check("")[1:]) == (3, [], True)
    assert (check("2012, 2013")[0].count(), *check("2012, 2013")[1:]) == (2, [], True)
    assert (check("2012 x")[0].count(), *check("2012 x")[1:]) == (3, [], False)
    assert (check("1800")[0].count(), *check("1800")[1:]) == (3, [1800], True)


def test_latest_period(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], f"series string, `{C.YEAR}` int")
    assert rows(filters.latest_period(df), "series", C.YEAR) == [("a", 2)]
    assert rows(filters.latest_period(df, keys=S), "series", C.YEAR) == [("a", 2), ("b", 1)]


def test_metadata_predicate(spark):
    df = spark.createDataFrame(
        [("wbdata", 2010.0, "prévision arrivée"), ("wbdata", 2012.0, "global"), ("other", 2010.0, "global")],
        f"source string, `{C.YEAR}` double, type string",
    ).select(F.struct("source", C.YEAR, "type").alias("metadata"))
    count = lambda *a, **k: df.where(filters.metadata_predicate(*a, **k)).count()
    assert count([]) == 2
    assert count([(2009, 2011, "Prévision arrivée")]) == 1
    assert count([(2009, 2011, "Prévision arrivée")], fold_type=False) == 0
    assert count([(2009, 2011, "Prévision arrivée"), (2012, 2012, "global")]) == 2


def test_derived_k():
    assert filters.derived_k(years=(2010, 2014)) == 5
    assert filters.derived_k() == 20
    assert filters.derived_k(years=(2010, 2014), k=3) == 3
    assert filters.derived_k(years=(2010, 2011), quarters=(1, 2)) == 5


def test_missing_columns_total_zero(spark):
    df = spark.createDataFrame([(1.0,), (2.5,)], f"{C.VALUE} double")
    out = df.agg(filters.total_or_zero(df, C.VALUE).alias("a"), filters.total_or_zero(df, "nope").alias("b"))
    assert tuple(out.first()) == (3.5, 0.0)


def test_lags_and_changes(spark):
    df = spark.createDataFrame(
        [("a", y, v) for y, v in [(2019, 1.0), (2023, 2.0), (2024, 0.0), (2025, 4.0)]],
        f"series string, `{C.YEAR}` int, {C.VALUE} double",
    )
    state = mon.last_state(df, S).first()
    assert (state[C.YEAR], state[C.VALUE], state["lag1"], state["lag2"], state["lag3"]) == (2025, 4.0, 0.0, 2.0, 1.0)
    change = mon.pct_change(df, S, C.VALUE)
    assert [r["pct_change"] for r in change.orderBy(C.YEAR).collect()] == [None, 100.0, -100.0, None]
    colours = change.withColumn("c", mon.sign_class(F.col("pct_change"))).orderBy(C.YEAR)
    assert [r["c"] for r in colours.collect()] == ["blue", "green", "red", "blue"]


def test_spread_annual(spark):
    weights = spark.createDataFrame(
        [("a", m, 0.1) for m in C.MONTHS], f"series string, {C.MONTH} string, {C.SHARE} double"
    )
    annual = spark.createDataFrame([("a", 2020, 100.0)], f"series string, `{C.YEAR}` int, {C.VALUE} double")
    out = disagg.spread_annual(annual, weights, S)
    assert out.count() == 12
    assert out.agg(F.sum(C.VALUE)).first()[0] == pytest.approx(120.0)
    assert out.first()[C.TOTAL] == pytest.approx(120.0)
    for keys in (S, []):
        whole = disagg.spread_annual(annual.select(*keys, C.YEAR, C.VALUE), weights.select(*keys, C.MONTH, C.SHARE), keys, renormalise=True)
        assert whole.agg(F.sum(C.VALUE)).first()[0] == pytest.approx(100.0)
    unnamed = [df.withColumn("series", F.lit(None).cast("string")) for df in (annual, weights)]
    with_null = disagg.spread_annual(*unnamed, S, renormalise=True)
    assert with_null.count() == 12


def test_lookup_needs_unique_keys(spark):
    dim = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k int, v double")
    with pytest.raises(Exception, match="duplicate key"):
        lookup.unique_lookup(dim, ["k"]).collect()
    assert rows(lookup.unique_lookup(dim.where("k = 2"), ["k"]), "k", "v") == [(2, 1.0)]


def test_trend(spark):
    df = spark.createDataFrame(
        [("a", y, 2.0 * y) for y in (2000, 2001, 2003)], f"series string, `{C.YEAR}` int, v double"
    )
    got = rows(stats.trend(df, S, ["v"], 2, noise=0), C.YEAR, "v")
    assert [(y, round(v, 6)) for y, v in got] == [(2004, 4008.0), (2005, 4010.0)]
    noisy = [r["v"] for r in stats.trend(df, S, ["v"], 2, noise=0.5, seed=1).orderBy(C.YEAR).collect()]
    assert all(abs(a - b) <= 0.5 for a, b in zip(noisy, (4008.0, 4010.0)))
    missing = df.unionByName(spark.createDataFrame([("a", 2004, None)], df.schema))
    with pytest.raises(Exception, match="missing values in v"):
        stats.trend(missing, S, ["v"]).collect()


def test_residual_anomalies_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(100, 200, 30)
    y = 3 * x + 5 + rng.normal(0, 10, 30)
    df = spark.createDataFrame(
        [("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "series string, i int, x double, y double"
    )
    got = stats.residual_anomalies(df, S, "x", "y").orderBy("i").collect()
    m, b = np.polyfit(x, y, 1)
    gap = y - (m * x + b)
    s = gap.std(ddof=1)
    want = np.where(gap < -s, C.ANOMALY_LOW, np.where(gap > s, C.ANOMALY_HIGH, C.ANOMALY_NORMAL))
    assert [r["type anomalie"] for r in got] == list(want)
    assert np.allclose([r["écart"] for r in got], gap)
    assert got[0]["correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_mean_fill(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "series string, v double")
    assert rows(stats.fill_with_mean(df, S, "v"), "series", "v") == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None)]


def hot(spark, n=3000):
    """A third of all rows in one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(n).select(key.alias("k"), ((F.col("id") * 7919) % 10007).alias("o"), "id")


def test_spread_row_number_equals_row_number(spark):
    df = hot(spark)
    order = [F.col("o"), F.col("id")]
    out = ranking.spread_row_number(df, ["k"], order, "rn", total="n")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert rows(out, "k", "id", "rn") == rows(want, "k", "id", "rn")
    assert out.where("k = 'hot'").first()["n"] == 1000


def test_spread_row_number_keeps_nulls_and_ties(spark):
    """Null keys, null and tying order values, text as order key, repeated rows, no rows."""
    data = [(None, "b"), (None, None), ("x", "b"), ("x", "b"), ("x", None), ("x", "a"), ("y", "z")]
    df = spark.createDataFrame(data, "k string, o string")
    for part in (df, df.repartition(5), df.where("false")):
        out = ranking.spread_row_number(part, ["k"], [F.col("o")], "rn")
        want = part.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")))
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    ids = sorted(str(r["id"]) for r in ranking.row_ids(df, "k", "o").collect())
    assert ids == ["0", "1", "x-0", "x-1", "x-2", "x-3", "y-0"]


def test_row_ids(spark):
    out = ranking.row_ids(hot(spark), "k", "id")
    got = [r["id"] for r in out.where("k = 'hot'").collect()]
    assert sorted(got) == sorted(f"hot-{i}" for i in range(1000))


def test_split_of_many_buckets_keeps_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 4)
    df = hot(spark, 900).withColumn("k", F.nullif(F.col("k"), F.lit("k1")))
    order = [F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))), F.col("id")]
    w = Window.partitionBy("k")
    limit = F.ceil(F.count("*").over(w) * F.lit(0.2))
    want = df.withColumn("is_test", F.row_number().over(w.orderBy(*order)) <= limit)
    assert rows(ranking.split_train_test(df, ["k"], ["id"]), "id", "is_test") == rows(want, "id", "is_test")
    alone = ranking.split_train_test(df, [], ["id"])
    assert alone.count() == 900 and alone.where("is_test").count() == 180


def test_series_without_keys(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert rows(stats.fill_with_mean(df, [], "v"), "v") == [(1.0,), (2.0,), (3.0,)]


def test_split_has_exact_sizes(spark):
    out = ranking.split_train_test(hot(spark), ["k"], ["id"])
    sizes = out.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert all(r["t"] == -(-r["n"] // 5) for r in sizes)
    again = ranking.split_train_test(hot(spark).repartition(7), ["k"], ["id"])
    assert rows(out, "id", "is_test") == rows(again, "id", "is_test")


def test_top_k_spread(spark):
    df, order = hot(spark), [F.col("o").desc(), F.col("id")]
    plain = ranking.top_k(df, ["k"], order, 5)
    spread = ranking.top_k(df, ["k"], order, 5, spread=F.pmod(F.xxhash64("id"), F.lit(4)))
    assert rows(plain, "k", "id", "rank") == rows(spread, "k", "id", "rank")


def test_group_total_on_hot_key(spark):
    out = mon.group_total(hot(spark), ["k"], "o", "t")
    want = hot(spark).withColumn("t", F.sum("o").over(Window.partitionBy("k")))
    assert rows(out, "id", "t") == rows(want, "id", "t")


def test_report_choice_and_periods(spark):
    df = months(spark, [("a", "2020-01-01", 1.0), ("a", "2020-05-01", 2.0), ("a", "2021-01-01", 4.0)])
    by_year, selected, messages = reports.select_periods(df, "2020", "2")
    assert (by_year.count(), selected.count(), messages["years_ok"]) == (2, 1, True)
    _, unfiltered, messages = reports.select_periods(df, "1999", "9")
    assert unfiltered.count() == 3
    assert (messages["invalid_years"], messages["invalid_quarters"]) == ([1999], [9])
    df = df.withColumn("b", F.lit(1.0))
    assert reports.components(df, S, [C.VALUE, "b"], "b").columns == ["series", C.YEAR, "b"]
    assert reports.components(df, S, [C.VALUE, "b"], "Les deux").columns == ["series", C.YEAR, C.VALUE, "b"]


def test_years_of_dates(spark):
    df = spark.sql("SELECT explode(sequence(DATE'1995-12-31', DATE'1999-01-01', INTERVAL 1 DAY)) AS d")
    assert filters.date_year_in(df, "d", [1996, 1998]).count() == 366 + 365
    assert filters.date_year_in(df, "d", []).count() == 0
    assert filters.date_years(df, "d", 1996, 1997).count() == 366 + 365
    assert filters.date_years(df, "d", lo=1999).count() == 1


def test_a_local_warehouse_is_refused_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    conf = {"spark.sql.warehouse.dir": "file:/somewhere"}
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), _jvm=spark._jvm, _jsc=spark._jsc,
        sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app-1"),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(fake)
    conf["spark.sql.warehouse.dir"] = "/somewhere"
    with pytest.raises(ValueError, match="local disk"):
        session.shared_root(fake)
    conf["spark.checkpoint.dir"] = "file:/shared"
    assert session.shared_root(fake).startswith("file:/shared/")
