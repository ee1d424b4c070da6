"""Forests and forecasts: properties that hold whatever the trees look like."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import forecast as fc
from tidemark.operators import monthly as mon
from tidemark.plans import mart as mt
from tidemark.functions.calendar import with_calendar

S = [C.SERIES]


@pytest.fixture(scope="module")
def annual(spark):
    rng = np.random.default_rng(5)
    data = [(s, y, float(100 * (i + 1) + 5 * (y - 2000) + rng.normal())) for i, s in enumerate("abc") for y in range(2000, 2013)]
    return spark.createDataFrame(data, f"series string, `{C.YEAR}` int, {C.VALUE} double").persist()


def bounds(df, c=C.VALUE):
    return tuple(df.agg(F.min(c), F.max(c)).first())


def test_recursive_forecast_stays_in_the_training_range(annual):
    model = fc.fit_lag_forest(annual, S, 2003, 2012, trees=10, depth=4)
    out = fc.recursive_forecast(model, annual, S, [2013, 2014, 2015])
    assert out.count() == 9
    lo, hi = bounds(annual)
    assert all(lo <= r[C.VALUE] <= hi for r in out.collect())
    again = fc.fit_lag_forest(annual.repartition(3), S, 2003, 2012, trees=10, depth=4)
    twice = fc.recursive_forecast(again, annual, S, [2013, 2014, 2015])
    assert sorted(map(str, out.collect())) == sorted(map(str, twice.collect()))


@pytest.mark.parametrize("seed_from, first", [("last_row", 432), ("before_gap", 100)])
def test_forecast_state(spark, monkeypatch, seed_from, first):
    """Years 2019, 2023, 2024, 2025 hold 1, 2, 3, 4: the first inputs are (4, 3, 2)."""

    def spy(model, df, inputs, out):
        digits = [F.coalesce(F.col(c), F.lit(0.0)) for c in inputs]
        return df.withColumn(out, digits[0] * 100 + digits[1] * 10 + digits[2])

    monkeypatch.setattr(fc, "predict", spy)
    df = spark.createDataFrame(
        [("a", y, float(v)) for y, v in [(2019, 1), (2023, 2), (2024, 3), (2025, 4)]],
        f"series string, `{C.YEAR}` int, {C.VALUE} double",
    )
    out = fc.recursive_forecast(None, df, S, [2020, 2021], seed_from=seed_from).orderBy(C.YEAR).collect()
    assert out[0][C.VALUE] == first
    want = {"last_row": 432 * 100 + 4 * 10 + 3, "before_gap": 100 * 100 + 1 * 10}[seed_from]
    assert out[1][C.VALUE] == want


def test_short_series_get_no_value(spark, annual):
    model = fc.fit_lag_forest(annual, S, 2003, 2012, trees=3, depth=3)
    short = spark.createDataFrame([("z", 2012, 1.0)], annual.schema)
    out = fc.recursive_forecast(model, annual.unionByName(short), S, [2013])
    assert {r["series"]: r[C.VALUE] is None for r in out.collect()} == {"a": False, "b": False, "c": False, "z": True}


def test_forecast_with_trend(annual):
    out = fc.forecast_with_trend(annual, S, [C.VALUE], C.VALUE, "fit", trees=10, noise=0).persist()
    past, future = out.where(F.col(C.VALUE).isNotNull()), out.where(F.col(C.VALUE).isNull())
    assert sorted(map(str, past.select("series", C.YEAR, C.VALUE).collect())) == sorted(map(str, annual.collect()))
    assert sorted({r[C.YEAR] for r in future.collect()}) == [2013, 2014, 2015, 2016] and future.count() == 12
    lo, hi = bounds(annual)
    assert all(lo <= r["fit"] <= hi for r in out.collect())


def test_mart_end_to_end(spark):
    """Two sources, three missing years, indicators known to 2012: every month is filled."""
    def source(years):
        data = [
            (s, dt.date(y, m, 1), float(100 + 10 * m + y - 2000 + 50 * (s == "b")))
            for s in "ab" for y in years for m in range(1, 13)
        ]
        return with_calendar(spark.createDataFrame(data, f"series string, {C.DATE} date, {C.VALUE} double"))

    sources = {"sheet": source(range(2004, 2012)), "scrape": source([2012, 2016])}
    indicators = spark.createDataFrame([(y, float(y), 5.0) for y in range(2004, 2013)], f"`{C.YEAR}` int, x double, y double")
    out = mt.build_monthly_mart(
        sources, indicators, S, 2006, 2012, [2013, 2014, 2015], 2012, columns=["x", "y"], lag_trees=5, indicator_trees=5
    ).persist()
    assert out.count() == 2 * 13 * 12
    assert out.where("x IS NULL OR y IS NULL").count() == 0
    assert out.where(F.col(C.VALUE).isNull()).count() == 0
    totals = mon.annual_sum(out, S, ["x", C.VALUE])
    x2010 = totals.where(f"`{C.YEAR}` = 2010 AND series = 'a'").first()["x"]
    assert x2010 == pytest.approx(2010.0)
    years = {r[C.YEAR] for r in totals.collect()}
    assert years == set(range(2004, 2017))


def test_mart_storage(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0)], f"series string, `{C.YEAR}` int, v double")
    mt.write_mart(df, str(tmp_path / "mart"))
    back = mt.read_mart(spark, str(tmp_path / "mart"))
    assert sorted(map(tuple, back.select("series", C.YEAR, "v").collect())) == [("a", 2020, 1.0), ("a", 2021, 2.0)]


def test_rolling_holdout_knows_nothing_after_the_origin(spark, annual):
    short = spark.createDataFrame([("new", 2007, 1.0), ("new", 2008, 2.0), ("gone", 2005, 3.0), ("hole", 2007, None)], annual.schema)
    known = annual.unionByName(short)
    run = lambda df: {(r["origin"], r[C.SERIES]): r for r in fc.rolling_holdout(df, S, [2007, 2009], trees=10).collect()}
    out = run(known)
    assert set(out) == {(o, s) for o in (2007, 2009) for s in "abc"} | {(2007, "new")}
    values = {(r[C.SERIES], r[C.YEAR]): r[C.VALUE] for r in annual.collect()}
    for (origin, series), r in out.items():
        if series == "new":
            assert (r["last"], r["last_error"], r["trend"], r["forest"]) == (1.0, 1.0, None, None)
            continue
        past = [(y, v) for (s, y), v in values.items() if s == series and y <= origin]
        slope, intercept = np.polyfit(*zip(*past), 1)
        assert r[C.YEAR] == origin + 1 and r["actual"] == values[series, origin + 1] and r["last"] == values[series, origin]
        assert r["trend"] == pytest.approx(slope * (origin + 1) + intercept, rel=1e-6)
        labels = [v for (_, y), v in values.items() if y <= origin]
        assert min(labels) <= r["forest"] <= max(labels)
        assert r["forest_error"] == pytest.approx(abs(r["forest"] - r["actual"]))
        assert r["trend_error"] == pytest.approx(abs(r["trend"] - r["actual"]))
    # Other values after the origin change the errors, not the forecasts.
    later = run(known.withColumn(C.VALUE, F.when(F.col(C.YEAR) > 2009, F.col(C.VALUE) * 7).otherwise(F.col(C.VALUE))))
    told = lambda rows: {k: (r["forest"], r["trend"], r["last"]) for k, r in rows.items()}
    assert told(later) == told(out)
    assert later[2009, "a"]["last_error"] > 10 * out[2009, "a"]["last_error"]
