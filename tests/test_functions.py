"""Scalar functions against Python, on the edge cases of the data model."""

import random

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import numbers as num
from tidemark.functions import text as txt


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("y")).collect()]


def test_round_exact_matches_python(spark):
    rng = random.Random(7)
    xs = [0.35, 0.25, 12.25, 0.05, -0.04, -0.001, -0.005, 0.005, 1.005, 2.675, 0.0075, 13214605.585]
    xs += [rng.randint(-(10**7), 10**7) / 1000 for _ in range(5000)]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(1000)] + [rng.randint(-(10**6), 10**6) / 8 for _ in range(1000)]
    for digits in (1, 2):
        got = column(spark, xs, num.round_exact("x", digits), "double")
        assert [repr(v) for v in got] == [repr(round(x, digits)) for x in xs]
    assert column(spark, xs, num.round2_text("x"), "double") == [repr(round(x, 2)) for x in xs]
    assert column(spark, xs, num.pct_label("x"), "double") == [f"{x:.1f}%" for x in xs]


def test_number_parsing(spark):
    xs = ["1234", "1 234,5", "x", None, "1e3", " 7 ", "1.", ".5", "1d", "inf", "nan"]
    want = [1234.0, 1234.5, None, None, 1000.0, 7.0, 1.0, 0.5, None, None, None]
    assert column(spark, xs, num.parse_number(F.col("x"))) == want
    assert column(spark, ["1 234,5"], num.parse_number(F.col("x"))) == [None]
    assert column(spark, ["1 234,5"], num.parse_number(F.col("x"), strip_nbsp=True)) == [1234.5]
    tokens = ["", "null", "undefined", "abc", "1d", "4.5"]
    assert column(spark, tokens, num.token_value(F.col("x"))) == [None] * 5 + [4.5]


def test_thousands(spark):
    xs = [1234567.5, 2.5, -0.4, 999.0]
    assert column(spark, xs, num.thousands(F.col("x")), "double") == [f"{x:,.0f}" for x in xs]
    assert column(spark, [1234567.0], num.thousands(F.col("x"), " "), "double") == ["1 234 567"]


def test_months(spark):
    names = ["Février", "Fevrier", "Août", "mars", None]
    assert column(spark, names, cal.month_from_french(F.col("x"))) == ["Feb", None, "Aug", None, None]
    folded = column(spark, names, cal.month_from_french(F.col("x"), fold_accents=True))
    assert folded == ["Feb", "Feb", "Aug", "Mar", None]


def test_headers_to_dates(spark):
    heads = ["févr. 2019", "FÉVR 2019", "janvier 2019", " août. 2020", "total"]
    cleaned = column(spark, heads, cal.clean_header(F.col("x")))
    assert cleaned[:3] == ["Feb 2019", "Feb 2019", "Janier 2019"]
    dates = column(spark, heads, cal.parse_month(cal.clean_header(F.col("x"))))
    assert [str(d) if d else None for d in dates] == ["2019-02-01", "2019-02-01", None, "2020-08-01", None]
    full = column(spark, heads, cal.parse_month(cal.clean_header(F.col("x"), full_names=True)))
    assert [str(d) if d else None for d in full][:3] == ["2019-02-01", "2019-02-01", "2019-01-01"]


def test_years(spark):
    assert column(spark, ["2019", "YR2019", " 7 ", "x"], cal.parse_year(F.col("x"))) == [2019, 2019, 7, None]


def test_int_list(spark):
    got = column(spark, ["2012, 2013", "2012 x", "", " 5,,6 "], txt.parse_int_list(F.col("x")))
    assert [(list(r["values"]), r["ok"]) for r in got] == [
        ([2012, 2013], True), ([2012, None], False), ([], True), ([5, 6], True),
    ]


def test_align(spark):
    df = spark.createDataFrame([([1, 2], 3), ([1, 2, 3, 4], 3), ([], 2)], "v array<int>, n int")
    got = [r[0] for r in df.select(txt.align(F.col("v"), F.col("n"))).collect()]
    assert got == [[1, 2, None], [1, 2, 3], [None, None]]


def test_sentence(spark):
    df = spark.createDataFrame(
        [(2006, 1, "Jan", 13214605.585, None, 5.0), (None, 2, "d'été", -0.001, "y", 5.12)],
        "`Année` int, n int, m string, a double, b string, c double",
    )
    got = [r[0] for r in df.select(txt.sentence(df.schema, "global")).collect()]
    assert got == [
        "[global] En 2006 :. n était de 1. m : Jan. a était de 13214605.59. c était de 5.0.",
        "[global] En Inconnue :. n était de 2. m : d'été. a était de -0.0. b : y. c était de 5.12.",
    ]


def test_prompt(spark):
    df = spark.createDataFrame([("q", None), ("q", " \n"), ("q", " c\n")], "q string, c string")
    got = [r[0] for r in df.select(txt.prompt(F.col("q"), F.col("c"))).collect()]
    none = "Tu es un assistant économique et touristique.\nQuestion : q\nJe ne dispose pas de cette information."
    some = (
        "\nTu es un assistant économique et touristique intelligent.\nQuestion : q\nc\n"
        "Réponds uniquement sur les données disponibles.\n"
    )
    assert got == [none, none, some]


def test_count_of(spark):
    assert column(spark, ["data: a data:", "x", "a.b"], txt.count_of(F.col("x"), "data:")) == [2, 0, 0]
    assert column(spark, ["a.b axb"], txt.count_of(F.col("x"), "a.b")) == [1]


def test_numbers_at_the_edges(spark):
    assert column(spark, [float("nan"), None, 1.25], num.pct_label("x"), "double") == [None, None, "1.2%"]
    assert column(spark, [1e36, 2.0**52 + 0.5], num.round2_text("x"), "double")[1].startswith("4503599627370496")
    xs = [12345678901234.375, -12345678901234.375, 1e15 + 0.125, 98765432109876.62]
    assert column(spark, xs, num.round_exact("x", 2), "double") == [round(x, 2) for x in xs]
