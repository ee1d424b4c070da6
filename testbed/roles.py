"""The driver tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.calendar import month_start, with_calendar
from tidemark.operators.disagg import spread_indicators
from tidemark.operators.monthly import annual_sum, exact_sums, monthly_totals, with_share

KEYS = [C.SERIES]
FRENCH = list(C.FULL_MONTHS_FR)
STEMS = list(C.MONTH_STEMS_FR)


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table by its known schema, so that no job runs to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def cents(column: str) -> Column:
    return F.rint(F.col(column) * 100).cast("bigint")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumnRenamed("o_orderpriority", C.SERIES)


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals: order totals per priority and month."""
    return monthly_totals(orders(spark, sf), KEYS, "o_orderdate", F.col("o_totalprice"), decimals=2)


def shared(spark: SparkSession, sf: str) -> DataFrame:
    return with_share(monthly(spark, sf), KEYS, decimals=2)


def segment_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """More series: (priority, market segment) per month.

    Orders are summed per customer before the join, so a customer with a large share of
    all orders is a handful of rows by then.
    """
    cells = ["o_custkey", C.SERIES, month_start(F.col("o_orderdate")).alias(C.DATE)]
    per_customer = orders(spark, sf).groupBy(*cells).agg(F.sum(cents("o_totalprice")).alias("v"))
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")
    )
    return with_calendar(
        per_customer.join(customers, "o_custkey")
        .groupBy(C.SERIES, "segment", C.DATE)
        .agg((F.sum(F.col("v").cast("decimal(20,0)")).cast("double") / 100).alias(C.VALUE))
    )


SEGMENT_KEYS = [C.SERIES, "segment"]


def indicator_units() -> dict[str, tuple[Column, int]]:
    """Exact sums the indicators are made of: (value, decimals)."""
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    kept = price * (1 - F.col("l_discount"))
    return {
        "receipts": (price, 2),
        "discount": (price * F.col("l_discount"), 4),
        "tax": (price * F.col("l_tax"), 4),
        "receipts_a": (F.when(flag == "A", price), 2),
        "receipts_n": (F.when(flag == "N", price), 2),
        "expenses_a": (F.when(flag == "A", kept), 4),
        "expenses_n": (F.when(flag == "N", kept), 4),
        "expenses": (kept, 4),
    }


def indicator_columns() -> dict[str, Column]:
    """The eight indicators from those sums."""
    c = F.col
    return {
        C.RECEIPTS: c("receipts"),
        C.RECEIPTS_PCT: F.try_divide(c("discount"), c("receipts")) * 100,
        C.RECEIPTS_TRANSPORT: c("receipts_a"),
        C.RECEIPTS_TRAVEL: c("receipts_n"),
        C.EXPENSES_TRANSPORT: c("expenses_a"),
        C.EXPENSES_TRAVEL: c("expenses_n"),
        C.EXPENSES: c("expenses"),
        C.EXPENSES_PCT: F.try_divide(c("tax"), c("receipts")) * 100,
    }


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Annual indicators: one pass over the line items by year of shipping."""
    year = F.year("l_shipdate").alias(C.YEAR)
    sums = exact_sums(table(spark, sf, "lineitem"), [year], indicator_units())
    return sums.select(C.YEAR, *[x.alias(n) for n, x in indicator_columns().items()])


def mart(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly mart before any forecast."""
    return spread_indicators(shared(spark, sf), indicators(spark, sf), C.INDICATORS).select(
        C.SERIES, C.DATE, C.YEAR, C.QUARTER, C.MONTH, *[f"`{c}`" for c in C.INDICATORS], C.VALUE
    )


def annual(spark: SparkSession, sf: str) -> DataFrame:
    return annual_sum(monthly(spark, sf), KEYS, [C.VALUE], decimals=2)


def date_bounds(df: DataFrame, date: str) -> tuple[int, int]:
    """First and last year of a raw date column: one scan of that column, without a shuffle of rows."""
    return tuple(d.year for d in df.agg(F.min(date), F.max(date)).first())


def year_bounds(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg(F.min(C.YEAR), F.max(C.YEAR)).first())


def french_month(date: Column, names: list[str]) -> Column:
    return F.element_at(F.lit(names), F.month(date))


def locale_text(x: Column) -> Column:
    """``1 234,50``"""
    return F.translate(F.format_number(x, 2), ",.", " ,")


def vector_records(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as stored records: label is the type, the id gives the year."""
    from tidemark.sources.vectors import to_records

    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("values"),
        F.lit(C.VECTOR_SOURCE).alias(C.SOURCE),
        F.concat(F.lit("doc "), F.col("vec_id").cast("string")).alias("text"),
        (F.lit(1995) + F.col("vec_id") % 7).alias(C.YEAR),
        F.concat(F.lit("t"), F.col("label").cast("string")).alias("type"),
    )
    return to_records(rows, F.concat_ws("-", F.col(C.SOURCE), F.col("vec_id")))


def centroids(spark: SparkSession, sf: str, dim: int = 64) -> DataFrame:
    """Mean vector of each label: a few questions that depend on every vector."""
    parts = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dim)]
    return (
        table(spark, sf, "embeddings").groupBy("label").agg(F.array(*parts).alias("vector"))
    )
