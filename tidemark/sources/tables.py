"""Statistics tables: long CSV, wide sheet exports and the indicator feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark import schemas
from tidemark.functions.calendar import month_from_french, parse_month, parse_year, with_calendar
from tidemark.functions.numbers import nan_to_null


def read_long_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LONG_CSV
) -> DataFrame:
    """Year, French month, value; an empty cell is null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_long_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def read_wide(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Exported wide sheet; every cell is read as text."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def clean_long(df: DataFrame, fold_accents: bool = False) -> DataFrame:
    """Long table to the canonical calendar form. Rows whose month name is not known
    are dropped (``Fevrier`` is one, unless accents are folded)."""
    month = month_from_french(F.col(C.MONTH), fold_accents)
    date = parse_month(F.concat(month, F.lit(" "), F.col(C.YEAR).cast("string")))
    others = [c for c in df.columns if c not in (C.YEAR, C.MONTH, C.RAW_VALUE)]
    return with_calendar(
        df.select(
            *others, nan_to_null(F.col(C.RAW_VALUE)).alias(C.VALUE), date.alias(C.DATE)
        ).na.drop(subset=[C.DATE])
    )


def load_indicators(
    feed: DataFrame, country: str | None, codes: dict[str, str] = C.INDICATOR_CODES
) -> DataFrame:
    """Long feed to one row per year with one column per indicator.

    The codes are given, so the filter reaches the scan, one conditional aggregate per
    column needs one shuffle, and no job runs to find the columns. Years where every
    indicator is missing are dropped. ``country=None`` keeps all, keyed by country.
    """
    rows = feed.where(F.col("indicator").isin(*codes))
    keys = [parse_year(F.col("date")).alias(C.YEAR)]
    if country is None:
        keys.insert(0, F.col("country"))
    else:
        rows = rows.where(F.col("country") == country)
    value = nan_to_null(F.col("value"))
    return (
        rows.groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("indicator") == code, value)).alias(name)
                for code, name in codes.items()
            ]
        )
        .na.drop(how="all", subset=list(codes.values()))
    )
