"""French month names, month headers and calendar parts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C

_ACCENTED, _PLAIN = "éèêëàâäîïôöûùüç", "eeeeaaaiioouuuc"


def _fold(col: Column) -> Column:
    return F.translate(F.lower(F.trim(col)), _ACCENTED, _PLAIN)


def _fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def month_from_french(name: Column, fold_accents: bool = False) -> Column:
    """``Février`` to ``Feb``; null when the name is not in the table.

    The exact form misses ``Fevrier``; ``fold_accents`` compares without case
    and accents instead.
    """
    table = C.FULL_MONTHS_FR
    if fold_accents:
        table = {_fold_text(k): v for k, v in table.items()}
        name = _fold(name)
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, name)


def clean_header(header: Column, full_names: bool = False) -> Column:
    """``janv. 2015`` to ``Jan 2015``: dots off, trimmed, stems replaced in order.

    Full names break (``Janier 2015``) unless ``full_names`` maps the whole first word.
    """
    text = F.trim(F.replace(header, F.lit("."), F.lit("")))
    if full_names:
        month = month_from_french(F.substring_index(text, " ", 1), fold_accents=True)
        rest = F.regexp_extract(text, r"^\S+\s+(.*)$", 1)
        stemmed = clean_header(header)
        return F.when(month.isNotNull(), F.concat_ws(" ", month, rest)).otherwise(stemmed)
    for stem, month in C.MONTH_STEMS_FR.items():
        text = F.regexp_replace(text, f"(?iu){stem}", month)
    return text


def parse_month(text: Column) -> Column:
    """``Feb 2019`` to the first day of that month, null when it does not parse."""
    return F.try_to_date(text, "MMM yyyy")


def parse_year(text: Column) -> Column:
    """``2019`` or ``YR2019`` to an int."""
    return F.trim(F.replace(text, F.lit("YR"), F.lit(""))).try_cast("int")


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def with_calendar(df: DataFrame, date: str = C.DATE) -> DataFrame:
    """Add year, quarter and English month abbreviation of a date column."""
    d = F.col(date)
    return df.withColumns(
        {C.YEAR: F.year(d), C.QUARTER: F.quarter(d), C.MONTH: F.date_format(d, "MMM")}
    )
