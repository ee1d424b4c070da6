"""Text expressions: lists, documents, prompts and arrays of parsed pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark.functions.numbers import round2_sql

_BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def parse_int_list(text: Column) -> Column:
    """``2012, 2013`` to ``struct(values array<int>, ok boolean)``.

    ``ok`` is false when any piece is not an integer; empty text is an empty list.
    """
    pieces = F.filter(
        F.split(F.translate(text, ",", " "), r"\s+"), lambda x: F.length(x) > 0
    )
    numbers = F.transform(
        pieces, lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("int"))
    )
    ok = ~F.exists(numbers, lambda x: x.isNull())
    return F.struct(numbers.alias("values"), F.coalesce(ok, F.lit(True)).alias("ok"))


def align(values: Column, n: Column) -> Column:
    """Pad with nulls or cut an array to length ``n``; the array is evaluated once."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(None), n)), 1, n)


def sentence(schema: T.StructType, name: str, year: str = C.YEAR) -> Column:
    """One text per row: ``[name] En <year> :. <col> était de <number>. <col> : <text>.``

    Missing cells are skipped; a missing year prints as unknown.
    """
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    parts = [
        f"concat({text(f'[{name}] En ')}, "
        f"coalesce(CAST(CAST(`{year}` AS INT) AS STRING), {text(C.UNKNOWN_YEAR)}), ' :')"
    ]
    for field in schema.fields:
        if field.name == year:
            continue
        cell = f"`{field.name}`"
        if isinstance(field.dataType, (T.FractionalType, T.DecimalType)):
            shown = f"{text(f'{field.name} était de ')}, {round2_sql(f'CAST({cell} AS DOUBLE)')}"
        elif isinstance(field.dataType, T.IntegralType):
            shown = f"{text(f'{field.name} était de ')}, CAST({cell} AS STRING)"
        else:
            shown = f"{text(f'{field.name} : ')}, CAST({cell} AS STRING)"
        parts.append(f"concat({shown})")
    # One SQL text: hundreds of single Column calls would dominate the planning time.
    return F.expr(f"concat(concat_ws('. ', {', '.join(parts)}), '.')")


def prompt(question: Column, context: Column) -> Column:
    """Fill the question template; without context the fallback template is used."""
    ctx = strip(F.coalesce(context, F.lit("")))
    return F.when(
        F.length(ctx) == 0, F.format_string(C.PROMPT_WITHOUT_CONTEXT, question)
    ).otherwise(F.format_string(C.PROMPT_WITH_CONTEXT, question, ctx))


def sales_prompt(question: Column) -> Column:
    return F.format_string(C.PROMPT_SALES, question)


def count_of(text: Column, marker: str) -> Column:
    """Non-overlapping occurrences of a literal marker."""
    return F.regexp_count(text, F.lit(f"\\Q{marker}\\E"))
