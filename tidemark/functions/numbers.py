"""Number parsing and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def to_double(text: Column) -> Column:
    """Double or null; accepts plain digits with an optional point and exponent."""
    t = F.trim(text)
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def parse_number(text: Column, strip_nbsp: bool = False) -> Column:
    """Locale number such as ``1 234,5``: drop blanks, comma to point, coerce."""
    t = F.translate(text, "  ", "") if strip_nbsp else text
    return to_double(F.translate(t, ", ", "."))


def token_value(token: Column) -> Column:
    """Value of a scraped literal; the null tokens and anything else are null."""
    t = F.trim(token)
    return F.when(~t.isin(*C.NULL_TOKENS), to_double(t))


def thousands(x: Column, sep: str = ",") -> Column:
    """No decimals, grouped by thousands, half-even."""
    text = F.format_number(x, 0)
    return text if sep == "," else F.replace(text, F.lit(","), F.lit(sep))


def _round_sql(x: str, digits: int) -> str:
    powers = {1: (16, 4), 2: (128, 64, 8)}[digits]
    scale = 10**digits
    rest = " + ".join(f"{x} * {p}D" for p in powers[1:])
    rest = f"({x} * {powers[0]}D - rint({x} * {2 * scale}D)) + {rest}"
    near = f"rint({x} * {scale}D + 0.125D * signum({rest})) / {scale}D"
    # From 1e13 on the fraction has few bits, so its product with the scale is exact.
    large = f"({x} - {x} % 1) + rint(({x} % 1) * {scale}) / {scale}D"
    return f"IF(abs({x}) < 1.0E13D, {near}, {large})"


def round_exact(column: str, digits: int) -> Column:
    """Round a double to one or two decimals by its exact binary value, ties to even.

    ``round`` and ``bround`` look at the shortest decimal text, so 0.35 (slightly below
    the tie) would go up. Here the distance to the nearest half unit is taken from
    products with powers of two, which floating point subtracts without error; its sign
    moves the value off the tie before it is rounded.
    """
    return F.expr(_round_sql(f"`{column}`", digits))


def pct_label(column: str) -> Column:
    """One decimal and a percent sign; null and NaN give null."""
    text = F.format_string("%.1f%%", round_exact(column, 1))
    return F.when(F.col(f"`{column}`").isNotNull() & ~F.isnan(f"`{column}`"), text)


def round2_sql(x: str) -> str:
    """SQL text of a double with two decimals, no exponent and at least one decimal."""
    y = _round_sql(x, 2)
    text = f"regexp_replace(CAST(CAST({y} AS DECIMAL(38,2)) AS STRING), '0$', '')"
    return f"IF({x} < 0 AND {y} = 0, '-0.0', IF(abs({y}) < 1.0E35D, {text}, format_string('%.1f', {y})))"


def round2_text(column: str) -> Column:
    return F.expr(round2_sql(f"`{column}`"))


def ratio(x: Column, y: Column) -> Column:
    """``x / y`` with null, not an error, for a zero divisor."""
    return F.try_divide(x, y)
