"""Monthly series: totals, within-year shares, rollups, lags and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark import constants as C
from tidemark.functions.calendar import month_start, with_calendar
from tidemark.functions.numbers import nan_to_null, ratio
from tidemark.operators.lookup import lookup_join

# Whole units are added in three parts of so many bits, the top one with the sign.
PART_BITS = (20, 20, 24)


def exact_sums(
    df: DataFrame,
    keys: list[str | Column],
    units: dict[str, tuple[Column, int]],
    few_keys: bool = True,
) -> DataFrame:
    """Sums of fixed-point values, the same for every order and partitioning of the rows.

    ``units`` maps a name to (value, decimals). Each value is a whole number of units in a
    long, cut into three parts that are added as longs, which is several times faster than
    decimals; the three sums of a key are put together as a decimal. The two low parts hold
    for 8.8e12 rows of a key, the top one for 1e12 rows even of the largest longs.

    With many keys three sums a key are more to shuffle than one; then the units are added
    as decimals.
    """
    low, mid, _ = PART_BITS
    whole = {n: F.rint(x * 10**d).cast("bigint") for n, (x, d) in units.items()}

    def shown(total: Column, name: str) -> Column:
        return (total.cast("double") / 10 ** units[name][1]).alias(name)

    if not few_keys:
        return df.groupBy(*keys).agg(*[shown(F.sum(x.cast("decimal(20,0)")), n) for n, x in whole.items()])
    sums = []
    for n, x in whole.items():
        parts = (x.bitwiseAND(F.lit((1 << low) - 1)), F.shiftright(x, low).bitwiseAND(F.lit((1 << mid) - 1)), F.shiftright(x, low + mid))
        sums += [F.sum(part).alias(f"{n}__{i}") for i, part in enumerate(parts)]
    added = df.groupBy(*keys).agg(*sums)
    names = [c for c in added.columns if not any(c.startswith(f"{n}__") for n in units)]
    part = lambda n, i, bits: F.col(f"`{n}__{i}`").cast("decimal(20,0)") * F.lit(1 << bits).cast("decimal(13,0)")
    whole_sum = lambda n: part(n, 0, 0) + part(n, 1, low) + part(n, 2, low + mid)
    return added.select(*[F.col(f"`{c}`") for c in names], *[shown(whole_sum(n), n) for n in units])


def monthly_totals(
    df: DataFrame,
    keys: list[str],
    date: str,
    value: Column,
    name: str = C.VALUE,
    decimals: int | None = None,
) -> DataFrame:
    """One row per series and month. All later operators work on this grain, where a
    series has at most twelve rows a year whatever its share of the raw rows was.

    With ``decimals`` the values are fixed-point and summed exactly."""
    rows = df.na.drop(subset=[*keys, date])
    month = month_start(F.col(date)).alias(C.DATE)
    if decimals is None:
        return with_calendar(
            rows.groupBy(*keys, month).agg(F.sum(value).cast("double").alias(name))
        )
    return with_calendar(exact_sums(rows, [*keys, month], {name: (value, decimals)}))


def sum_by(
    df: DataFrame, keys: list[str], values: list[str], decimals: int | None = None
) -> DataFrame:
    """Sums per key: rows with a null key are left out, missing values are skipped and
    a group of only missing values sums to 0. With ``decimals`` the sums are exact."""
    return (
        df.na.drop(subset=keys)
        .groupBy(*keys)
        .agg(*[F.coalesce(_sum(df, v, decimals), F.lit(0)).alias(v) for v in values])
    )


def _sum(df: DataFrame, column: str, decimals: int | None, over: WindowSpec | None = None) -> Column:
    """Sum of a column of a monthly or annual table, in whole units when ``decimals`` is given."""
    x = nan_safe(df, column)
    total = F.sum(x if decimals is None else F.rint(x * 10**decimals).cast("decimal(28,0)"))
    total = total if over is None else total.over(over)
    return total if decimals is None else total.cast("double") / 10**decimals


def nan_safe(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    c = F.col(f"`{column}`")
    return nan_to_null(c) if kind in ("double", "float") else c


def annual_sum(
    df: DataFrame, keys: list[str], values: list[str], decimals: int | None = None
) -> DataFrame:
    return sum_by(df, [*keys, C.YEAR], values, decimals)


def quarterly_sum(
    df: DataFrame, keys: list[str], values: list[str], decimals: int | None = None
) -> DataFrame:
    return sum_by(df, [*keys, C.YEAR, C.QUARTER], values, decimals)


def quarters_with_year_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quarterly sums beside the sum of their year; at most four rows per window."""
    quarters = quarterly_sum(df, keys, [value])
    year = F.sum(f"`{value}`").over(Window.partitionBy(*keys, C.YEAR))
    return quarters.select(
        *keys,
        C.YEAR,
        C.QUARTER,
        F.col(f"`{value}`").alias(f"{value}_x"),
        year.alias(f"{value}_y"),
    )


def year_total(
    df: DataFrame,
    keys: list[str],
    value: str = C.VALUE,
    name: str = C.TOTAL,
    decimals: int | None = None,
) -> DataFrame:
    """Group total beside each row of a monthly table (at most twelve rows per group
    and source); null where a key is null."""
    w = Window.partitionBy(*keys, C.YEAR)
    total = F.coalesce(_sum(df, value, decimals, w), F.lit(0.0))
    known = F.lit(True)
    for k in (*keys, C.YEAR):
        known = known & F.col(k).isNotNull()
    return df.withColumn(name, F.when(known, total))


def group_total(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The same on raw rows of any group size: a map-side combined aggregate looked up by
    its key, so that no task ever holds a whole group."""
    return lookup_join(df, sum_by(df, keys, [value]).withColumnRenamed(value, name), keys)


def with_share(
    df: DataFrame, keys: list[str], value: str = C.VALUE, decimals: int | None = None
) -> DataFrame:
    """Add the year total and the share of each month in it. ``keys`` must include the
    source when several sources are to be unioned, as shares are per source."""
    return year_total(df, keys, value, decimals=decimals).withColumn(C.SHARE, ratio(F.col(value), F.col(C.TOTAL)))


def seasonal_weights(df: DataFrame, keys: list[str], last_year: int | None = None) -> DataFrame:
    """Mean share per month over the years up to ``last_year``."""
    history = df if last_year is None else df.where(F.col(C.YEAR) <= last_year)
    return history.groupBy(*keys, C.MONTH).agg(F.avg(C.SHARE).alias(C.SHARE))


def union_sources(
    sources: dict[str, DataFrame], keys: list[str], prefer: list[str] | None = None
) -> DataFrame:
    """Union of monthly sources, tagged. Overlapping months are all kept unless
    ``prefer`` ranks the sources, in which case the first one wins per series and month."""
    tagged = [df.withColumn(C.SOURCE, F.lit(name)) for name, df in sources.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    if not prefer:
        return out
    order = F.array_position(F.lit(prefer), F.col(C.SOURCE))
    rank = F.when(order == 0, F.lit(len(prefer) + 1)).otherwise(order)
    w = Window.partitionBy(*keys, C.DATE).orderBy(rank, C.SOURCE)
    return out.withColumn("rank__s", F.row_number().over(w)).where("rank__s = 1").drop("rank__s")


def with_lags(
    df: DataFrame, keys: list[str], value: str = C.VALUE, n: int = 3, order: str = C.YEAR
) -> DataFrame:
    """Add ``lag1..lagn`` of an annual series in one window."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"lag{i}": F.lag(value, i).over(w) for i in range(1, n + 1)})


def last_state(df: DataFrame, keys: list[str], value: str = C.VALUE, n: int = 3,
               order: str = C.YEAR) -> DataFrame:
    """Last row of each series with its lags, one aggregate after the lag window."""
    lagged = with_lags(df, keys, value, n, order)
    cells = [order, value, *[f"lag{i}" for i in range(1, n + 1)]]
    last = F.max_by(F.struct(*cells), F.col(order)).alias("last")
    return lagged.groupBy(*keys).agg(last).select(*keys, "last.*")


def pct_change(df: DataFrame, keys: list[str], value: str, order: str = C.YEAR) -> DataFrame:
    """Add the change to the previous row in percent; null after a zero or missing value."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(f"`{value}`").over(w)
    change = (ratio(F.col(f"`{value}`"), prev) - 1) * 100
    return df.withColumn("pct_change", change)


def sign_class(x: Column) -> Column:
    return (
        F.when(x > 0, C.SIGN_CLASSES["up"])
        .when(x < 0, C.SIGN_CLASSES["down"])
        .otherwise(C.SIGN_CLASSES["flat"])
    )


def with_balance(df: DataFrame, receipts: str = C.RECEIPTS, expenses: str = C.EXPENSES) -> DataFrame:
    return df.withColumn(C.BALANCE, F.col(f"`{receipts}`") - F.col(f"`{expenses}`"))


def history_and_future(
    history: DataFrame, future: DataFrame, keys: list[str], actual: str, fitted: str
) -> DataFrame:
    """History rows followed by future rows whose actual value is null."""
    return history.select(*keys, C.YEAR, actual, fitted).unionByName(
        future.select(*keys, C.YEAR, F.lit(None).cast("double").alias(actual), fitted)
    )
