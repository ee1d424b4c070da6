"""Exact ranks that hold when one group has a large share of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lookup import null_safe_join
from tidemark.session import materialise

#: Rows of a series that one bucket of the split holds on average.
ROWS_PER_BUCKET = 50_000


def spread_row_number(
    df: DataFrame, keys: list[str], order: list[Column], name: str, total: str | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    Rows are sorted over all tasks by key, order and a hash of the row, so a key with a third
    of all rows, or many rows that tie, are spread over many tasks. Sorted rows are written
    with the number of their partition and their place in it; the place of a key's first row
    there and the count of its rows in earlier partitions, both from one map-side combined
    ``groupBy``, turn places into ranks. Null keys form a group, null order values come first,
    as in the window function. ``total`` names a column for the number of rows of the key.
    """
    at, part, place, n, low = (f"{name}__{x}" for x in ("at", "part", "place", "n", "low"))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.sort(*keys, *order, tie).withColumn(at, F.monotonically_increasing_id())
    rows = materialise(rows, "sorted")
    rows = rows.withColumns({part: F.shiftright(at, 33), place: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))}).drop(at)
    w = Window.partitionBy(*keys)
    earlier = F.sum(n).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n), F.min(place).alias(low))
    shift = F.coalesce(earlier, F.lit(0)) - F.col(low) + 1
    runs = runs.select(*keys, part, shift.alias(name), *([F.sum(n).over(w).alias(total)] if total else []))
    ranked = null_safe_join(rows, runs, [*keys, part])
    return ranked.withColumn(name, F.col(name) + F.col(place)).drop(part, place)


def row_ids(
    df: DataFrame, source: str, order_key: str, name: str = "id"
) -> DataFrame:
    """Ids ``source-i`` with ``i`` counting from 0 along ``order_key`` inside each source; rows
    with equal order keys count in the order of a hash of the row. A null source gives ``i``."""
    ranked = spread_row_number(df, [source], [F.col(order_key)], "row__rn")
    return ranked.withColumn(
        name, F.concat_ws("-", F.col(source), (F.col("row__rn") - 1).cast("string"))
    ).drop("row__rn")


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int | Column, name: str = "rank",
    spread: Column | None = None,
) -> DataFrame:
    """First ``k`` rows per key. ``k`` may be a column for a data-dependent limit.

    With ``spread`` the rows of one key are first cut to ``k`` inside each spread
    value, so the last step sees at most ``k`` rows per (key, spread value).
    """
    limit = F.lit(k) if isinstance(k, int) else k
    if spread is not None:
        s = f"{name}__s"
        df = (
            df.withColumn(s, spread)
            .withColumn(name, F.row_number().over(Window.partitionBy(*keys, s).orderBy(*order)))
            .where(F.col(name) <= limit)
            .drop(name, s)
        )
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(name) <= limit
    )


def split_train_test(
    df: DataFrame,
    keys: list[str],
    row_key: list[str],
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(test_size * n)`` rows per series, by hash order.

    Counts per series and hash bucket tell in which bucket the limit falls. Rows of earlier
    buckets are test, of later ones train, without a shuffle; only the rows of that one bucket
    are ranked. The number of buckets follows from the number of rows. Null keys are a series.
    """
    h, b, n, before, limit = (f"split__{x}" for x in ("h", "b", "n", "before", "limit"))
    digits = max(1, math.ceil(math.log(max(df.count() / ROWS_PER_BUCKET, 1), 16)))
    rows = df.withColumn(
        h, F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_key]))
    ).withColumn(b, F.substring(h, 1, digits))
    w = Window.partitionBy(*keys)
    earlier = F.sum(n).over(w.orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n)).withColumns(
        {before: F.coalesce(earlier, F.lit(0)), limit: F.ceil(F.sum(n).over(w) * F.lit(test_size))}
    )
    at = cells.where((F.col(before) < F.col(limit)) & (F.col(limit) <= F.col(before) + F.col(n)))
    at = at.select(*keys, F.col(b).alias(f"{b}0"), before, limit)
    known = null_safe_join(rows, at, keys)
    sure = known.where(f"{b} <> {b}0 OR {b}0 IS NULL").withColumn("is_test", F.coalesce(F.col(b) < F.col(f"{b}0"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(h, *row_key))
    edge = known.where(f"{b} = {b}0").withColumn("is_test", F.col(before) + rank <= F.col(limit))
    return sure.unionByName(edge).drop(h, b, f"{b}0", before, limit)
