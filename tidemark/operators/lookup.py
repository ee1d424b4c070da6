"""Joins of many rows to a small computed table, without shuffling the many rows.

A computed table has no known size when a plan is made: the planner would shuffle both
sides and learn the size too late. Written first, its file size is exact, so the planner
broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise falls back
to a shuffled join, whose skewed partitions are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def lookup_join(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``dim`` by its measured size. ``dim`` is computed and written right away.

    Without columns in ``on`` the one row of ``dim`` stands beside every row."""
    dim = materialise(dim, "dim")
    if on:
        return df.join(dim, on, how)
    one = dim.first()
    return df.withColumns({c: F.lit(one[c] if one else None).cast(dim.schema[c].dataType) for c in dim.columns})


def null_safe_join(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """The same with null keys equal to each other."""
    if not on:
        return lookup_join(df, dim, on, how)
    dim = materialise(dim, "dim").withColumnsRenamed({c: f"{c}__dim" for c in on})
    same = [df[f"`{c}`"].eqNullSafe(dim[f"`{c}__dim`"]) for c in on]
    return df.join(dim, same, how).drop(*[f"{c}__dim" for c in on])


def unique_lookup(dim: DataFrame, key: list[str]) -> DataFrame:
    """The lookup table itself, failing at run time when a key occurs twice."""
    values = [c for c in dim.columns if c not in key]
    n = F.count(F.lit(1))
    return (
        dim.groupBy(*key)
        .agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in values], n.alias("n__rows"))
        .where(
            F.when(F.col("n__rows") == 1, F.lit(True)).otherwise(
                F.raise_error(F.lit("duplicate key in lookup table")).cast("boolean")
            )
        )
        .drop("n__rows")
    )
