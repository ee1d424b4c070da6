"""Labelled texts for training: the rows a model may learn from, in a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id: Column) -> Column:
    """Whether a row is kept from training: its fold is 0."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``text``, ``y`` and ``share`` (how many labelled rows of this class a row of the sample stands for) of
    at most ``per_class`` rows of each class outside fold 0, chosen by the hash of their id.

    Nulls and values other than 0 and 1 are no labels; of repeated labels the largest counts. The ids
    are at most ``2 * per_class`` pairs of numbers, so they are sent to the scans of the texts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, n in sorted(counts.items()):
        rows = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = rows.withColumn("share", F.lit(n / min(n, per_class)))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    if chosen is None:
        chosen = known.withColumn("share", F.lit(1.0))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", "share")
