"""A corpus pipeline of five stages, each of which reads what its predecessor kept.

Each stage takes and, but for the last, returns the columns of ``documents`` (more columns are
carried along). Rejected are: documents the quality classifier scores under ``QUALITY``; all
but the smallest id of linked documents, and rows that repeat both id and text; words of repeats from smaller
documents, and documents that consist of such words alone; documents the mixture leaves out.
A null text is scored, linked and packed as an empty one and stays null until it is packed;
rows with a null id are linked with nothing. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import block_anchors, prefix_join, quality_ftrl, raking, window_packing
from tidemark.operators.ranking import spread_row_number
from tidemark.session import materialise

QUALITY = 0.3


def _bare(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with all columns but id and text renamed, so that none clashes; and their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"other_{i}") for i, c in enumerate(others)]), others


def _restored(rows: DataFrame, others: list[str], docs: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({f"other_{i}": c for i, c in enumerate(others)}).select(*[F.col(f"`{c}`") for c in docs.columns])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this table's rows, does not reject."""
    bare, others = _bare(docs)
    weights = quality_ftrl.train(bare, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_ftrl.scored(bare, weights, tuple(c for c in bare.columns if c not in ("doc_id", "text")))
    return _restored(scored.where(F.col("quality_score") >= QUALITY), others, docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest id, of equal ids the smallest text.

    Links are between rows, not ids: where an id occurs more than once, rows are first numbered in
    the order of id and text, so that a unique text stays whatever other row has its id. Of rows
    equal in id and text one stays, that with the smallest other columns.
    """
    bare, others = _bare(docs)
    known = bare.where("doc_id IS NOT NULL")
    again = materialise(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        keyed = known.withColumn("row__key", F.col("doc_id"))
    else:
        rest = [c for c in bare.columns if c not in ("doc_id", "text")]
        first = F.min(F.struct(F.lit(0).alias("row__none"), *rest)).alias("row__rest")
        repeated = known.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(first)
        repeated = repeated.select("doc_id", "text", *[F.col(f"row__rest.{c}").alias(c) for c in rest])
        rows = known.join(again, "doc_id", "left_anti").select(*bare.columns).unionByName(repeated)
        keyed = materialise(spread_row_number(rows, [], [F.col("doc_id"), F.col("text")], "row__key"), "keyed")
    linked = prefix_join.linked_documents(keyed.select("row__key", "text"), id="row__key")
    first = materialise(linked.select("doc_id", "component_id"), "linked").where("doc_id = component_id")
    kept = keyed.join(first.select(F.col("doc_id").alias("row__key")), "row__key", "left_semi").select(*bare.columns)
    return _restored(kept.unionByName(bare.where("doc_id IS NULL")), others, docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller one has; with their new length."""
    bare, others = _bare(docs)
    carry = tuple(c for c in bare.columns if c not in ("doc_id", "text"))
    rows = block_anchors.without_repeats(bare, carry=carry, untouched=True)
    rows = rows.where("n_removed = 0 OR n_removed < n_words").withColumnRenamed("kept_text", "text")
    if "n_chars" in others:
        name = f"other_{others.index('n_chars')}"
        kind = dict(bare.dtypes)[name]
        rows = rows.withColumn(name, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(name)).cast(kind))
    return _restored(rows, others, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights."""
    return raking.sampled_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that fill windows of tokens."""
    return window_packing.packed_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("substring dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]
#: SQL can't express trained scores and tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, "stage")
    return docs
