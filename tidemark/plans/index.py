"""Result rows to documents, documents to vector records, questions to prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.text import sentence
from tidemark.operators.embed import Encoder, embed_text, hash_encoder
from tidemark.operators.retrieve import contexts, knn, prompts
from tidemark.session import materialise
from tidemark.sources.vectors import to_records, upsert_vectors


def row_documents(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """One document per row: ``(keep, Année, type, text)``; the type is the lower-cased name.

    Columns in ``keep`` are passed on and, like all others, named in the text.
    """
    tagged = df.withColumn("type", F.lit(name.lower()))
    return tagged.select(
        *(keep or []),
        F.col(f"`{C.YEAR}`").cast("int").alias(C.YEAR),
        "type",
        sentence(tagged.schema, name).alias("text"),
    )


def all_documents(tables: dict[str, DataFrame], keep: list[str] | None = None) -> DataFrame:
    docs = [row_documents(df, name, keep) for name, df in tables.items()]
    out = docs[0]
    for d in docs[1:]:
        out = out.unionByName(d)
    return out


def build_index(
    spark: SparkSession,
    documents: DataFrame,
    id_: Column,
    path: str,
    source: str = C.VECTOR_SOURCE,
    make_encoder: Callable[[], Encoder] = hash_encoder,
) -> DataFrame:
    """Embed documents and upsert them in one bulk write; ids must be unique. ``source`` is that of
    documents without such a column."""
    tagged = documents if C.SOURCE in documents.columns else documents.withColumn(C.SOURCE, F.lit(source))
    records = to_records(embed_text(tagged, "text", "values", make_encoder), id_)
    return upsert_vectors(spark, records, path)


def answer_prompts(
    questions: DataFrame,
    records: DataFrame,
    make_encoder: Callable[[], Encoder] = hash_encoder,
    source: str = C.VECTOR_SOURCE,
) -> DataFrame:
    """Prompts for many questions in one job.

    ``questions(qid, question, k, ranges array<struct<lo int, hi int, type string>>)``.
    Only records of ``source`` are searched, a condition that reaches the scan. A question
    meets the records of the types of its ranges, with the year in the range; without ranges
    it meets all. Types are compared folded.
    """
    found = records.where(F.col(f"metadata.{C.SOURCE}") == source)
    docs = found.select(
        "id",
        F.col("values").alias("vector"),
        F.coalesce(F.lower("metadata.type"), F.lit("")).alias("cell_type"),
        F.col(f"metadata.{C.YEAR}").alias("at"),
    )
    # Written once: the grids read the vectors more than once, and encoders are costly.
    embedded = materialise(embed_text(questions, "question", "vector", make_encoder), "questions")
    ranged = F.coalesce(F.size("ranges") > 0, F.lit(False))
    cells = embedded.where(ranged).select("qid", "vector", "k", F.inline("ranges"))
    hits = knn(docs, cells.withColumn("cell_type", F.lower("type")), on=["cell_type"], span=("lo", "hi", "at"))
    # A question without ranges isn't copied to the types: it meets all records in one grid.
    hits = hits.union(knn(docs, embedded.where(~ranged).select("qid", "vector", "k")))
    texts = found.select("id", F.col("metadata.text").alias("text"))
    return prompts(questions, contexts(hits, texts))
