"""Term weights by a fitted vocabulary: sparse embeddings, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import spread_row_number
from tidemark.session import materialise

#: Terms kept in a vocabulary, the most frequent ones.
MAX_TERMS = 65_536


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("\\S+"), 0)


def fit_vocabulary(df: DataFrame, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, slot, n_texts, idf) of the ``max_terms`` terms that most texts have, ties by term.

    Every row is a text and counts, null and empty ones too; ``idf`` is ln((1 + n) / (1 + n_texts)) + 1.
    Terms are counted where they are read before anything is shuffled, and ranked over all tasks.
    The table is written: its size is known to the joins that use it.
    """
    terms = df.select(F.explode(F.array_distinct(_terms(F.col(text)))).alias("term"))
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_texts"))
    ranked = spread_row_number(seen, [], [F.col("n_texts").desc(), F.col("term")], "place")
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    idf = F.log((F.lit(total) + 1) / (F.col("n_texts") + 1)) + 1
    kept = ranked.where(F.col("place") <= max_terms)
    slot = (F.col("place") - 1).cast("int")
    return materialise(kept.select("term", slot.alias("slot"), "n_texts", idf.alias("idf")), "vocabulary")


def term_weights(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, slot, weight) with weight = occurrences x idf; a text without a known term has one row
    with nulls. Rows of one key are one text."""
    words = df.select(F.col(key), F.explode_outer(_terms(F.col(text))).alias("term"))
    counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(vocabulary.select("term", "slot", "idf"), "term", "left")
    return known.select(key, "slot", (F.col("n") * F.col("idf")).alias("weight"))


def embed_tfidf(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, terms): (slot, weight) by slot, of length 1; empty for a text without a known term.

    Only distinct words of a text are shuffled, a text has at most as many entries as the vocabulary.
    """
    entry = F.when(F.col("slot").isNotNull(), F.struct("slot", "weight"))
    rows = term_weights(df, key, text, vocabulary).groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("terms"))
    # The squares are summed by slot, so the sum doesn't depend on the order of rows; once per text.
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]))
    unit = lambda n: F.transform("terms", lambda e: F.struct(e["slot"], (e["weight"] / n).alias("weight")))
    return rows.select(key, F.transform(F.array(norm), unit)[0].alias("terms"))
