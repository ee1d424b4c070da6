"""Filtered top-k similarity search and context assembly for many questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.text import prompt, strip
from tidemark.operators.ranking import top_k
from tidemark.session import materialise

DOC_BLOCK = 20_000
QUESTION_BLOCK = 2_000
# Scores held at a time by one task.
SCORE_CELLS = 4_000_000
_SCORE_DECIMALS = 9


def _unit(rows: list, cosine: bool) -> np.ndarray:
    m = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    if cosine and len(m):
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    return m


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _score_block(
    qids: np.ndarray, ks: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray,
    low: np.ndarray, high: np.ndarray, at: np.ndarray,
) -> pd.DataFrame:
    """The ``k`` best documents of this block for each question, of those with ``at`` from ``low`` to
    ``high`` where these are given; never all pairs."""
    out_q, out_i, out_s, out_k = [], [], [], []
    step = max(1, SCORE_CELLS // max(len(ids), 1))
    for start in range(0, len(qids) if len(ids) else 0, step):
        scores = np.round(q[start : start + step] @ d.T, _SCORE_DECIMALS) + 0.0
        for row, found in enumerate(scores, start):
            inside = np.ones(len(ids), bool) if np.isnan(low[row]) else (at >= low[row]) & (at <= high[row])
            inside = np.flatnonzero(inside)
            best = inside[_best(found[inside], ids[inside], int(ks[row]))]
            out_q.append(np.repeat(qids[row], len(best)))
            out_k.append(np.repeat(ks[row], len(best)))
            out_i.append(ids[best])
            out_s.append(found[best])
    parts = {"qid": out_q, "k": out_k, "id": out_i, "score": out_s}
    return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in parts.items()})


def _final(hits: DataFrame) -> DataFrame:
    order = [F.col("score").desc(), F.col("id")]
    ranked = top_k(
        hits, ["qid"], order, F.col("k"), "rank", spread=F.pmod(F.xxhash64("id"), F.lit(32))
    )
    return ranked.select("qid", "rank", "id", "score")


def knn(
    docs: DataFrame,
    questions: DataFrame,
    on: list[str] | None = None,
    cosine: bool = True,
    span: tuple[str, str, str] | None = None,
) -> DataFrame:
    """``k`` most similar documents per question, exactly: ``(qid, rank, id, score)``.

    ``docs(id, vector, *on)`` and ``questions(qid, vector, k, *on)``; a question meets
    the documents whose ``on`` columns are equal and may have several ``on`` rows. ``span``
    names columns ``low`` and ``high`` of questions and one of documents that must lie between
    them; a null ``low`` admits all. Scores are rounded to nine decimals so that copies tie;
    ties go to the smaller id. Rows without a vector are left out.
    """
    on = on or []
    low, high, at = (F.col(c).cast("double") for c in span) if span else [F.lit(None).cast("double")] * 3
    docs = docs.where("vector IS NOT NULL").withColumn("span__at", at)
    questions = questions.where("vector IS NOT NULL").withColumns({"span__low": low, "span__high": high})
    if not on:
        on = ["cell__v"]
        docs, questions = (df.withColumn("cell__v", F.lit(0)) for df in (docs, questions))
    hits = _knn_grid(docs, questions, on, cosine)
    # Spans of one question may overlap; a document still counts once.
    return _final(hits.dropDuplicates(["qid", "id"]) if span else hits)


def _hit_schema(docs: DataFrame, questions: DataFrame) -> str:
    q = questions.schema["qid"].dataType.simpleString()
    i = docs.schema["id"].dataType.simpleString()
    k = questions.schema["k"].dataType.simpleString()
    return f"qid {q}, k {k}, id {i}, score double"


def _knn_grid(docs: DataFrame, questions: DataFrame, on: list[str], cosine: bool) -> DataFrame:
    """Block grid: each cell of equal ``on`` values is cut into as many document and
    question blocks as its counts ask for, so a cell with a third of all rows becomes
    many small tasks. Only ids and vectors are shuffled; a block returns ``k`` rows per
    question."""
    d_sizes = docs.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / DOC_BLOCK).cast("int").alias("nd"))
    q_sizes = questions.groupBy(*on).agg(
        F.ceil(F.count(F.lit(1)) / QUESTION_BLOCK).cast("int").alias("nq")
    )
    grid = materialise(d_sizes.join(q_sizes, on), "grid")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        questions.join(grid, on)
        .withColumn("qb", block("qid", "nq"))
        .withColumn("db", every("nd"))
        .select(*on, "qb", "db", "qid", "k", "vector", "span__low", "span__high")
    )
    right = (
        docs.select("id", "vector", "span__at", *on)
        .join(grid, on)
        .withColumn("db", block("id", "nd"))
        .withColumn("qb", every("nq"))
        .select(*on, "qb", "db", "id", "vector", "span__at")
    )

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"qid": [], "k": [], "id": [], "score": []})
        return _score_block(
            q["qid"].to_numpy(),
            q["k"].to_numpy(),
            _unit(list(q["vector"]), cosine),
            d["id"].to_numpy(),
            _unit(list(d["vector"]), cosine),
            *(x.to_numpy(dtype=float, na_value=np.nan) for x in (q["span__low"], q["span__high"], d["span__at"])),
        )

    cells = [*on, "qb", "db"]
    return (
        left.groupBy(*cells)
        .cogroup(right.groupBy(*cells))
        .applyInPandas(score, _hit_schema(docs, questions))
    )


def contexts(hits: DataFrame, texts: DataFrame, prefix: str = C.CONTEXT_PREFIX) -> DataFrame:
    """Texts of the hits in rank order, prefixed, one line each: ``(qid, context)``.

    Blank texts are skipped. Texts are joined only now, to at most ``k`` ids a question;
    the hits are written first so that their measured size decides the join and the texts
    need not be shuffled.
    """
    hits = materialise(hits.select("qid", "rank", "id"), "hits")
    line = F.concat(F.lit(prefix), strip(F.col("text")))
    ranked = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return (
        hits.join(texts.select("id", "text"), "id")
        .where(F.length(strip(F.col("text"))) > 0)
        .groupBy("qid")
        .agg(F.array_join(F.transform(ranked, lambda r: r["line"]), "\n").alias("context"))
    )


def prompts(questions: DataFrame, context: DataFrame, text: str = "question") -> DataFrame:
    """One prompt per question; a question without context gets the fallback template."""
    return questions.join(context, "qid", "left").withColumn(
        "prompt", prompt(F.col(text), F.col("context"))
    )
