"""Approximate similarity search by locality-sensitive filters, with exact scores.

A filter is a direction in the space of vectors. A vector passes it when its projection on the
direction is at least ``level`` (in standard deviations over all unit vectors), so a document
is listed under the few filters it passes. A question probes the filters it projects on most.
For a document with cosine ``like`` to a question whose projection is m, the chance to pass is
that of a normal variable with mean ``like * m`` and variance ``1 - like**2`` to reach the level;
probes are added until the chance that all miss is small enough for the stated recall.

A direction and its opposite are two filters. Their number, the level and the chance aimed at are
sized on a bounded sample of questions and documents: of all sizes that reach the stated recall on
it and score no more than the stated share of pairs, the one with the fewest index rows. Neighbours
that are alike need few and coarse filters; among random vectors, whose neighbours are hardly nearer
than the rest, tens of thousands are taken and ``knn`` is faster. Every document is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup_join
from tidemark.operators.retrieve import _final
from tidemark.session import materialise

SAMPLE_QUESTIONS, SAMPLE_DOCS = 64, 4096
DIRECTIONS, LEVELS, AIMS = (32, 128, 512, 2048, 8192, 32768), (2.0, 2.4, 2.8, 3.0), (0.5, 0.3, 0.15)
#: Projections held at a time by one task.
CELLS = 8_000_000


@lru_cache(maxsize=2)
def _directions(dims: int, n: int, seed: int) -> np.ndarray:
    """Directions of one length, on which unit vectors project with variance one."""
    out = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    return out * (np.float32(sqrt(dims)) / np.linalg.norm(out, axis=1, keepdims=True))


def _units(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, np.float64) for v in vectors])
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


@dataclass(frozen=True)
class Filters:
    """The index: its directions follow from the seed, so that all tasks agree on them."""

    dims: int
    directions: int
    level: float
    like: float
    recall: float
    seed: int = 17

    def projections(self, units: np.ndarray) -> np.ndarray:
        """Of each vector on each filter: the directions, then their opposites."""
        found = units.astype(np.float32) @ _directions(self.dims, self.directions, self.seed).T
        return np.concatenate([found, -found], axis=1)

    def passed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the vector, and of a filter it passes."""
        rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // (2 * self.directions))
        for lo in range(0, len(units), step):
            row, which = np.nonzero(self.projections(units[lo : lo + step]) >= self.level)
            rows.append(row + lo)
            filters.append(which)
        return np.concatenate(rows), np.concatenate(filters)

    def probes(self, units: np.ndarray) -> list[np.ndarray]:
        """The filters that each question has to look in."""
        spread, most = sqrt(max(1e-9, 1 - self.like**2)), -np.log(1 - self.recall)
        out = []
        for unit in units:
            all_ = self.projections(unit[None])[0]
            size = 64
            while True:
                top = np.argpartition(-all_, size - 1)[:size] if size < len(all_) else np.arange(len(all_))
                top = top[np.lexsort((top, -all_[top]))]
                chance = [0.5 * (1 + erf((self.like * float(m) - self.level) / spread / sqrt(2))) for m in all_[top]]
                met = -np.cumsum(np.log1p(-np.minimum(chance, 1 - 1e-12)))
                enough = int(np.searchsorted(met, most))
                if enough < len(top) or len(top) == len(all_):
                    out.append(top[: enough + 1])
                    break
                size *= 4
        return out


def _met(filters: Filters, questions: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """Which sampled documents each sampled question would be scored with."""
    known = _directions(filters.dims, filters.directions, filters.seed)
    docs, out = docs.astype(np.float32), []
    for probes in filters.probes(questions):
        met = np.zeros(len(docs), bool)
        step = max(1, CELLS // max(1, len(docs)))
        for lo in range(0, len(probes), step):
            at = probes[lo : lo + step]
            sign = np.where(at < filters.directions, 1, -1).astype(np.float32)
            met |= (docs @ (known[at % filters.directions] * sign[:, None]).T >= filters.level).any(axis=1)
        out.append(met)
    return out


def sized(questions: np.ndarray, ks: np.ndarray, docs: np.ndarray, recall: float, share: float) -> Filters:
    """The smallest index that, on these samples, finds ``recall`` of the ``k`` best and scores at most
    ``share`` of all pairs; if none scores so few, the one that scores the fewest; if none finds so
    many, as with vectors of very few numbers, all pairs.

    ``ks`` are numbers of neighbours among these documents. The cosine to be found is the lower
    quartile over the questions of that of the last neighbour.
    """
    scores = questions @ docs.T
    order = np.argsort(-scores, axis=1, kind="stable")
    best = [order[i, :k] for i, k in enumerate(ks)]
    like = float(np.clip(np.quantile([scores[i, b[-1]] for i, b in enumerate(best)], 0.25), 0.05, 0.995))
    tail = lambda level: 1 - erf(level / sqrt(2))
    sizes = sorted((n * tail(level), n, level) for n in DIRECTIONS for level in LEVELS)
    fewest: tuple[float, Filters] | None = None
    for lists, n, level in sizes:
        for part in AIMS if lists >= 1 else ():  # chances of near directions are not independent: aim higher
            filters = Filters(docs.shape[1], n, level, like, 1 - part * (1 - recall))
            met = _met(filters, questions, docs)
            found = sum(m[b].sum() for m, b in zip(met, best)) / sum(map(len, best))
            scored = float(np.mean([m.mean() for m in met]))
            if found >= 1 - 0.8 * (1 - recall) and scored <= share:
                return filters
            if found >= recall and (fewest is None or scored < fewest[0]):
                fewest = scored, filters
            if scored > share:
                break
    return fewest[1] if fewest else everything(docs.shape[1])


def everything(dims: int) -> Filters:
    """An index of two filters that every vector passes: all pairs are scored."""
    return Filters(dims, 1, -1e9, 0.5, 0.5)


def _sample(df: DataFrame, n: int) -> list:
    """At most ``n`` rows by the hash of their id."""
    key = df.columns[0]
    return df.orderBy(F.xxhash64(key), key).limit(n).collect()


def fit_filters(docs: DataFrame, questions: DataFrame, recall: float = 0.9, share: float = 0.2) -> Filters:
    """An index for these tables, sized on at most ``SAMPLE_QUESTIONS`` questions and ``SAMPLE_DOCS`` documents."""
    asked = _sample(questions.where("vector IS NOT NULL").select("qid", "vector", "k"), SAMPLE_QUESTIONS)
    known = docs.where("vector IS NOT NULL")
    some = _sample(known.select("id", "vector"), SAMPLE_DOCS)
    if not asked or not some:
        return everything(2)
    n = known.count()
    ks = np.array([min(len(some), max(1, round(r["k"] * len(some) / n))) for r in asked])
    return sized(_units(r["vector"] for r in asked), ks, _units(r["vector"] for r in some), recall, share)


def _listed(filters: Filters, probes: bool):
    def run(batches):
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                units = _units(part.column(1).to_pylist())
                if probes:
                    found = filters.probes(units)
                    rows, which = np.repeat(np.arange(len(units)), [len(f) for f in found]), np.concatenate(found)
                else:
                    rows, which = filters.passed(units)
                keys = part.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([keys, pa.array(which, pa.int32())], [batch.schema.names[0], "filter"])

    return run


def _rows(df: DataFrame, filters: Filters, probes: bool) -> DataFrame:
    key = df.columns[0]
    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(_listed(filters, probes), f"{key} {kind}, filter int")


def candidates(docs: DataFrame, questions: DataFrame, filters: Filters) -> DataFrame:
    """Distinct pairs ``(qid, id)`` that share a filter: one equi-join on the filter, whose hot lists
    are split at run time. ``docs(id, vector)`` and ``questions(qid, vector)`` without nulls."""
    index = _rows(docs.select("id", "vector"), filters, False)
    probes = _rows(questions.select("qid", "vector"), filters, True)
    return lookup_join(index, probes, ["filter"], "inner").select("qid", "id").distinct()


def _unit(vector):
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def knn_lsh(
    docs: DataFrame, questions: DataFrame, recall: float = 0.9, share: float = 0.2, filters: Filters | None = None
) -> DataFrame:
    """As ``knn`` by cosine without conditions, approximately: ``(qid, rank, id, score)``.

    Scores are exact, and so is the order of what is found; on the sample the index is sized on,
    ``recall`` of the ``k`` best are found. Equal vectors are one entry of the index with its ``k``
    smallest ids, so a vector that a third of all documents have is scored once. Rows without a
    vector are left out, ties go to the smaller id. ``knn`` is the exact form.
    """
    filters = filters or fit_filters(docs, questions, recall, share)
    asked = materialise(questions.where("vector IS NOT NULL").select("qid", "k", _unit("vector").alias("vector")), "asked")
    most = asked.agg(F.max("k")).first()[0] or 0
    same = Window.partitionBy("vector").orderBy("id")
    ranked = docs.where("vector IS NOT NULL").select("id", "vector").withColumn("place", F.row_number().over(same))
    ranked = materialise(ranked.where(F.col("place") <= most).withColumn("head", F.min("id").over(Window.partitionBy("vector"))), "heads")
    heads = ranked.where("id = head").select("id", "vector")
    pairs = candidates(heads, asked, filters)
    score = F.aggregate(F.zip_with("q", "d", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = lookup_join(pairs.join(heads.select("id", _unit("vector").alias("d")), "id"), asked.withColumnRenamed("vector", "q"), ["qid"], "inner")
    scored = met.select("qid", "k", F.col("id").alias("head"), (F.round(score, 9) + 0.0).alias("score"))
    return _final(scored.join(ranked.select("head", "id"), "head").select("qid", "k", "id", "score"))
