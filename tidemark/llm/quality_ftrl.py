"""Text quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A word gives three features and each pair of neighbours two: the lower-cased word, its shape
(runs of lower, upper, digit and other characters), whether it repeats the word before, the
pair of words and the pair of shapes. Features are hashed to ``2 ** BITS`` weights; a document
is the vector of the square roots of its counts, of length one, and its score the logistic of
a sparse dot product. Training sees a sample of bounded size (``PER_CLASS`` rows of each
label), which one task reads in a fixed order; the bias is then set back to the true share of
the labels. The weights have a fixed size, so they are sent to every task.

Defined results: a null or empty text gets the score of the bias alone; whole texts are scored,
however long; equal texts get equal scores; without labels every score is 0.5; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.labelled import sample

BITS, PER_CLASS, STEPS = 18, 4000, 16000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: Bytes of text whose features are held at a time.
SLICE = 1 << 20

# Classes of bytes for the shape of a word: every byte that no class holds is its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _shapes(w: W.Words) -> np.ndarray:
    kinds = _CLASS[w.data]
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[w.starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    return W.word_hashes(kinds[new], at[w.starts], at[w.ends])


def features(texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights used, their values, and where those of each text begin."""
    w = W.split(texts, lower=True)
    shapes = _shapes(W.Words(W.closed(texts)[0], w.starts, w.ends, w.doc, w.first, w.hashes))
    pair = w.doc[1:] == w.doc[:-1]
    parts = []
    with np.errstate(over="ignore"):
        for kind, (value, doc) in enumerate((
            (w.hashes, w.doc),
            (shapes, w.doc),
            ((w.hashes[1:] == w.hashes[:-1])[pair].astype(np.uint64), w.doc[1:][pair]),
            ((w.hashes[:-1] * np.uint64(3) + w.hashes[1:])[pair], w.doc[1:][pair]),
            ((shapes[:-1] * np.uint64(3) + shapes[1:])[pair], w.doc[1:][pair]),
        )):
            low = W.mixed(value + np.uint64(kind << 40)) & np.uint64((1 << bits) - 1)
            parts.append(doc.astype(np.uint64) << np.uint64(bits) | low)
    keys = np.sort(np.concatenate(parts))
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    values = np.sqrt(np.diff(np.append(at, len(keys))))
    keys = keys[at]
    doc = (keys >> np.uint64(bits)).astype(np.int64)
    n = len(w.first) - 1
    norm = np.sqrt(np.bincount(doc, weights=values**2, minlength=n))
    values /= norm[doc] if len(doc) else 1
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), values, np.searchsorted(doc, np.arange(n + 1))


def fit(texts, y: np.ndarray, share: np.ndarray, bits: int = BITS, steps: int = STEPS) -> np.ndarray:
    """Weights, and the bias at the end."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    # In slices, so that the sorted features of all texts are never held at once.
    parts = [features(part.column("text"), bits) for part in W.slices(pa.table({"text": texts}), "text", SLICE)]
    at = np.concatenate([np.zeros(0, np.int32), *(p[0].astype(np.int32) for p in parts)])
    values = np.concatenate([np.zeros(0, np.float32), *(p[1].astype(np.float32) for p in parts)])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, int), *(np.diff(p[2]) for p in parts)]))])
    for epoch in range(-(-steps // max(len(y), 1))):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            lo, hi = bounds[i], bounds[i + 1]
            idx = np.append(at[lo:hi], size)
            x = np.append(values[lo:hi], 1.0)
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(x @ wi, -30, 30))) - y[i]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx] = zi + g - sigma * wi
            n[idx] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    if (y == 1).any() and (y == 0).any():
        w[size] += np.log(share[y == 1][0] / share[y == 0][0])
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> np.ndarray:
    """Weights fitted on a bounded sample; the only thing that reaches the driver, of fixed size."""

    def run(table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        w = fit(table.column("text"), table.column("y").to_numpy(), table.column("share").to_numpy())
        return pa.table({"model": pa.array([w.tobytes()], pa.binary())})

    rows = sample(docs, labels, label, per_class).groupBy().applyInArrow(run, "model binary").collect()
    return np.frombuffer(rows[0][0], np.float32) if rows else np.zeros((1 << BITS) + 1, np.float32)


def probabilities(texts, weights: np.ndarray) -> np.ndarray:
    at, values, bounds = features(texts)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sums = np.bincount(doc, weights=weights[at] * values, minlength=len(bounds) - 1)
    return 1 / (1 + np.exp(-np.clip(sums + weights[-1], -30, 30)))


def scored(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` and the columns in ``carry`` of each row, with its ``quality_score``."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.select("doc_id", "text", *carry)

    def run(batches):
        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text", SLICE):
                p = pa.array(probabilities(part.column("text"), weights))
                yield from part.append_column("quality_score", p).to_batches()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("quality_score", DoubleType())]))
