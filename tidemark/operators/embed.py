"""Text embeddings: a pluggable encoder over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]

_WORD = re.compile(r"\S+", re.ASCII)


class _Slots(dict):
    """Word to slot, filled as words are met; emptied when it grows too large."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        self[word] = slot
        return slot


def hash_encoder(dim: int = 64) -> Encoder:
    """Bag of words hashed to ``dim`` counts, unit length. Needs no model file."""
    slots = _Slots(dim)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            hits = [slots[w] for w in _WORD.findall(text.lower())]
            out[row] = np.bincount(hits, minlength=dim) if hits else 0
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)

    return encode


def encode_column(text: Column, make_encoder: Callable[[], Encoder]) -> Column:
    """Embedding of a text column. The encoder is built once per Python worker task.

    Marked as not deterministic, else a filter on the result (which ``explode`` implies)
    would be pushed below it and encode every text a second time.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for batch in batches:
            yield pd.Series(list(encode(batch.fillna("").tolist())))

    return run.asNondeterministic()(text)


def embed_text(
    df: DataFrame,
    text: str,
    out: str = "values",
    make_encoder: Callable[[], Encoder] = hash_encoder,
) -> DataFrame:
    """Add the embedding; rows stay where they are read (see ``session.spread_scan``)."""
    return df.withColumn(out, encode_column(F.col(text), make_encoder))


def embedding_dims(df: DataFrame, vector: str, n: int = 3, order: str = "id") -> DataFrame:
    """Length of the first ``n`` embeddings."""
    return df.orderBy(order).limit(n).select(order, F.size(vector).alias("dimensions"))
