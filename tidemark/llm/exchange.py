"""Sizes for the two-sided exchange of hashes between texts and hash ranges.

Texts lie in buckets by the hash of their id. A bucket sends each range of hashes one packed
array of the distinct values it has in that range; a range answers each bucket with those of
its values that occur elsewhere. A hash that a third of all texts hold is sent once per
bucket, not once per text, and no task ever holds more than a bucket or a range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import from_planes, planes

#: Texts of a bucket and hashes of a range stay between these bounds; up to the upper one both
#: grow with the input, so that the number of packed arrays grows more slowly than its square.
BUCKET_BYTES = (128 << 10, 16 << 20)
RANGE_HASHES = (32 << 10, 8 << 20)
SPREAD = 384


@dataclass(frozen=True)
class Layout:
    buckets: int
    ranges: int


def layout(docs: DataFrame, text: str = "text") -> Layout:
    """From one sum over the lengths of all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bucket = min(max(size // SPREAD, BUCKET_BYTES[0]), BUCKET_BYTES[1])
    hashes = min(max(size // 6 // SPREAD, RANGE_HASHES[0]), RANGE_HASHES[1])
    return Layout(int(size // bucket) + 1, int(size // 6 // hashes) + 1)


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(71)), F.lit(n)).cast("int")


def cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def hash_range(top32: np.ndarray, ranges: int) -> np.ndarray:
    return ((top32 * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


def none(*names: str) -> pa.Table:
    return pa.table({n: pa.array([], pa.int32() if n in "rb" else pa.binary()) for n in names})


def gathered(table: pa.Table, widths: dict[str, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets and unpacked values of the packed rows of one range."""
    out, sizes = [], None
    for name, width in widths.items():
        parts = [from_planes(x, width) for x in table.column(name).to_pylist()]
        sizes = [len(x) for x in parts]
        out.append(np.concatenate(parts))
    return np.repeat(table.column("b").to_numpy(), sizes), out


def by_bucket(buckets: np.ndarray, columns: dict[str, tuple[np.ndarray, int]]) -> pa.Table:
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    ends = cuts(buckets)
    pieces = list(zip(ends[:-1], ends[1:]))
    data = {"b": pa.array(buckets[ends[:-1]], pa.int32())}
    for name, (values, width) in columns.items():
        values = values[order]
        data[name] = pa.array([planes(values[i:j], width) for i, j in pieces], pa.binary())
    return pa.table(data)
