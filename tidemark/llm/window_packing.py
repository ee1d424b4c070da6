"""Packing token sequences into windows by non-negative least squares.

Documents are tokenized and packed in cells of consecutive rows of a partition, each of a
bounded number of tokens, so nothing is shuffled and no task holds more than a cell. In a cell
whole windows are cut from long documents. What is left of each is a piece of less than a
window, and pieces are counted by length class. All combinations of at most ``DEPTH`` classes
that fill a window are enumerated, and repeat counts that use up the histogram are solved for
by non-negative least squares and rounded down. Pieces that no combination takes are residuals:
they are cut to fill, largest gap first, what the class widths left open in the combinations,
and the rest is packed greedily, cut where a window is full. What then remains of the cell's
last window is cut at powers of two, which need no padding.

Defined results: a null or empty text is one closing id; very long texts are cut; equal texts
and repeated rows are packed like any others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.tokens import VOCABULARY, encoded

WINDOW, CLASS, DEPTH, END = 2048, 64, 4, 1
CELL_BYTES = 4 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def combinations(classes: int, depth: int) -> np.ndarray:
    """Each way to write ``classes`` as a sum of at most ``depth`` whole numbers: how often each is used."""
    found = []

    def extend(parts: list[int], rest: int) -> None:
        if not rest:
            found.append(np.bincount(parts, minlength=classes + 1)[1:])
        elif len(parts) < depth:
            for size in range(min(rest, parts[-1] if parts else rest), 0, -1):
                if size * (depth - len(parts)) >= rest:
                    extend(parts + [size], rest - size)

    extend([], classes)
    return np.array(found, np.float64).T


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative ``x`` with a small ``|ax - b|``, by active sets."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(steps):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9:
            break
        free[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 1e-12)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x += step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
        x = np.where(free, np.maximum(trial, 0), 0)
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, width: int = CLASS, depth: int = DEPTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of every document once."""
    lengths = np.asarray(lengths, np.int64)
    out = [[(d, k * window, window)] for d in np.flatnonzero(lengths >= window) for k in range(lengths[d] // window)]
    rests = [(int(d), int(n - n % window), int(n % window)) for d, n in enumerate(lengths) if n % window]
    classes = -(-window // width)
    stacks: list[list[tuple[int, int, int]]] = [[] for _ in range(classes)]
    for piece in sorted(rests, key=lambda p: (p[2], p[0])):
        stacks[-(-piece[2] // width) - 1].append(piece)
    ways = combinations(classes, depth)
    repeats = np.floor(nnls(ways, np.array([len(s) for s in stacks], np.float64)) + 1e-6).astype(int)
    partial = []
    for way in np.argsort(-repeats, kind="stable"):
        use = ways[:, way].astype(int)
        for _ in range(repeats[way]):
            if any(len(stacks[c]) < use[c] for c in np.flatnonzero(use)):
                break
            partial.append([stacks[c].pop() for c in np.flatnonzero(use)[::-1] for _ in range(use[c])])
    left = [piece for stack in stacks[::-1] for piece in stack]
    gap = [window - sum(p[2] for p in s) for s in partial]
    order = sorted(range(len(partial)), key=lambda i: (gap[i], i))
    spare, need = sum(p[2] for p in left), sum(gap)
    while spare < need:  # the widest gap is undone: its pieces fill others
        i = order.pop()
        need -= gap[i]
        spare += window - gap[i]
        left += partial[i]
    left.reverse()

    def take(n: int) -> list[tuple[int, int, int]]:
        got = []
        while n and left:
            d, start, size = left.pop()
            if size > n:
                left.append((d, start + n, size - n))
                size = n
            got.append((d, start, size))
            n -= size
        return got

    out += [partial[i] + take(gap[i]) for i in order]
    rest = sum(p[2] for p in left)
    while rest >= window:
        out.append(take(window))
        rest -= window
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append(take(size))
        rest -= size
    return out


def _pack(vocabulary: str, window: int, exact: bool):
    def run(batches):
        sequence = TaskContext.get().partitionId() << 36
        held, size = [], 0

        def packed():
            nonlocal sequence
            table = pa.concat_tables(held)
            ids = [np.append(x, np.uint32(END)).astype("<u4") for x in encoded(table.column("text").to_pylist(), vocabulary, exact)]
            names = table.column("doc_id").to_pylist()
            rows = []
            for pieces in plan(np.array([len(x) for x in ids]), window):
                at = 0
                for d, start, n in pieces:
                    rows.append((names[d], start, n, ids[d][start : start + n].tobytes(), len(ids[d]), sequence, at))
                    at += n
                sequence += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], columns)

        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text", CELL_BYTES // 4):
                held.append(part)
                size += pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
                if size >= CELL_BYTES:
                    yield from packed().to_batches(4096)
                    held, size = [], 0
        if held:
            yield from packed().to_batches(4096)

    return run


def packed_pieces(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, exact: bool = False
) -> DataFrame:
    """One row per piece: its document, ``start`` and ``length`` there, ``ids`` (little-endian 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pack(vocabulary, window, exact), PIECES)
