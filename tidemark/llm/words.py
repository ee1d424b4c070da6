"""Words of whole texts and their hashes, on Arrow columns inside a task.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. Every function works on
whole texts; a null text has no words. Hashes depend on the bytes alone, so a task that runs
again on another machine gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTES = _series(256, 1)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            steps = np.full(SEGMENT + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


@dataclass
class Words:
    """The words of some texts: byte ranges in ``data``, number of the text, hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the number of words
    hashes: np.ndarray

    def grams(self, k: int, seed: int = 7) -> np.ndarray:
        """Hash of the ``k`` words from each word on; only those of ``self.whole(k)`` count."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j, c in enumerate(_series(k, seed)):
                out += self.hashes[j : j + n] * (c | np.uint64(1))
        return mixed(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on lie in one text."""
        n = max(0, len(self.doc) - k + 1)
        return self.doc[k - 1 : k - 1 + n] == self.doc[:n]


def closed(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, a line end after each, and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def split(texts, lower: bool = False, hashed: bool = True) -> Words:
    data, bounds = closed(texts)
    word = ~BLANK[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(before & ~word)
    doc = np.searchsorted(bounds, starts, "right") - 1
    first = np.searchsorted(starts, bounds)
    if lower:
        data = LOWER[data]
    return Words(data, starts, ends, doc, first, word_hashes(data, starts, ends) if hashed else np.zeros(0, np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of the bytes of each word, in segments of bounded size."""
    power, inverse = _tables()
    out = np.zeros(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = starts[i]
            j = int(np.searchsorted(ends, at + SEGMENT, "right"))
            if j <= i:  # one word longer than a segment
                total, size = 0, int(ends[i] - at)
                for lo in range(0, size, SEGMENT):
                    part = _BYTES[data[at + lo : at + min(size, lo + SEGMENT)]]
                    total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, lo, 1 << 64)
                out[i] = total & _MASK
                i += 1
                continue
            sums = np.zeros(int(ends[j - 1] - at) + 1, np.uint64)
            np.cumsum(_BYTES[data[at : ends[j - 1]]] * power[: len(sums) - 1], out=sums[1:])
            lo, hi = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (sums[hi] - sums[lo]) * inverse[lo]
            i = j
        return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def slices(table, column: str, most: int = 4 << 20) -> Iterator:
    """Consecutive rows with about ``most`` bytes of text; a longer text comes alone."""
    if not table.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0)
    sizes = (sizes.combine_chunks() if isinstance(sizes, pa.ChunkedArray) else sizes).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < table.num_rows:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield table.slice(at, end - at)
        at = end


def planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of 64-bit values, byte by byte: planes of equal bytes pack well."""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def from_planes(raw, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()
