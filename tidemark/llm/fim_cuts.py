"""Fill-in-middle transformation with cuts at line ends, looked up in a compressed boundary set.

The line ends of a text are code-point offsets in a set of containers, one for each 65,536
offsets that has any: a sorted array, a bitmap or a list of runs, whichever is smallest. The
set holds how many offsets come before each container, so that the offset of the k-th line end
is found by a search over containers and a select inside one; no list of lines is kept.

Defined results: a null or empty text is plain and has no lines; a text that holds a marker is
plain, so that every output can be taken apart again; very long texts have more containers; a
null id is treated as the empty text where it is hashed; repeated rows give equal rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
SPAN = 16  # low bits of an offset that a container holds
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ArrayContainer:
    """Sorted low bits."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    @staticmethod
    def bytes(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per offset, and how many are set before each stretch of 512 bits."""

    STRETCH = 64  # bytes

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << SPAN, np.uint8)
        bits[low] = 1
        self.packed = np.packbits(bits, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 8 * self.STRETCH).sum(axis=1, dtype=np.int64))])

    @staticmethod
    def bytes(low: np.ndarray) -> int:
        return (1 << SPAN) // 8

    def select(self, k: int) -> int:
        stretch = int(np.searchsorted(self.before, k, "right")) - 1
        at = stretch * self.STRETCH
        bits = np.unpackbits(self.packed[at : at + self.STRETCH], bitorder="little")
        return 8 * at + int(np.flatnonzero(bits)[k - self.before[stretch]])


class RunContainer:
    """Starts of runs of consecutive offsets, and how many offsets come before each."""

    def __init__(self, low: np.ndarray) -> None:
        first = self.starts(low)
        self.first, self.before = low[first].astype(np.uint16), first

    @staticmethod
    def starts(low: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))

    @classmethod
    def bytes(cls, low: np.ndarray) -> int:
        return 4 * len(cls.starts(low))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


class BoundarySet:
    """A set of offsets that answers which is the k-th smallest."""

    def __init__(self, offsets: np.ndarray) -> None:
        """``offsets`` are ascending and distinct."""
        keys = offsets >> SPAN
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[cuts]
        self.before = np.concatenate([cuts, [len(offsets)]])
        self.containers = []
        for lo, hi in zip(self.before[:-1], self.before[1:]):
            low = offsets[lo:hi] & ((1 << SPAN) - 1)
            kind = min((ArrayContainer, RunContainer, BitmapContainer), key=lambda k: k.bytes(low))
            self.containers.append(kind(low))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << SPAN) + self.containers[at].select(k - int(self.before[at]))

    def after(self, units: int) -> int:
        """The offset at which the first ``units`` units end."""
        return self.select(units - 1) if units else 0


def line_ends(texts) -> list[np.ndarray]:
    """Code-point offsets of the ends of all lines of each text."""
    data, bounds = W.closed(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    breaks = np.flatnonzero(data == 10)
    spans = np.searchsorted(breaks, bounds)
    out = []
    for d in range(len(bounds) - 1):
        ends = chars[breaks[spans[d] : spans[d + 1]] + 1] - chars[bounds[d]]
        size = int(chars[bounds[d + 1]] - chars[bounds[d]]) - 1  # without the line end that closes each text
        ends = ends[:-1]
        if size and (not len(ends) or ends[-1] < size):
            ends = np.append(ends, size)
        out.append(ends)
    return out


def _transform(fim_percent: int, spm_percent: int):
    def run(batches):
        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text"):
                rows = []
                hashes = zip(*[part.column(f"h{i}").to_pylist() for i in range(1, 5)])
                texts = zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                for (name, text), ends, (h1, h2, h3, h4) in zip(texts, line_ends(part.column("text")), hashes):
                    text, bounds = text or "", BoundarySet(ends)
                    n = len(bounds)
                    if not text or h3 % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        rows.append((name, n, "plain", None, None, text))
                        continue
                    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = bounds.after(i), bounds.after(j)
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    if h4 % 100 < spm_percent:
                        rows.append((name, n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                    else:
                        rows.append((name, n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                yield from pa.table([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names).to_batches()

    return run


def fill_in_middle(
    docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED,
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``doc_id``, number of lines ``n``, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Cuts, share of transformed texts and form follow from a hash of the seed and the id only, so a
    task that runs again gives the same rows. Nothing is shuffled.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), *parts)
    return rows.mapInArrow(_transform(fim_percent, spm_percent), OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
