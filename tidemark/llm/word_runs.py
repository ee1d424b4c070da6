"""Periodic runs of words, as maximal pairs found bottom-up in the LCP-interval tree of a text.

Two places of a text are a maximal pair when the words from them on agree for as long as
possible, L words, and the words before them differ. A pair q words apart with L >= q is the
stretch of q + L words with period q that neither neighbour extends, so pairs that meet the
length constraint are runs as they stand; nothing is extended or tested again.

Suffixes of all texts of a slice are sorted together by prefix doubling. Only places whose
first five words recur in their text can start a long enough pair; they form the subtrees of
depth five and more. A subtree in which all places follow the same word, or whose smallest
distance is too large for its deepest node, has no run and is left out at once. In the others
a node holds its places in order, each of the class of the word before it. When a child joins,
the smaller list goes into the larger, and new neighbours of different classes are pairs of
exactly this depth. Of pairs with periods p, 2p, ... only that of the smallest has neighbours:
the places between lie in the same node.

Defined results: a null text, one without words, or one of fewer than six words has no runs and
collapses to its words joined by one space; very long texts come alone in a slice; a null id is
never reworded; equal texts give equal runs unless reworded; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

PERIODS, LEAST = 4, 6  # a run has at least four periods and six words
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_ranks(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4, ... words from each place on, equal where these agree and lie in one text.

    The last ranks are all different. Each has one more entry, for the place behind all words.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[doc + 1]
    keys = doc * (int(words.max()) + 1) + words
    places = np.argsort(keys, kind="stable")
    keys = keys[places]
    group = np.zeros(n, np.int64)  # where the group of each sorted place begins
    ranks, levels, size = np.full(n + 1, n, np.int32), [], 1
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(keys)))
        inner = np.repeat(begin, sizes)
        if levels:
            outer = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            inner = group + inner - np.repeat(outer, np.diff(np.append(outer, len(group))))
        ranks[places] = inner
        levels.append(ranks.copy())
        open_ = np.repeat(sizes > 1, sizes)
        places, group = places[open_], inner[open_]
        if not len(places):
            return levels
        ahead = places + size
        follow = np.where(ahead < stop[places], ranks[np.minimum(ahead, n)], -1)
        keys = group * (n + 1) + follow + 1
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        group = group[order]
        size *= 2


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][a + out] == levels[k][b + out]) * (1 << k)
    return out


def _maximal_pairs(places: list[int], depths: list[int], left: np.ndarray, found: list[tuple[int, int, int]]) -> None:
    """Adds (place, distance, depth) of the pairs of one subtree; ``depths`` are between neighbours."""

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        for x in small:
            insort(large, x)
        own = set(small)
        for x in small:
            k = bisect_left(large, x)
            for y in large[max(0, k - 1) : k] + large[k + 1 : k + 2]:
                q = abs(x - y)
                if y not in own and q * (PERIODS - 1) <= depth and q + depth >= LEAST and left[x] != left[y]:
                    found.append((min(x, y), q, depth))
        return large

    stack: list[tuple[int, list[int]]] = []
    done = [places[0]]
    for depth, place in zip(depths, places[1:]):
        while stack and stack[-1][0] > depth:
            inner, members = stack.pop()
            done = join(members, done, inner)
        if stack and stack[-1][0] == depth:
            done = join(stack.pop()[1], done, depth)
        stack.append((depth, done))
        done = [place]
    while stack:
        inner, members = stack.pop()
        done = join(members, done, inner)


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (place, period, length), sorted, of all runs of texts that begin at ``first`` in ``words``."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < LEAST:
        return none
    levels = suffix_ranks(words, first)
    if len(levels) < 4:  # no four words recur
        return none
    four, last = levels[2][:-1], levels[-1][:-1]
    recurs = np.bincount(four)[four] > 1
    places = np.flatnonzero(recurs)
    places = places[np.argsort(last[places], kind="stable")]
    depth = common(levels, places[:-1], places[1:])
    # Subtrees of places that share their first five words.
    tree = np.concatenate([[0], np.cumsum(depth < LEAST - 1)])
    begin = np.flatnonzero(np.concatenate([[True], np.diff(tree) != 0]))
    size = np.diff(np.append(begin, len(tree)))
    left = np.concatenate([[-1], words[:-1]])
    left[first[:-1][np.diff(first) > 0]] = -1
    inner = np.append(np.where(depth < LEAST - 1, 0, depth), 0)
    by_place = places[np.lexsort((places, tree))]
    gap = np.append(np.where(tree[1:] == tree[:-1], np.diff(by_place), len(words)), len(words))
    classes = left[places]
    may = (size > 1) & (np.minimum.reduceat(classes, begin) != np.maximum.reduceat(classes, begin))
    may &= np.minimum.reduceat(gap, begin) * (PERIODS - 1) <= np.maximum.reduceat(inner, begin)
    found: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(may):
        lo, hi = begin[k], begin[k] + size[k]
        _maximal_pairs(places[lo:hi].tolist(), depth[lo : hi - 1].tolist(), left, found)
    if not found:
        return none
    out = np.array(found, np.int64)
    out[:, 2] += out[:, 1]
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def reworded(name: int, n: int) -> np.ndarray | None:
    """Which original word each word becomes in texts that get a planted run, by the hash of their id."""
    h = crc32(str(name).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _slice(part: pa.Table, plant: bool) -> pa.Table:
    names = part.column("doc_id").to_pylist()
    w = W.split(part.column("text"), hashed=False)
    sizes = w.ends - w.starts
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    raw = np.ascontiguousarray(w.data[~W.BLANK[w.data]])
    texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    kinds = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    source = np.arange(len(sizes))
    for d, name in enumerate(names if plant else []):
        lo, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
        order = None if name is None else reworded(name, n)
        if order is not None:
            source[lo : lo + n] = lo + order
    runs = find_runs(kinds[source], w.first)
    steps = np.zeros(len(sizes) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 1], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 2], -1)
    kept = np.cumsum(steps)[:-1] == 0
    before = np.concatenate([[0], np.cumsum(kept)])[w.first]
    lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), texts.take(pa.array(source[kept])))
    owner = np.searchsorted(w.first, runs[:, 0], "right") - 1
    rows = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - w.first[owner]), pa.array(runs[:, 2]), pa.array(runs[:, 1])], ["start", "length", "period"]
    )
    spans = pa.array(np.searchsorted(owner, np.arange(len(names) + 1)), pa.int32())
    return pa.table({
        "doc_id": pa.array(names, pa.int64()),
        "n_words": pa.array(np.diff(w.first), pa.int64()),
        "runs": pa.ListArray.from_arrays(spans, rows),
        "collapsed": pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
    })


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` by start and period, and the text without what repeats in them.

    ``plant`` rewords a tenth of all texts first, by the hash of their id, so that they hold a run.
    """

    def run(batches):
        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text"):
                yield from _slice(part, plant).to_batches()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, RUNS)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first by start and period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | better(best, r), r).otherwise(best))
