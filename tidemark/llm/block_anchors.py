"""Exact repeats of word windows across documents, by fixed-block anchors.

Every document is an index of non-overlapping blocks of ``BLOCK`` words and a probe with its
rolling windows of as many words. A repeat of ``WINDOW >= 2 * BLOCK - 1`` words covers a whole
block of the other document, so a window that a probe did not hit is not a repeat. Hits are
extended to windows, and windows that start in a smaller document merge into maximal repeats.

Defined results: a null or empty text has no words and stays empty; rows with a null id count
as the largest; rows with equal ids never remove words from each other; of texts that are
equal the one with the smallest id stays whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.exchange import bucket_of, by_bucket, cuts, gathered, hash_range, layout, none

BLOCK, WINDOW = 7, 13
LAST = np.iinfo(np.int64).max
PROBES = "r int, b int, keys binary, flags binary"
HITS = "b int, keys binary"
FOUND = "r int, b int, hi binary, lo binary, doc binary"
SHARED = "b int, hi binary, lo binary"


def _ids(table: pa.Table) -> np.ndarray:
    ids = table.column("doc_id").combine_chunks()
    return ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _spread(size: int, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which of ``size`` places lie from ``before`` under to ``after`` over one of ``at``."""
    step = np.zeros(size + 1, np.int32)
    step[0] = np.count_nonzero(at < before)
    begins = at[at >= before] - before
    step[begins[begins <= size]] += 1
    ends = at + after + 1
    step[ends[ends < size]] -= 1
    return np.cumsum(step[:-1]) > 0


def _probe(block: int, ranges: int):
    """Of one bucket, the distinct window hashes: whether indexed, whether in two documents."""

    def run(key, table):
        keys, flags, docs, row = [], [], [], 0
        for part in W.slices(table, "text"):
            w = W.split(part.column("text"))
            at = np.flatnonzero(w.whole(block))
            keys.append(w.grams(block)[at] >> np.uint64(16))
            flags.append((at - w.first[w.doc[at]]) % block == 0)
            docs.append(w.doc[at] + row)
            row += part.num_rows
        keys, flags, docs = (np.concatenate(x) for x in (keys, flags, docs))
        order = np.argsort(keys, kind="stable")
        keys, flags, docs = keys[order], flags[order], docs[order]
        runs = cuts(keys)
        at = runs[:-1]
        if not len(at):
            return none("r", "b", "keys", "flags")
        indexed = np.logical_or.reduceat(flags, at)
        several = docs[runs[1:] - 1] != docs[at]
        keys = keys[at]
        r = hash_range(keys >> np.uint64(16), ranges)
        ends = cuts(r)
        mark = indexed.astype(np.uint8) | several.astype(np.uint8) << 1
        pieces = list(zip(ends[:-1], ends[1:]))
        return pa.table({
            "r": r[ends[:-1]],
            "b": np.full(len(pieces), key[0].as_py(), np.int32),
            "keys": pa.array([W.planes(keys[i:j], 6) for i, j in pieces], pa.binary()),
            "flags": pa.array([mark[i:j].tobytes() for i, j in pieces], pa.binary()),
        })

    return run


def _hits(table):
    """Of one range, the indexed hashes that two documents hold, for each bucket that has them."""
    b, (keys, flags) = gathered(table, {"keys": 6, "flags": 1})
    order = np.argsort(keys, kind="stable")
    b, keys, flags = b[order], keys[order], flags[order].astype(np.uint8)
    runs = cuts(keys)
    any_of = np.bitwise_or.reduceat(flags, runs[:-1])
    size = np.diff(runs)
    hit = np.repeat((any_of & 1 > 0) & ((size > 1) | (any_of & 2 > 0)), size)
    return by_bucket(b[hit], {"keys": (keys[hit], 6)})


def _window_hashes(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return w.grams(window, 11), w.grams(window, 13) >> np.uint64(48)


def _extend(block: int, window: int, ranges: int):
    """Of one bucket, the windows that hold a hit, each with its smallest document."""

    def run(key, table, replies):
        hits = [W.from_planes(x, 6) for x in replies.column("keys").to_pylist()]
        hits = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.uint64)
        ids, found, row = _ids(table), [], 0
        for part in W.slices(table, "text") if len(hits) else ():
            w = W.split(part.column("text"))
            inside = w.whole(block)
            at = np.flatnonzero(inside & _isin(w.grams(block) >> np.uint64(16), hits))
            if len(at):
                hi, lo = _window_hashes(w, window)
                at = np.flatnonzero(_spread(len(hi), at, window - block, 0) & w.whole(window))
                found.append((hi[at], lo[at], ids[w.doc[at] + row]))
            row += part.num_rows
        if not found:
            return none("r", "b", "hi", "lo", "doc")
        hi, lo, doc = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, lo, hi))
        hi, lo, doc = hi[order], lo[order], doc[order]
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        hi, lo, doc = hi[new], lo[new], doc[new].view(np.uint64)
        r = hash_range(hi >> np.uint64(32), ranges)
        ends = cuts(r)
        pieces = list(zip(ends[:-1], ends[1:]))
        return pa.table({
            "r": r[ends[:-1]] if len(pieces) else np.zeros(0, np.int32),
            "b": np.full(len(pieces), key[0].as_py(), np.int32),
            **{n: pa.array([W.planes(v[i:j], k) for i, j in pieces], pa.binary()) for n, v, k in (("hi", hi, 8), ("lo", lo, 2), ("doc", doc, 8))},
        })

    return run


def _shared(table):
    """Of one range, the windows that start in a document before all of a bucket's own."""
    b, (hi, lo, doc) = gathered(table, {"hi": 8, "lo": 2, "doc": 8})
    doc = doc.view(np.int64)
    order = np.lexsort((doc, lo, hi))
    b, hi, lo, doc = b[order], hi[order], lo[order], doc[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    first = doc[new]
    later = doc > np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(new))))
    return by_bucket(b[later], {"hi": (hi[later], 8), "lo": (lo[later], 2)})


def _keep(window: int, schema: pa.Schema, untouched: bool):
    """Of one bucket, each document without the words that a repeat covers."""

    def run(table, replies):
        known = [[W.from_planes(x, k) for x in replies.column(n).to_pylist()] for n, k in (("hi", 8), ("lo", 2))]
        known_hi, known_lo = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in known)
        order = np.argsort(known_hi, kind="stable")
        known_hi, known_lo = known_hi[order], known_lo[order]
        ids, parts, row = _ids(table), [], 0
        for part in W.slices(table, "text"):
            w = W.split(part.column("text"))
            hi, lo = _window_hashes(w, window)
            at = np.flatnonzero(w.whole(window))
            hi, lo = hi[at], lo[at]
            seen = _isin(hi, known_hi)
            if len(known_hi):
                seen &= known_lo[np.minimum(np.searchsorted(known_hi, hi), len(known_hi) - 1)] == lo
            parts.append((part, w, at, hi, ids[w.doc[at] + row], seen))
            row += part.num_rows
        hi, doc, seen = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        order = np.argsort(hi)
        runs = cuts(hi[order])
        if len(hi):
            ordered = doc[order]
            seen[order] |= ordered > np.repeat(np.minimum.reduceat(ordered, runs[:-1]), np.diff(runs))
        out, done = [], 0
        for part, w, at, *_ in parts:
            removed = _spread(len(w.starts), at[seen[done : done + len(at)]], 0, window - 1)
            done += len(at)
            out.append(_without(part, w, removed, untouched).select(schema.names).cast(schema))
        return pa.concat_tables(out)

    return run


def _without(part: pa.Table, w: W.Words, removed: np.ndarray, untouched: bool) -> pa.Table:
    n = part.num_rows
    kept = np.flatnonzero(~removed)
    step = np.zeros(len(w.data) + 2, np.int8)
    step[w.starts[kept]] += 1
    step[w.ends[kept] + 1] -= 1
    inside = np.cumsum(step[: len(w.data)], dtype=np.int8) > 0
    last = kept[np.append(w.doc[kept][1:] != w.doc[kept][:-1], True)] if len(kept) else kept
    inside[w.ends[last]] = False  # no blank behind the last word
    data = w.data.copy()
    data[w.ends] = 0x20
    sizes = np.bincount(w.doc[kept], weights=w.ends[kept] - w.starts[kept] + 1, minlength=n).astype(np.int64)
    sizes -= sizes > 0
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside])))
    gone = pa.array(np.bincount(w.doc[removed], minlength=n).astype(np.int64))
    if untouched:
        texts = pc.if_else(pc.equal(gone, 0), part.column("text").cast(pa.large_string()), texts)
    columns = {"kept_text": texts, "n_words": pa.array(np.diff(w.first).astype(np.int64)), "n_removed": gone}
    for name, column in columns.items():
        part = part.append_column(name, column)
    return part


def without_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), block: int = BLOCK,
    window: int = WINDOW, untouched: bool = False,
) -> DataFrame:
    """``doc_id``, ``kept_text`` (the kept words joined by one space), ``n_words``, ``n_removed`` and the
    columns in ``carry``: each document without the words of repeats from smaller documents.

    ``untouched`` leaves texts without repeats as they are, white space and nulls included.
    Carried columns may have any name but those of the result."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at any offset")
    from pyspark.sql.pandas.types import to_arrow_schema

    lay = layout(docs, text)
    rows = docs.select(
        bucket_of(F.col(id), lay.buckets).alias("b"),
        F.col(id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    texts = rows.groupBy("b")
    probes = texts.applyInArrow(_probe(block, lay.ranges), PROBES)
    hits = probes.groupBy("r").applyInArrow(_hits, HITS)
    found = texts.cogroup(hits.groupBy("b")).applyInArrow(_extend(block, window, lay.ranges), FOUND)
    shared = found.groupBy("r").applyInArrow(_shared, SHARED)
    shape = rows.drop("b", "text").withColumns({"kept_text": F.lit(""), "n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")})
    schema = to_arrow_schema(shape.schema)
    schema = pa.schema([pa.field(f.name, f.type) for f in schema])
    spark_schema = ", ".join(f"`{n}` {t}" for n, t in shape.dtypes)
    out = texts.cogroup(shared.groupBy("b")).applyInArrow(_keep(window, schema, untouched), spark_schema)
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})
