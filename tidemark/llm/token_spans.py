"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once. The running sum of the bytes that its ids stand for maps every
token to a span of the text; an interval join by binary search finds the sections it touches.
A token that crosses a boundary is allocated by ``rule``: ``majority`` gives it to the section
that holds most of its bytes (the earlier of equals), ``start`` to that of its first byte, and
``proportional`` shares it by bytes. Counts of the sections of a document always sum to the
count of its tokens.

Defined results: sections are the sentences of a text, ending with the blank behind a full stop,
exclamation or question mark, or with a line end; a null or empty text is one section without tokens; texts of any length are encoded whole;
repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.exchange import cuts
from tidemark.llm.tokens import VOCABULARY, encoded, token_bytes

RULES = ("majority", "start", "proportional")
SECTIONS = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with spans ``[starts, ends)`` per section, section ``i`` from ``edges[i]`` to ``edges[i + 1]``;
    and those of the tokens counted that cross a boundary."""
    n = len(edges) - 1
    low = np.searchsorted(edges, starts, "right") - 1
    high = np.searchsorted(edges, ends - 1, "right") - 1
    inside = low == high
    counts = np.bincount(low[inside], minlength=n).astype(np.float64)
    crossing = np.zeros(n, np.int64)
    at = np.flatnonzero(~inside)
    if len(at):
        parts = high[at] - low[at] + 1
        token = np.repeat(np.arange(len(at)), parts)
        section = low[at][token] + np.arange(len(token)) - np.repeat(np.cumsum(parts) - parts, parts)
        held = np.minimum(ends[at][token], edges[section + 1]) - np.maximum(starts[at][token], edges[section])
        if rule == "proportional":
            np.add.at(counts, section, held / (ends - starts)[at][token])
            crossing += np.bincount(section[held > 0], minlength=n)
        else:
            best = -held if rule == "majority" else np.zeros(len(token))
            chosen = section[np.lexsort((section, best, token))[cuts(token)[:-1]]]
            counts += np.bincount(chosen, minlength=n)
            crossing += np.bincount(chosen, minlength=n)
    return counts, crossing


def section_ends(data: np.ndarray) -> np.ndarray:
    """Where sections of closed texts begin, and the end of all."""
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    ends = data == 10
    ends[1:] |= stop[:-1] & (data[1:] == 32)
    return np.concatenate([[0], np.flatnonzero(ends) + 1])


def _attribute(vocabulary: str, rule: str):
    def run(batches):
        lengths = token_bytes(vocabulary)
        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text", 2 << 20):
                data, bounds = W.closed(part.column("text"))
                ids = list(encoded(part.column("text").to_pylist(), vocabulary))
                sizes = np.array([len(x) for x in ids], np.int64)
                span = lengths[np.concatenate(ids)] if len(ids) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(ids)), sizes)
                # Each text is followed by a line end of its own, which no token covers.
                ends = np.cumsum(span) + doc
                begins = ends - span
                edges = section_ends(data)
                # A text that ends with a section has no further, empty one.
                close = bounds[1:] - 1
                edges = np.setdiff1d(edges, close[(close > bounds[:-1])], assume_unique=True)
                counts, crossing = allocate(begins, ends, edges, rule)
                owner = np.searchsorted(bounds, edges[:-1], "right") - 1
                first = np.searchsorted(owner, owner)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                origin = chars[bounds[:-1]][owner]
                last = np.append(owner[1:] != owner[:-1], True)
                names = part.column("doc_id").combine_chunks()
                yield from pa.table({
                    "doc_id": names.take(pa.array(owner)),
                    "section": np.arange(len(owner)) - first,
                    "start_char": chars[edges[:-1]] - origin,
                    "end_char": chars[edges[1:]] - origin - last,
                    "n_tokens": counts,
                    "n_crossing": crossing,
                    "doc_tokens": sizes[owner],
                }).to_batches()

    return run


def section_tokens(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rule: str = "majority", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per section: its place in the document, span in code points, tokens, tokens that
    cross its boundary, and the tokens of the whole document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_attribute(vocabulary, rule), SECTIONS)
