"""Shards balanced in bytes, tokens and rows at once, by vector bin packing.

The unit is the group of equal texts, known by its sums. A group with more than 1/``CHUNK_PART`` of all
rows or bytes would unbalance the shards and is split by a hash of the id. Groups are dealt over
cells of bounded number; in a cell each group, largest first, goes to the bin where the dot
product of its size with what the bin has left is highest. The bins of up to ``FAN`` cells are
then matched to each other by the same rule, a cell at a time, and so on up a tree until one set
of shards is left: the imbalance of cells cancels, and no task sees more than a cell or a fan of
bins. Rows, however many of one group, then look up the shard of their group, and are numbered in
parts of bounded size.

Defined results: a null text has no bytes and lies in the group of empty texts; repeated rows
each take a slot; ties go to the lower bin; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch

SHARDS, FAN = 16, 256
#: Groups of a cell; rows that are numbered together.
CELL_GROUPS, LEAST_CELLS, PART_ROWS = 16384, 1, 100_000
#: A group has at most this part of all rows and of all bytes, or ``LEAST_SPLIT`` rows; else it is split.
CHUNK_PART, LEAST_SPLIT = 1024, 16
GROUP = ["h", "text_crc32", "chunk"]
SUMS = ["size", "tokens", "n"]
BINNED = "h long, text_crc32 long, chunk long, size long, tokens long, n long, cell long, bin int"
MOVED = "parent long, cell long, bin int, to int"


def _dot_rule(loads: np.ndarray, residual: np.ndarray, distinct: bool) -> np.ndarray:
    """The bin of each load, the largest first; ``distinct``: each bin takes one."""
    out = np.zeros(len(loads), np.int32)
    free = np.zeros(len(residual))
    for i in np.argsort(-loads.max(axis=1), kind="stable"):
        at = int(np.argmax(residual @ loads[i] + free))
        residual[at] -= loads[i]
        out[i] = at
        if distinct:
            free[at] = -np.inf
    return out


def _pack_cell(shards: int):
    def run(table):
        table = table.sort_by([(c, "ascending") for c in GROUP])
        sizes = np.stack([table.column(c).to_numpy().astype(float) for c in SUMS], axis=1)
        scale = np.maximum(sizes.sum(axis=0) / shards, 1)
        bins = _dot_rule(sizes / scale, np.ones((shards, 3)), False)
        return table.append_column("bin", pa.array(bins))

    return run


def _match(shards: int):
    """Bins of the cells of one fan: the cells with the most uneven bins choose first."""

    def run(table):
        cell, bin, parent = (table.column(c).to_numpy() for c in ("cell", "bin", "parent"))
        loads = np.stack([table.column(c).to_numpy().astype(float) for c in ("size", "tokens", "n")], axis=1)
        loads /= np.maximum(loads.sum(axis=0) / shards, 1)
        cells, number = np.unique(cell, return_inverse=True)
        full = np.zeros((len(cells), shards, 3))
        full[number, bin] = loads
        to = np.zeros((len(cells), shards), np.int32)
        residual = np.ones((shards, 3))
        for i in np.argsort(-np.ptp(full[:, :, 0], axis=1), kind="stable"):
            to[i] = _dot_rule(full[i], residual, True)
        return pa.table({"parent": parent, "cell": cell, "bin": bin, "to": to[number, bin]})

    return run


def _hash(*columns) -> F.Column:
    return F.xxhash64(*columns, F.lit(29))


def _homes(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """The ``shard`` of each group of ``rows``."""
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    groups = scratch.write(groups, "groups")
    cells = max(LEAST_CELLS, -(-groups.count() // CELL_GROUPS))
    dealt = groups.withColumn("cell", F.pmod(_hash(*GROUP), F.lit(cells)).cast("long"))
    binned = scratch.write(dealt.groupBy("cell").applyInArrow(_pack_cell(shards), BINNED), "binned")
    sums = [F.sum(c).alias(c) for c in SUMS]
    parts = binned.groupBy("cell", "bin").agg(*sums)
    parts = scratch.write(parts.select("*", F.col("cell").alias("top"), F.col("bin").alias("shard")), "parts")
    while cells > 1:
        cells = -(-cells // FAN)
        above = parts.groupBy(F.col("top").alias("cell"), F.col("shard").alias("bin")).agg(*sums)
        above = above.withColumn("parent", F.floor(F.col("cell") / FAN))
        moved = above.groupBy("parent").applyInArrow(_match(shards), MOVED)
        moved = moved.select("parent", F.col("cell").alias("top"), F.col("bin").alias("shard"), "to")
        parts = parts.join(moved, ["top", "shard"]).select("cell", "bin", *SUMS, F.col("parent").alias("top"), F.col("to").alias("shard"))
        parts = scratch.write(parts, "parts")
    return scratch.write(binned.join(parts.select("cell", "bin", "shard"), ["cell", "bin"]).select(*GROUP, "shard"), "homes")


def _numbered(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``rows`` with the ``slot`` of each in its shard. A part of a shard is numbered by itself, after the parts before it."""
    part = F.pmod(F.xxhash64("row"), F.lit(max(1, n // PART_ROWS))).cast("long")
    rows = scratch.write(rows.withColumn("part", part), "located")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "row"))
    return rows.withColumn("own", own).join(scratch.write(counts, "offsets"), ["shard", "part"]).withColumn("slot", F.col("before") + F.col("own") - 1)


def sharded(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size`` (bytes and one), ``tokens``, ``text_crc32``, ``shard`` and the ``slot`` in it."""
    scratch = Scratch(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col(id).cast("long").alias("doc_id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    chunks = F.greatest(F.ceil(F.col("n") / max(n // CHUNK_PART, LEAST_SPLIT)), F.ceil(F.col("total") * CHUNK_PART / size))
    copies = rows.groupBy("h", "text_crc32").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    large = scratch.write(copies.select("h", "text_crc32", F.least(F.col("n"), chunks).alias("chunks")).where("chunks > 1"), "large")
    chunk = F.pmod(_hash(F.coalesce("doc_id", "row")), F.col("chunks"))
    rows = rows.join(large, ["h", "text_crc32"], "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)).cast("long"))
    out = _numbered(rows.join(_homes(rows, shards, scratch), GROUP), n, scratch)
    scratch.drop("located", "offsets")
    return out.select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")
