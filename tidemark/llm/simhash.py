"""SimHash fingerprints of whole texts, with built-in functions alone.

Terms are pairs of neighbouring words (the last one alone). Each votes with the number of its
characters, and as often as it occurs, on ``BITS`` bits by two 64-bit hashes; a bit is set if
more than half of the weight is for it. Two counts share a long, so 64 sums count 128 bits.

``within_radius`` finds all fingerprints within a Hamming radius. ``RADIUS`` is the number of bits by
which texts with a Jaccard similarity of terms of ``LIKE`` differ on average: of texts just as like
as that about half are found, of liker ones nearly all. 128 bits are cut into blocks with a
number of flips each; these and one for each block are more than the radius in sum, so a match
has a block with no more flips than its number. Each entry is kept by the bits of each block,
each query looks up all that its blocks may be flipped to, and a match counts at its first such
block only. ``_plan`` takes the number of blocks that costs least at the sizes given; all find the
same. Equal fingerprints are one entry with a count, so copies are never paired.

Defined results: a null text is empty; texts without words have the fingerprint 0; equal texts
have equal fingerprints; rows with equal ids are each fingerprinted, and as the next document
of another stand for one, by the smallest start of their texts; null ids have no neighbours and
borrow nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

BITS, IDS_OF_BUCKET = 128, 100_000
#: Jaccard similarity of terms (as that of ``prefix_join``); bits of its cosine, for terms of equal weights.
LIKE = 0.75
RADIUS = math.ceil(BITS / math.pi * math.acos(2 * LIKE / (1 + LIKE)))
#: Least bits of a key; most flips of a block, which are a constant of the plan; cost of a compared pair to a key looked up.
LEAST_KEY, MOST_FLIPS, PAIR = 16, 5000, 0.02
LANES = 0x0000000100000001
BLANK = r"[\x20\x09-\x0D]+"


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key``, ``f1``, ``f2`` of each row. Rows already partitioned by a part of ``key`` aren't shuffled."""
    words = texts.select(*key, F.filter(F.split(text, BLANK), lambda w: w != "").alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    terms = words.select(*key, F.explode_outer(pairs).alias("t")).select(
        *key, F.xxhash64("t.a", "t.b").alias("h1"), F.xxhash64("t.b", "t.a", F.lit(3)).alias("h2"),
        (F.coalesce(F.length("t.a"), F.lit(0)) + F.coalesce(F.length("t.b"), F.lit(0))).cast("long").alias("weight"),
    )
    vote = lambda h, k: F.sum(F.shiftright(h, k).bitwiseAND(F.lit(LANES)) * F.col("weight"))
    votes = [vote(h, k).alias(f"{h}_{k}") for h in ("h1", "h2") for k in range(32)]
    sums = terms.groupBy(*key).agg(F.sum("weight").alias("all"), *votes)

    def folded(h: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"{h}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{k}", 32)
            for votes_for, bit in ((low, 1 << k), (high, 1 << (k + 32))):
                signed = bit - (1 << 64) if bit >= 1 << 63 else bit
                out = out.bitwiseOR(F.when(2 * votes_for > F.col("all"), F.lit(signed).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*key, folded("h1").alias("f1"), folded("h2").alias("f2"))


def text_of(f1: str, f2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def differing(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(bits: Column) -> Column:
    """The cosine of two texts' weighted terms that this many differing bits stand for, 0 at least."""
    return F.round(F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793 / BITS) * bits)), 6)


def _bits(start: int, size: int, f1: Column, f2: Column) -> Column:
    """Bits from ``start`` on of a fingerprint's 128; a block may lie in both longs."""
    parts = []
    for word, base in ((f1, 0), (f2, 64)):
        lo, hi = max(start, base), min(start + size, base + 64)
        if lo < hi:
            parts.append(F.shiftrightunsigned(word, lo - base).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
    return parts[0] if len(parts) == 1 else F.shiftleft(parts[1], min(start + size, 64) - start).bitwiseOR(parts[0])


def _cut(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """Start, size and flips of each block; a block of -1 flips isn't needed."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    flips = radius // blocks
    most = radius + 1 - blocks * flips
    return [(lo, hi - lo, flips if i < most else flips - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def _flipped(size: int, flips: int) -> int:
    return sum(math.comb(size, k) for k in range(flips + 1))


def _plan(radius: int, asked: int, entries: int) -> list[tuple[int, int, int]]:
    """The cheapest cut: keys written and looked up, and pairs compared if bits were even."""

    def cost(cut):
        return sum(entries + asked * _flipped(w, t) * (1 + PAIR * entries / 2**w) for _, w, t in cut if t >= 0)

    cuts = [_cut(radius, blocks) for blocks in range(3, BITS // LEAST_KEY + 1)]
    return min((c for c in cuts if all(_flipped(w, t) <= MOST_FLIPS for _, w, t in c)), key=cost)


def _masks(size: int, flips: int) -> Column:
    masks = [sum(1 << i for i in at) for k in range(flips + 1) for at in combinations(range(size), k)]
    return F.expr(f"array({','.join(f'{m}L' for m in masks)})")


def _pairs(asked: DataFrame, entries: DataFrame, radius: int) -> DataFrame:
    """Each pair of distinct ``asked (g1, g2)`` and ``entries (f1, f2, ...)`` within ``radius``, once, with its ``bits``."""
    cut = _plan(radius, asked.count(), entries.count())
    used = [(i, start, size, flips) for i, (start, size, flips) in enumerate(cut) if flips >= 0]
    of = lambda start, size, a, b: _bits(start, size, F.col(a), F.col(b))
    key = lambda i, start, size, a, b: of(start, size, a, b).bitwiseOR(F.lit(i << 48))
    spread = entries.select("*", F.explode(F.array(*[key(i, lo, w, "f1", "f2") for i, lo, w, _ in used])).alias("key"))
    flipped = [F.transform(_masks(w, t), key(i, lo, w, "g1", "g2").bitwiseXOR) for i, lo, w, t in used]
    probe = asked.select("g1", "g2", F.explode(F.concat(*flipped)).alias("key"))
    x1, x2 = F.col("f1").bitwiseXOR(F.col("g1")), F.col("f2").bitwiseXOR(F.col("g2"))
    first = F.coalesce(*[F.when(F.bit_count(_bits(lo, w, x1, x2)) <= t, F.lit(i)) for i, lo, w, t in used])
    bits = differing(("f1", "f2"), ("g1", "g2"))
    # The planner takes the keys looked up for as few as the queries, and would broadcast them.
    near = spread.join(probe.hint("merge"), "key").where(bits <= radius).where(first == F.shiftrightunsigned("key", 48))
    return near.withColumn("bits", bits).drop("key")


def _entries(index: DataFrame) -> DataFrame:
    return materialise(index.groupBy("f1", "f2").agg(F.count("*").alias("n")), "entries")


def matches(queries: DataFrame, entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of a distinct fingerprint ``g1, g2`` of ``queries (f1, f2)`` and a row of ``entries``, whose
    ``f1, f2`` are distinct, within ``radius``; with the columns of ``entries`` and the ``bits`` that differ."""
    asked = materialise(queries.select(F.col("f1").alias("g1"), F.col("f2").alias("g2")).distinct(), "asked")
    return _pairs(asked, entries, radius)


def matched_documents(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``q``, ``doc_id``, ``bits`` of each row of ``queries (q, f1, f2)`` with each of ``index (doc_id, f1, f2)`` within
    ``radius``. Copies are written out here, where the members of the matched fingerprints are joined."""
    near = materialise(matches(queries, _entries(index), radius).drop("n"), "matches")
    found = near.join(index.select("doc_id", "f1", "f2"), ["f1", "f2"]).select(F.col("g1").alias("f1"), F.col("g2").alias("f2"), "doc_id", "bits")
    return queries.select("q", "f1", "f2").join(found, ["f1", "f2"]).select("q", "doc_id", "bits")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each ``q`` of ``queries (q, f1, f2)`` the number of ``index (f1, f2)`` rows within ``radius``."""
    near = matches(queries, _entries(index), radius).groupBy("g1", "g2").agg(F.sum("n").alias("n_within"))
    near = materialise(near.withColumnsRenamed({"g1": "f1", "g2": "f2"}), "near")
    return queries.join(near, ["f1", "f2"], "left").select("q", F.coalesce("n_within", F.lit(0)).alias("n_within"))


def _ranged(ids: DataFrame, n: int) -> DataFrame:
    """``ids`` with the ``bucket`` of each: ranges in order of the ids, with about as many in each."""
    parts = max(ids.sparkSession.sparkContext.defaultParallelism, -(-n // IDS_OF_BUCKET))
    rows = ids.select("doc_id").repartitionByRange(parts, "doc_id").withColumn("bucket", F.spark_partition_id())
    return materialise(rows, "ranged")


def next_ids(ids: DataFrame) -> DataFrame:
    """For distinct ``doc_id``, the next in descending order; after the last the first.

    Ids are sorted in ranges; only the largest id of each range is handed to the range above it."""
    high, n = ids.agg(F.max("doc_id"), F.count("*")).first()
    if not n:
        return ids.select("doc_id", F.col("doc_id").alias("next_id"))
    ids = _ranged(ids, n)
    tops = ids.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tops = tops.select("bucket", F.lag("top").over(Window.orderBy("bucket")).alias("below"))  # a row for each range
    own = F.lead("doc_id").over(Window.partitionBy("bucket").orderBy(F.desc("doc_id")))
    out = ids.select("doc_id", "bucket", own.alias("own")).join(tops, "bucket")
    return out.select("doc_id", F.coalesce("own", "below", F.lit(high)).alias("next_id"))


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and its next document's id.

    The edited text has the last third replaced by the start of the next document's text."""
    # One key without nulls on both sides, so that the texts are shuffled once for both joins.
    nil = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id).cast("long"), nil).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    sizes = rows.where(F.col("key") != nil).groupBy(F.col("key").alias("doc_id")).agg(F.max(third).alias("third"))
    sizes = materialise(sizes, "sizes")
    order = materialise(next_ids(sizes.select("doc_id")).join(sizes, "doc_id"), "order")
    givers = order.select(F.coalesce("next_id", nil).alias("key"), F.coalesce("doc_id", nil).alias("to"), "third")
    pieces = rows.join(givers, "key").select("to", F.expr("substring(text, 1, third)").alias("piece"))
    pieces = pieces.groupBy(F.col("to").alias("key")).agg(F.min("piece").alias("piece"))
    both = rows.join(pieces, "key", "left").select(
        "key", "text", F.length("text").alias("n_chars"), third.alias("third"), F.coalesce("piece", F.lit("")).alias("piece"),
        F.monotonically_increasing_id().alias("row"),
    )
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - third), substring(piece, 1, third))"))
    keys = ["key", "row", "n_chars", "edited_sha256"]
    both = both.select("key", "row", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array("text", "edited").alias("texts"))
    prints = fingerprints(both.select(*keys, F.posexplode("texts").alias("kind", "text")), [*keys, "kind"], "text")
    one = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = prints.groupBy(*keys).agg(one("f1", 0).alias("f1"), one("f2", 0).alias("f2"), one("f1", 1).alias("e1"), one("f2", 1).alias("e2"))
    wide = wide.withColumn("doc_id", F.nullif(F.col("key"), nil)).drop("key", "row")
    return materialise(wide, "prints").join(order.select("doc_id", "next_id"), "doc_id", "left")
