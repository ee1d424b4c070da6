"""Documents whose sets of word shingles have a Jaccard similarity of at least 3/4, as components.

Texts with the same words are one class. Shingles are ordered by how many classes hold them,
rarest first. A class of ``n`` shingles can only link with one that shares a shingle of its
prefix, the first ``n - ceil(3n/4) + 1``; shingles that no other class holds link nothing, so
most classes have an empty prefix and are done. The others are collapsed into groups of
identical prefix and size; pairs of groups are filtered by size and position, expanded to
members and verified on the whole sets.

A bucket of groups that share a shingle is not paired with itself: each round pairs it with
one pivot, and components are formed. Only groups that are not wholly in one component after
the rounds are paired with each other, which finds every link between components that is left.

Defined results: a null or empty text has no shingles and is its own component; fewer words
than a shingle make one shingle of all; rows with equal ids and texts count once; a null id is
ignored in components; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.exchange import bucket_of, by_bucket, cuts, gathered, hash_range, layout, none
from tidemark.session import Scratch

SHINGLE = 5
ROUNDS = 2
SIGNED = "doc_id long, s1 long, s2 long, words int"
COUNTS = "r int, b int, keys binary, counts binary"
SHARED = "b int, keys binary, counts binary"
SETS = "doc_id long, n int, c int, gid binary, prefix array<long>, shingles array<long>"


def _signatures(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the sequence of words of each text, and its length."""
    counts = np.diff(w.first)
    place = np.arange(len(w.hashes), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for seed in (np.uint64(0x51ED270B), np.uint64(0xA5CB3F)):
            sums = np.zeros(len(w.hashes) + 1, np.uint64)
            np.cumsum(w.hashes * (W.mixed(place + seed) | np.uint64(1)), out=sums[1:])
            out.append(W.mixed(sums[w.first[1:]] - sums[w.first[:-1]] + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1], counts


def _sign(batches):
    for batch in batches:
        for part in W.slices(pa.Table.from_batches([batch]), "text"):
            w = W.split(part.column("text"), lower=True)
            s1, s2, n = _signatures(w)
            yield from pa.table({"doc_id": part.column("doc_id"), "s1": s1, "s2": s2, "words": n.astype(np.int32)}).to_batches()


def _chosen(table, notes):
    """The classes of one bucket: id, number of words, sorted distinct shingles."""
    wanted = {(d, s) for d, s in zip(notes.column("doc_id").to_pylist(), notes.column("s1").to_pylist()) if s is not None}
    for part in W.slices(table, "text"):
        w = W.split(part.column("text"), lower=True)
        s1, _, counts = _signatures(w)
        grams = w.grams(SHINGLE, 5)
        for i, d in enumerate(part.column("doc_id").to_pylist()):
            if (d, s1[i]) in wanted:
                wanted.discard((d, s1[i]))
                if counts[i] >= SHINGLE:
                    own = np.sort(grams[w.first[i] : w.first[i + 1] - SHINGLE + 1])
                    yield d, own[np.append(True, own[1:] != own[:-1])]
                else:
                    yield d, None


def _count(ranges: int):
    """Of one bucket, each distinct shingle with the number of classes that hold it."""

    def run(key, table, notes):
        sets = [own for _, own in _chosen(table, notes) if own is not None]
        if not sets:
            return none("r", "b", "keys", "counts")
        keys = np.sort(np.concatenate(sets) >> np.uint64(16))
        runs = cuts(keys)
        keys, counts = keys[runs[:-1]], np.diff(runs)
        r = hash_range(keys >> np.uint64(16), ranges)
        ends = cuts(r)
        pieces = list(zip(ends[:-1], ends[1:]))
        return pa.table({
            "r": r[ends[:-1]],
            "b": np.full(len(pieces), key[0].as_py(), np.int32),
            "keys": pa.array([W.planes(keys[i:j], 6) for i, j in pieces], pa.binary()),
            "counts": pa.array([W.planes(counts[i:j], 5) for i, j in pieces], pa.binary()),
        })

    return run


def _held_twice(table):
    """Of one range, the shingles that two classes hold, for each bucket that has them."""
    b, (keys, counts) = gathered(table, {"keys": 6, "counts": 5})
    order = np.argsort(keys, kind="stable")
    b, keys, counts = b[order], keys[order], counts[order]
    runs = cuts(keys)
    total = np.repeat(np.add.reduceat(counts, runs[:-1]), np.diff(runs))
    twice = total > 1
    return by_bucket(b[twice], {"keys": (keys[twice], 6), "counts": (total[twice], 5)})


def _sets(table, notes):
    """Of one bucket, the size of each class; and for those that may link the shared shingles
    in order, how many they are, the prefix, and the group."""
    packed = notes.filter(pa.compute.is_valid(notes.column("keys")))
    keys = np.concatenate([np.zeros(0, np.uint64), *(W.from_planes(x, 6) for x in packed.column("keys").to_pylist())])
    counts = np.concatenate([np.zeros(0, np.uint64), *(W.from_planes(x, 5) for x in packed.column("counts").to_pylist())])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    out = {name: [] for name in ("doc_id", "n", "c", "gid", "prefix", "shingles")}
    for d, own in _chosen(table, notes):
        n = 1 if own is None else len(own)
        row = (d, n, 0, None, None, None)
        if own is not None and len(keys):
            low = own >> np.uint64(16)
            at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            held = keys[at] == low
            c = int(np.count_nonzero(held))
            if 4 * c >= 3 * n:
                own, often = own[held], counts[at[held]]
                own = own[np.lexsort((own, often))].view(np.int64)
                prefix = own[: c - -(-3 * n // 4) + 1]
                gid = hashlib.md5(prefix.tobytes() + n.to_bytes(8, "little")).digest()
                row = (d, n, c, gid, prefix, own)
        for name, value in zip(out, row):
            out[name].append(value)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs of different classes ``a``, ``b`` that link."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    both = pairs.join(one, "b").join(two, "a")
    return both.where(7 * F.size(F.array_intersect("sa", "sb")) >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")


def _may_link(n, i, m, j):
    """By size, and by what is left of both from their common shingle on, at places i and j."""
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(n - i, m - j) >= 3 * (n + m))


def _links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links enough to connect all classes that any links connect."""
    members = scratch.write(sets.select("gid", F.col("doc_id").alias("member")), "members")
    groups = members.groupBy("gid").agg(F.min("member").alias("head"), F.count("*").alias("size"))
    kinds = sets.groupBy("gid").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("prefix").alias("prefix"))
    places = scratch.write(
        kinds.join(groups, "gid").select("gid", "head", "n", "c", F.posexplode("prefix").alias("at", "token"))
        .select("token", "gid", "head", "n", "c", (F.col("n") - F.col("c") + F.col("at")).alias("i")),
        "places",
    )
    heads = scratch.write(groups.where("size > 1"), "heads")
    inner = members.join(heads, "gid").where("member <> head").select(F.col("head").alias("a"), F.col("member").alias("b"))
    links, labels, open_places = None, None, places
    for turn in range(ROUNDS):
        # The class with the smallest share of shingles of its own is likest to the others.
        rank = (F.col("n") - F.col("c")) / F.col("n") if turn == 0 else F.xxhash64("gid", F.lit(turn)).cast("double")
        pivots = open_places.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "head", "gid", "n", "i")).alias("p"))
        pivots = scratch.write(pivots, "pivots")  # so that both sides of the join are shuffled, and a hot shingle split
        near = open_places.join(pivots, "token").where(F.col("gid") != F.col("p.gid"))
        near = near.where(_may_link(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i")))
        near = near.select(F.col("p.head").alias("a"), "gid").distinct()
        pairs = near.join(members, "gid").select("a", F.col("member").alias("b"))
        if turn == 0:
            pairs = pairs.union(inner)
        links, labels = _more_links(pairs, links, sets, scratch)
        open_places = _open(places, members, labels, scratch)
        if open_places.isEmpty():
            return links
    other = open_places.select("token", *[F.col(c).alias(f"{c}2") for c in ("gid", "n", "i", "low", "high")])
    near = open_places.join(other, "token").where("gid <= gid2 AND (low <> high OR low2 <> high2 OR low <> low2)")
    near = near.where(_may_link(F.col("n"), F.col("i"), F.col("n2"), F.col("i2"))).select("gid", "gid2").distinct()
    labelled = _labelled(members, labels)
    ours = labelled.select("gid", F.col("member").alias("a"), F.col("component").alias("ca"))
    theirs = labelled.select(F.col("gid").alias("gid2"), F.col("member").alias("b"), F.col("component").alias("cb"))
    pairs = near.join(ours, "gid").join(theirs, "gid2").where("ca <> cb").select("a", "b")
    return _more_links(pairs, links, sets, scratch)[0]


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = members.join(labels.withColumnRenamed("vertex", "member"), "member", "left")
    return known.withColumn("component", F.coalesce("component", "member"))


def _more_links(pairs: DataFrame, links: DataFrame | None, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    found = _verified(pairs.distinct(), sets)
    links = scratch.write(found if links is None else links.union(found), "links")
    return links, components(links, scratch=scratch)


def _open(places: DataFrame, members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Places of shingles whose groups are not all in one component, with the components of the group."""
    span = _labelled(members, labels).groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    known = places.join(scratch.write(span, "span"), "gid")
    mixed = known.groupBy("token").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo <> hi").select("token")
    return scratch.write(known.join(scratch.write(mixed, "mixed"), "token"), "open")


def linked_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) of each row."""
    lay, scratch = layout(docs, text), Scratch(docs.sparkSession)
    rows = docs.select(
        bucket_of(F.col(id), lay.buckets).alias("b"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    signed = scratch.write(rows.select("doc_id", "text").mapInArrow(_sign, SIGNED), "signed")
    classes = signed.where("words > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    classes = scratch.write(classes.where("doc_id IS NOT NULL"), "classes")
    noted = classes.select(bucket_of(F.col("doc_id"), lay.buckets).alias("b"), "doc_id", "s1")
    texts = rows.groupBy("b")
    counts = texts.cogroup(noted.groupBy("b")).applyInArrow(_count(lay.ranges), COUNTS)
    shared = counts.groupBy("r").applyInArrow(_held_twice, SHARED)
    notes = noted.unionByName(shared, allowMissingColumns=True)
    sets = scratch.write(texts.cogroup(notes.groupBy("b")).applyInArrow(_sets, SETS), "sets")
    links = _links(sets.where("gid IS NOT NULL"), scratch)
    labels = components(links, scratch=scratch).withColumnRenamed("vertex", "doc_id")
    known = classes.join(sets.select("doc_id", "n"), "doc_id").join(labels, "doc_id", "left")
    known = known.select("s1", "s2", "n", F.coalesce("component", "doc_id").alias("component"))
    out = signed.join(scratch.write(known, "known"), ["s1", "s2"], "left")
    scratch.drop("signed", "known")
    return out.select(
        "doc_id",
        F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )
