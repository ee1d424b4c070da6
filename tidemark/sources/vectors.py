"""Vector records on Parquet: typing, upsert by id, filtered scan.

A collection is a folder of segments and of manifests. An upsert appends its batch as one segment
and then names it in a new manifest; nothing that is there is touched, and what a failed upsert
has written is not named and so not read. A scan takes the newest version of each id. Segments lie
in buckets by the hash of the id. Buckets that have ``MOST_PARTS`` appended parts are merged, those
alone, into a base segment; their number, a power of two kept in the manifest, doubles when
buckets hold more than ``BUCKET_ROWS`` rows on average.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark import schemas
from tidemark.operators.lookup import unique_lookup
from tidemark.session import _files, remove

#: Buckets of a new collection, appended parts of a bucket that are merged, and rows of a bucket.
BUCKETS, MOST_PARTS, BUCKET_ROWS = 16, 8, 1_000_000
NAMES = [c for c in schemas.VECTORS.fieldNames() if c != "bucket"]


def to_records(df: DataFrame, id_: Column, vector: str = "values") -> DataFrame:
    """``(id, values, metadata, type)``; the year becomes a double, the rest text. ``type``
    is repeated outside the struct as the sort column of the stored collection."""
    return df.select(
        id_.cast("string").alias("id"),
        F.col(vector).cast("array<float>").alias("values"),
        F.struct(
            F.col(C.SOURCE).cast("string").alias(C.SOURCE),
            F.col("text").cast("string").alias("text"),
            F.col(C.YEAR).cast("double").alias(C.YEAR),
            F.col("type").cast("string").alias("type"),
        ).alias("metadata"),
        F.col("type").cast("string").alias("type"),
    )


def latest(batch: DataFrame, key: str, version: list[Column]) -> DataFrame:
    """Last row per key. Map tasks keep one row per key before the shuffle, so an id
    written a million times does not gather in one task."""
    w = Window.partitionBy(key).orderBy(*[v.desc() for v in version])
    return batch.withColumn("rn__v", F.row_number().over(w)).where("rn__v = 1").drop("rn__v")


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Paths of the manifests, newest first."""
    where, files = _files(spark, f"{path}/_manifest")
    if not files.exists(where):
        return []
    return sorted((str(f.getPath()) for f in files.listStatus(where) if not f.getPath().getName().startswith("_")), reverse=True)


def _named(spark: SparkSession, name: str) -> dict | None:
    """A manifest, or None where its writer stopped in the middle."""
    where, files = _files(spark, name)
    stream = files.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    """``version``, ``buckets``, and ``segments`` from oldest to newest: ``name``, ``buckets``,
    ``base`` (merged) and ``live``, the rows of each bucket that is still read."""
    names = _manifests(spark, path)
    newest = int(names[0].rsplit("/", 1)[1]) if names else 0
    known = next((m for m in (_named(spark, name) for name in names) if m), {"buckets": BUCKETS, "segments": []})
    return {**known, "version": newest}


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Make a manifest the newest one, unless another writer came first."""
    name = f"{path}/_manifest/{manifest['version']:012d}"
    final, files = _files(spark, name)
    draft, _ = _files(spark, f"{path}/_manifest/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"the collection was changed by another writer: {name}")


def _write_segment(spark: SparkSession, df: DataFrame, path: str, buckets: int, base: bool) -> dict:
    """Sorted by type inside each file, so that a condition on the type skips row groups; the
    rebalance evens out file sizes."""
    name = f"segment-{uuid.uuid4().hex}"
    (
        bucketed(df.select(*NAMES), buckets)
        .hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "type")
        .write.partitionBy("bucket")
        .parquet(f"{path}/{name}")
    )
    written = spark.read.schema(schemas.VECTORS).parquet(f"{path}/{name}").groupBy("bucket").count().collect()
    return {"name": name, "buckets": buckets, "base": base, "live": {str(r["bucket"]): r["count"] for r in written}}


def _segment(spark: SparkSession, path: str, segment: dict, buckets: list[str]) -> DataFrame:
    """The named buckets of a segment; the whole folder is one scan."""
    root = f"{path}/{segment['name']}"
    parts = [f"{root}/bucket={b}" for b in buckets]
    return spark.read.schema(schemas.VECTORS).option("basePath", root).parquet(*parts)


def _current(
    spark: SparkSession, path: str, segments: list[dict], predicate: Column | None = None, columns: list[str] = NAMES
) -> DataFrame:
    """The newest version of each id in the live parts of ``segments``.

    Base rows are only held against the ids of appended rows, which are few; the predicate reaches
    the scan of the base, and is applied to appended rows once their newest version is known.
    """
    keep = (lambda df: df) if predicate is None else (lambda df: df.where(predicate))
    live = [(at, s, _segment(spark, path, s, list(s["live"]))) for at, s in enumerate(segments) if s["live"]]
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    base = [df for _, s, df in live if s["base"]]
    added = [df.select(*NAMES).withColumn("at__v", F.lit(at)) for at, s, df in live if not s["base"]]
    if not live:
        empty = spark.createDataFrame([], schemas.VECTORS)
        return empty.select(*columns)
    if not added:
        return keep(union(base)).select(*columns)
    newest = keep(latest(union(added), "id", [F.col("at__v")])).select(*columns)
    if not base:
        return newest
    ids = union([df.select("id") for _, s, df in live if not s["base"]]).distinct()
    return keep(union(base)).select(*columns).join(ids, "id", "left_anti").unionByName(newest)


def _due(manifest: dict) -> tuple[int, set[int]]:
    """The coarsest number of buckets in use, and which of these have too many appended parts."""
    live = [s for s in manifest["segments"] if s["live"]]
    coarse = min([manifest["buckets"], *(s["buckets"] for s in live)])
    parts: dict[int, int] = {}
    for s in live:
        for unit in {int(b) % coarse for b in s["live"]} if not s["base"] else ():
            parts[unit] = parts.get(unit, 0) + 1
    return coarse, {unit for unit, n in parts.items() if n >= MOST_PARTS}


def _merged(spark: SparkSession, path: str, manifest: dict) -> dict | None:
    """The manifest after a merge of all buckets that are due, or None if none is."""
    coarse, due = _due(manifest)
    if not due:
        return None
    rows = sum(sum(s["live"].values()) for s in manifest["segments"])
    buckets = manifest["buckets"]
    while rows > buckets * BUCKET_ROWS:
        buckets *= 2
    inside = lambda b: int(b) % coarse in due
    part = lambda s, want: {**s, "live": {b: n for b, n in s["live"].items() if inside(b) == want}}
    taken = [part(s, True) for s in manifest["segments"]]
    left = [s for s in (part(s, False) for s in manifest["segments"]) if s["live"]]
    new = _write_segment(spark, _current(spark, path, taken), path, buckets, True)
    return {"version": manifest["version"] + 1, "buckets": buckets, "segments": [new, *left]}


def upsert_vectors(spark: SparkSession, batch: DataFrame, path: str, version: list[Column] | None = None) -> DataFrame:
    """Upsert into the collection at ``path``, which is made if it is not there. Returns its scan.

    With ``version`` the row of an id with the highest one is written; without it an id that
    occurs twice in the batch is an error. The batch is appended; buckets with many appended
    parts are merged afterwards, in a commit of their own.
    """
    newest = latest(batch, "id", version) if version else unique_lookup(batch.select(*NAMES), ["id"])
    manifest = read_manifest(spark, path)
    first = not manifest["segments"]
    added = _write_segment(spark, newest, path, manifest["buckets"], first)
    manifest = {**manifest, "version": manifest["version"] + 1, "segments": [*manifest["segments"], added]}
    _commit(spark, path, manifest)
    merged = _merged(spark, path, manifest)
    if merged:
        _commit(spark, path, merged)
    return scan_vectors(spark, path)


def vacuum_vectors(spark: SparkSession, path: str) -> None:
    """Remove what the newest manifest doesn't name. Not while others write or read older scans."""
    manifest = read_manifest(spark, path)
    live = {s["name"]: set(s["live"]) for s in manifest["segments"]}
    where, files = _files(spark, path)
    for entry in files.listStatus(where):
        name = entry.getPath().getName()
        if name.startswith("segment-") and name not in live:
            remove(spark, f"{path}/{name}")
        elif name in live:
            for part in files.listStatus(entry.getPath()):
                if part.isDirectory() and part.getPath().getName().removeprefix("bucket=") not in live[name]:
                    remove(spark, str(part.getPath()))
    names = _manifests(spark, path)
    kept = next((name for name in names if _named(spark, name)), None)
    for name in names:
        if name != kept:
            remove(spark, name)


def scan_vectors(
    spark: SparkSession, path: str, predicate: Column | None = None, with_values: bool = True
) -> DataFrame:
    """Stored records; the predicate is pushed down, and vectors are not read unless asked."""
    columns = NAMES if with_values else [c for c in NAMES if c != "values"]
    return _current(spark, path, read_manifest(spark, path)["segments"], predicate, columns)
