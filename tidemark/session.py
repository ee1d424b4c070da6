"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on: runtime re-planning, skew splitting of joins
# and rebalanced writes, and one time zone for all calendar arithmetic.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of this run that all executors see: under ``spark.checkpoint.dir``, or under the
    warehouse where that is not set. It is removed by ``close_session``, or else when the driver ends.

    A warehouse on a local disk is no shared folder: on a cluster it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        where, _ = _files(spark, root)
        local = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()
        if (where.toUri().getScheme() or local) == "file" and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {root} is on a local disk")
    run = f"{root.rstrip('/')}/_tidemark-{spark.sparkContext.applicationId}"
    path, files = _files(spark, run)
    files.deleteOnExit(path)
    return run


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def close_session(spark: SparkSession) -> None:
    """Remove what this run has written as intermediates, then stop."""
    remove(spark, shared_root(spark))
    spark.stop()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage
    that survives executor loss and carries exact file statistics."""
    return Scratch(df.sparkSession).write(df, tag)


class Scratch:
    """Written intermediates of one operator, which it removes when none of its results reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """As ``materialise``. An earlier table of the same tag stays until ``drop``."""
        path = shared_dir(self.spark, tag)
        self.paths[path] = tag
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: str) -> None:
        """Remove all tables but those of the tags in ``keep``."""
        for path in [p for p, tag in self.paths.items() if tag not in keep]:
            remove(self.spark, path)
            del self.paths[path]


def spread_scan(df: DataFrame) -> DataFrame:
    """For a plain scan before costly Python work: rows of a few files are spread over all
    cores. A scan that has a partition per core already is left as it is, without shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
