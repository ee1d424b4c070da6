"""Question and answer log: JSON array files of old, JSON lines to append to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark import schemas
from tidemark.sources.json_array import read_json_array


def read_log_array(spark: SparkSession, path: str) -> DataFrame:
    """Log kept as one JSON array per file, each read by many tasks; a corrupt or missing file gives no rows."""
    return _or_empty(spark, lambda: read_json_array(spark, path, schemas.LOG))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log kept as JSON lines (splittable); a missing path gives no rows."""
    reader = spark.read.schema(schemas.LOG).option("mode", "DROPMALFORMED")
    return _or_empty(spark, lambda: reader.json(path))


def _or_empty(spark: SparkSession, scan) -> DataFrame:
    try:
        return scan()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.LOG)


def log_records(
    df: DataFrame, question: str, response: str, timestamp: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Log rows, and the columns in ``keep``; a missing response is logged as ``None``, the time is now
    unless given."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(
        (now if timestamp is None else timestamp).alias("timestamp"),
        F.col(question).alias("question"),
        F.coalesce(F.col(response), F.lit(C.EMPTY_RESPONSE)).alias("response"),
        *keep,
    )


def append_log(records: DataFrame, path: str) -> None:
    """Add rows as new files; earlier files are not read or rewritten."""
    records.select(*schemas.LOG.fieldNames()).write.mode("append").json(path)


def pair_turns(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it, null if there is none.

    An equi-join on (conversation, turn): a long conversation spreads over all tasks,
    which a window over the conversation would not.
    """
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"], "left")
