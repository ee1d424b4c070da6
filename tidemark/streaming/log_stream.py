"""The log sink as a stream: the same records appended by a file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas


def stream_log(
    records: DataFrame, path: str, checkpoint: str, once: list[str] | None = None, delay: str = "7 days"
) -> StreamingQuery:
    """Append a stream of log records as JSON lines; stops when the input is used up.

    Started again with the same ``checkpoint`` it goes on where it stopped, and a file of the input
    counts once under its name. With ``once`` a record counts once by these columns too, so that a
    file delivered again under another name adds nothing. Their values are kept until the latest
    timestamp seen is ``delay`` ahead; records older than that are dropped, as they can't be told
    from repeated ones, and so are records without a timestamp that parses.
    """
    if once:
        stamped = records.withColumn("event__time", F.try_to_timestamp("timestamp")).where(F.col("event__time").isNotNull())
        records = stamped.withWatermark("event__time", delay).dropDuplicatesWithinWatermark(once)
    return (
        records.select(*schemas.LOG.fieldNames())
        .writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
