"""Large JSON arrays of objects, read by many tasks.

A file is scanned in pieces that end at a closing brace, so a split starts anywhere. Whether a piece starts inside a
string, and how deep in brackets, follows from the quotes and brackets before it. Those are summed over each split
(a row per split), then over the splits of a file, and run on inside a split. Most pieces are whole records; only the
pieces of records with more than one brace are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import Scratch

SPLIT = ["file", "block"]
SPACE = r"[ \t\r\n]*"
#: What stands before the first record of an array and before the others; the end of an array, and an empty one.
FIRST, LATER = rf"^{SPACE}\[{SPACE}", rf"^{SPACE},{SPACE}"
END, EMPTY = rf"^{SPACE}\]{SPACE}$", rf"^{SPACE}\[{SPACE}\]{SPACE}$"
BROKEN = "broken__"


def _count(text: Column, counted: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{counted}]+", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Each piece with its place, whether its quotes are ``odd``, and the change of depth over it and its brace
    if it starts outside a string (``d0``) or inside (``d1``). An escape never goes over a brace."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", F.regexp_replace("value", r"(?s)\\.", "").alias("bare"),
    )
    rows = rows.withColumn("odd", (_count(F.col("bare"), '"') % 2).cast("long"))

    def change(inside: int) -> Column:
        text = F.concat(F.lit('"'), F.col("bare")) if inside else F.col("bare")
        outside = F.regexp_replace(text, r'"[^"]*+("|$)', "")
        brace = F.when(F.col("odd") == inside, 1).otherwise(0)
        return (_count(outside, r"\[{") - _count(outside, r"\]") - brace).cast("long")

    return rows.withColumns({"d0": change(0), "d1": change(1)}).drop("bare")


def _bases(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """For each split the sum of ``value`` over the earlier splits of its file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*SPLIT).agg(F.sum(value).alias("sum"))
    return sums.select(*SPLIT, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(name))


def _before(value: Column, base: str) -> Column:
    """The sum of ``value`` over the earlier pieces of the file."""
    own = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return F.col(base) + F.coalesce(F.sum(value).over(own), F.lit(0))


def _placed(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Pieces with how they stand to the records: ``starts``, ``ends``, or the ``last`` of the array."""
    inside = F.pmod(_before(F.col("odd"), "quotes"), F.lit(2))
    change = F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))
    quotes = scratch.write(_bases(pieces, F.col("odd"), "quotes"), "quotes")
    slim = pieces.drop("value").join(quotes, SPLIT).withColumn("inside", inside).withColumn("change", change)
    depths = scratch.write(_bases(slim, F.col("change"), "depths"), "depths")
    # Here the text is shuffled, once: a group is a split.
    known = pieces.join(quotes, SPLIT).join(depths, SPLIT).withColumn("inside", inside).withColumn("change", change)
    known = known.withColumn("depth", _before(F.col("change"), "depths"))
    top = F.col("depth") == 0
    starts = (F.col("inside") == 0) & F.col("depth").isin(0, 1)
    ends = ((F.col("inside") + F.col("odd")) % 2 == 0) & (F.col("depth") + F.col("change") == 1)
    last = starts & F.when(top, F.regexp_like("value", F.lit(EMPTY))).otherwise(F.regexp_like("value", F.lit(END)))
    # A record without its comma keeps only the brace, which no record parses from.
    own = F.when(~starts, F.col("value"))
    for of, lead in ((top, FIRST), (~top, LATER)):
        own = own.when(of & F.regexp_like("value", F.lit(lead)), F.regexp_replace("value", lead, ""))
    text = F.concat(own.otherwise(F.lit("")), F.lit("}"))
    known = known.select(*SPLIT, "at", starts.alias("starts"), ends.alias("ends"), last.alias("last"), text.alias("text"))
    return scratch.write(known, "placed")


def _texts(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``file`` and ``text`` of each record of the files that end as an array does."""
    files = placed.groupBy("file").agg(
        F.max(F.struct("block", "at", "last"))["last"].alias("closed"), F.count_if("last").alias("ends")
    )
    closed = scratch.write(files.where("closed AND ends = 1").select("file"), "closed")
    placed = placed.where("NOT last").join(closed, "file", "left_semi")
    whole = placed.where("starts AND ends").select("file", "text")
    parts = scratch.write(placed.where("NOT (starts AND ends)"), "parts")
    begun = F.col("starts").cast("long")
    parts = parts.join(scratch.write(_bases(parts, begun, "records"), "records"), SPLIT)
    parts = parts.withColumn("record", _before(begun, "records") + begun)
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    return whole.union(joined.select("file", F.array_join("p.text", "").alias("text")))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of files that hold one JSON array each, in any layout; what isn't in ``schema`` is left out.

    A file that isn't a whole array of objects gives no rows, an empty file or array neither. The files are read
    when this is called; the result is a written table."""
    scratch = Scratch(spark)
    placed = _placed(scratch.write(_pieces(spark, path), "pieces"), scratch)
    marked = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json("text", marked, {"columnNameOfCorruptRecord": BROKEN})
    rows = scratch.write(_texts(placed, scratch).select("file", parsed.alias("record")), "log_records")
    broken = rows.where(F.col("record").isNull() | F.col(f"record.{BROKEN}").isNotNull()).select("file").distinct()
    broken = scratch.write(broken, "broken_files")
    scratch.drop("log_records", "broken_files")
    return rows.join(broken, "file", "left_anti").select(*[F.col(f"record.`{c}`").alias(c) for c in schema.fieldNames()])
