"""Explicit schemas for every scan; nothing is inferred."""

from pyspark.sql import types as T

from tidemark import constants as C

LONG_CSV = T.StructType(
    [
        T.StructField(C.YEAR, T.IntegerType()),
        T.StructField(C.MONTH, T.StringType()),
        T.StructField(C.RAW_VALUE, T.DoubleType()),
    ]
)

INDICATOR_FEED = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("indicator", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("values", T.ArrayType(T.FloatType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField(C.SOURCE, T.StringType()),
                    T.StructField("text", T.StringType()),
                    T.StructField(C.YEAR, T.DoubleType()),
                    T.StructField("type", T.StringType()),
                ]
            ),
        ),
        T.StructField("type", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
