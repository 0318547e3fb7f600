"""Declared schemas of the records this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
)

CONVERSATIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("from", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField(
                "ground_truth",
                T.StructType([T.StructField("value", T.StringType())]),
            ),
        ]
    )
)

#: Raw training records. Any of these columns may be absent in a given file.
RAW = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("problem", T.StringType()),
        T.StructField("solution", T.StringType()),
        T.StructField("messages", MESSAGES),
        T.StructField("conversations", CONVERSATIONS),
        T.StructField("source", T.StringType()),
    ]
)

#: The columns that extraction reads; whichever are absent count as null.
QA_PART = T.StructType([RAW["problem"], RAW["solution"], RAW["messages"]])
CONVERSATION_PART = T.StructType([RAW["conversations"]])

#: Curated records, as written to the split files.
CURATED = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("final_answer", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

#: One stored benchmark result: the metrics of one task for one model.
RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField(
            "results",
            T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())),
        ),
    ]
)

#: Sparse training-log rows.
RUN_LOG = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("eval_accuracy", T.DoubleType()),
    ]
)


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks, as a typed null."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(absent) if absent else df
