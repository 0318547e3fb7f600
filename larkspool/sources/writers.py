"""Writers."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(
    df: DataFrame, folder: str, sizes: Mapping[str, int] | None = None, rows_per_file: int = 1_000_000
) -> None:
    """Write JSON lines to ``folder/split=<name>/`` in one pass, ordered by ``pos`` within a split.

    Positions are dense, so a row's file follows from its position: one shuffle,
    without the extra pass over the texts that range boundaries would take. A
    split folder read in file-name order is in order. Text is written as UTF-8
    without escapes; ``pos`` itself is not written. ``sizes`` are the rows per
    split, looked up if not given.
    """
    if sizes is None:
        sizes = dict(df.groupBy("split").agg(F.max("pos") + 1).collect())  # one row per split
    number, files = F.lit(0), 0
    for split in sorted(sizes):
        number = F.when(F.col("split") == split, files + F.floor(F.col("pos") / rows_per_file)).otherwise(number)
        files += math.ceil(sizes[split] / rows_per_file)
    placed = df.repartitionById(max(files, 1), number.cast("int")).sortWithinPartitions("split", "pos")
    placed.drop("pos").write.partitionBy("split").option("ignoreNullFields", "false").json(folder)


def write_report(report: DataFrame, path: str) -> None:
    """Write a report (line_no, line) as one text file. Reports have a few lines per experiment."""
    report.repartition(1).sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.text(path)
