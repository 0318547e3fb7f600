"""Positions in a total order, computed without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspool.operators.staging import stage

# monotonically_increasing_id() = (partition << 33) + row within the partition.
_ROW_BITS = 33


def positions(df: DataFrame, order: Sequence[str], name: str = "pos", weight: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order given by ``order``.

    One range shuffle sorts the rows over all tasks; ``order`` must end in a
    unique column, so the range boundaries can also split a hot leading value.
    Each task numbers its own rows and the task sizes, one row per task, give the
    offsets. With ``weight``, ``<name>_weight`` is the weight sum of all earlier rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "positions")
    task = F.shiftright("_id", _ROW_BITS)
    ranged = ranged.withColumns({"_task": task, "_row": F.col("_id") - F.shiftleft(task, _ROW_BITS)})

    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_task").agg(
        F.count(F.lit(1)).alias("_n"), (F.sum(weight) if weight else F.lit(0)).cast("bigint").alias("_w")
    )
    # One row per shuffle partition: bounded by the session's partition count.
    offsets = sizes.select(
        "_task",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_start_w"),
    )
    placed = ranged.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_start") + F.col("_row"))
    if weight:
        within = Window.partitionBy("_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(weight).over(within).cast("bigint"), F.lit(0))
        placed = placed.withColumn(f"{name}_weight", F.col("_start_w") + before)
    return placed.drop("_id", "_task", "_row", "_start", "_start_w")
