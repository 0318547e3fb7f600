"""Positions of rows in the files they were read from, whatever the split of the files into tasks.

Spark deals files out in blocks whose size is a setting, and packs blocks into tasks. A
row's place in its block follows from the row numbers of its task; the rows of the blocks
in front of it, by file name and offset, do the rest. So the position depends on file names
and lines only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspool.operators.ranks import positions
from larkspool.operators.staging import lookup_join, stage


def _marked(df: DataFrame) -> DataFrame | None:
    """``df`` with file, offset of the block and row number; None if its rows come from no files."""
    try:
        return df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"),
        )
    except AnalysisException:
        return None


def line_positions(df: DataFrame, name: str, per: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position ``name`` of each row among all files, in the order of file names and lines; staged once.

    With the columns ``per`` (such as partition folders) counting starts anew for each of
    their values. ``df`` must be rows as they were read: filtered and projected at most, as a
    shuffle mixes the lines of a block. Raises ``ValueError`` if its rows come from no files, or mixed.
    """
    marked = _marked(df)
    if marked is None:
        raise ValueError("these rows come from no files")
    rows, block = stage(marked, "lines"), ["_file", "_block"]
    blocks = rows.groupBy(*per, *block).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last")
    )
    blocks = stage(blocks, "blocks")  # one row per block of a file
    if not blocks.where("_last - _first + 1 <> _n").isEmpty():
        raise ValueError("rows of a file must come as they were read, without a shuffle")
    earlier = Window.partitionBy(*per).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*block, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = lookup_join(rows, stage(starts, "block-starts"), block, "_id", "inner")
    return placed.withColumn(name, F.col("_id") + F.col("_shift")).drop(*block, "_id", "_shift")


def content_positions(df: DataFrame, name: str) -> DataFrame:
    """Add a position in the order of a digest of all columns: the same for any layout of the same rows.

    Rows that are equal in all columns are interchangeable.
    """
    keyed = df.withColumn("_key", F.md5(F.to_json(F.struct(*df.columns)))).withColumn("_tie", F.monotonically_increasing_id())
    return positions(keyed, ["_key", "_tie"], name).drop("_key", "_tie")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``line_positions`` of rows from files, ``content_positions`` of others."""
    return content_positions(df, name) if _marked(df) is None else line_positions(df, name)
