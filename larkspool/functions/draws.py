"""Reproducible random order, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(row_id: Column, purpose: str, seed: int) -> Column:
    """Sort key of a row in the random order for ``purpose``: md5 of seed, purpose and row id.

    32 hexadecimal digits, uniformly distributed; ties are broken by the row id.
    """
    return F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), row_id.cast("string")))
