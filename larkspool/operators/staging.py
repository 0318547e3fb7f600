"""Intermediate tables in the shared checkpoint folder, and joins against small tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A staged lookup table whose files have up to this many bytes is broadcast.
BROADCAST_BYTES = 8 << 20
#: Beyond that size, one salt of a key is for so many rows of the big side; the most frequent keys that may get salts.
ROWS_PER_SALT, HEAVY_KEYS = 1_000_000, 1_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors must share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is
    read, prunes columns, counts from file footers and carries exact size
    statistics for Catalyst.
    """
    path = f"{shared_folder(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_bytes(df: DataFrame) -> int:
    """Catalyst's size of ``df`` in bytes; for a staged table, the exact size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: str, how: str = "left") -> DataFrame:
    """Join ``big`` with a staged table that has at most one row per key.

    Below the size limit ``small`` is broadcast and ``big`` does not move. Beyond it both
    sides are shuffled on the keys. Keys of more than ROWS_PER_SALT rows of ``big``, which one
    pass over its keys finds, get salts: their rows are dealt out by the ``spread`` column, and
    only their lookup rows are repeated.
    """
    keys = list(keys)
    if known_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    salts = _salts(big, keys)
    if salts is None:
        return big.join(small, keys, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def _salts(df: DataFrame, keys: Sequence[str]) -> Column | None:
    """Salts of a row's keys by how many rows of ``df`` share them; None if no keys need more than one.

    A frequent-items sketch of the keys' hash finds them: one partial sketch per task, no shuffle
    of keys. Null keys have a hash like any other.
    """
    found = df.select(F.xxhash64(*keys).alias("_hash"))
    top = found.agg(F.expr(f"approx_top_k(_hash, {HEAVY_KEYS}, {100 * HEAVY_KEYS})")).first()[0] or []
    heavy = {r["item"]: -(-r["count"] // ROWS_PER_SALT) for r in top if r["count"] > ROWS_PER_SALT}
    if not heavy:
        return None
    known = F.create_map(*(F.lit(x).cast("bigint") for pair in heavy.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.xxhash64(*keys)), F.lit(1)).cast("int")
