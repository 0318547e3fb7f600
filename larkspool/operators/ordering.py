"""Stratified batch order, splits, caps and batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspool.fixed_values import BATCH_SIZE, HELD_OUT_CAP, SEED, TRAIN_AND_EVAL_SHARE, TRAIN_SHARE
from larkspool.functions.draws import draw_key
from larkspool.operators.ranks import positions
from larkspool.operators.sampling import mark_first


def stratified_order(
    df: DataFrame,
    label: str,
    row_id: str,
    batch_size: int = BATCH_SIZE,
    seed: int = SEED,
    total: int | None = None,
) -> DataFrame:
    """Row id and label with the position ``pos`` of an order whose every prefix is stratified.

    Rows sorted by label, and at random within a label, are dealt out in turn to
    ``ceil(n / batch_size)`` batches, which are then chained in random order. A
    batch is thus a systematic sample over the labels. The deal is arithmetic on
    the row's rank; only row ids, labels and draw keys are shuffled. ``df`` is
    counted unless ``total`` is given, so pass a table.
    """
    keyed = df.select(row_id, label, draw_key(F.col(row_id), "order", seed).alias("_draw"))
    dealt = positions(keyed, [label, "_draw", row_id], "_rank")
    total = df.count() if total is None else total
    batches = max(1, math.ceil(total / batch_size))
    size, larger = divmod(total, batches)

    # Batch number `slot` holds one row more than `size` if it is below `larger`.
    slots = df.sparkSession.range(batches).select(
        F.col("id").alias("_slot"),
        (F.col("id") < larger).cast("bigint").alias("_extra"),
        draw_key(F.col("id"), "batch", seed).alias("_draw"),
    )
    slots = positions(slots, ["_draw", "_slot"], "_at", weight="_extra")
    starts = slots.select("_slot", (F.col("_at") * size + F.col("_at_weight")).alias("_start"))
    return (
        dealt.withColumn("_slot", F.col("_rank") % batches)
        .join(starts, "_slot")
        .select(row_id, label, (F.col("_start") + F.floor(F.col("_rank") / batches)).alias("pos"))
    )


def assign_split(df: DataFrame, total: int, pos: str = "pos") -> DataFrame:
    """Add ``split``: the first 90 % of the positions train, the next 5 % eval, the rest test."""
    split = (
        F.when(F.col(pos) < int(total * TRAIN_SHARE), "train")
        .when(F.col(pos) < int(total * TRAIN_AND_EVAL_SHARE), "eval")
        .otherwise("test")
    )
    return df.withColumn("split", split)


def cap_splits(
    df: DataFrame,
    label: str,
    row_id: str,
    cap: int = HELD_OUT_CAP,
    splits: Sequence[str] = ("eval", "test"),
    seed: int = SEED,
) -> DataFrame:
    """Reduce each of ``splits`` with more than ``cap`` rows to exactly ``cap``, keeping label shares.

    A label gets its share of ``cap``, rounded half to even. If that makes too
    few, random other rows are added; if too many, random ones go. Then ``pos``
    becomes a random order; other splits are counted from 0 in their order.
    Expects the columns ``split`` and ``pos`` of a staged table.
    """
    sizes = {r["split"]: (r["n"], r["first"]) for r in df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).collect()}  # one row per split
    capped = [s for s in splits if sizes.get(s, (0, 0))[0] > cap]
    firsts = F.coalesce(*[F.when(F.col("split") == s, F.lit(f)) for s, (_, f) in sizes.items()], F.lit(0))
    as_is = df.where(~F.col("split").isin(capped)).withColumn("pos", F.col("pos") - firsts)
    if not capped:
        return as_is

    large = df.where(F.col("split").isin(capped))
    length = F.coalesce(*[F.when(F.col("split") == s, F.lit(sizes[s][0])) for s in capped])
    quota = F.least(F.rint(F.col("_size") / length * F.lit(cap)).cast("bigint"), "_size")
    keyed = large.withColumn("_draw", draw_key(F.col(row_id), "cap", seed))
    marked = mark_first(keyed, quota, "_draw", row_id, ["split", label], "_picked").drop("_draw")
    # Repair: picked rows first, then all others, each in random order; keep the first `cap`.
    turn = F.concat(F.when(F.col("_picked"), "0").otherwise("1"), draw_key(F.col(row_id), "repair", seed))
    kept = mark_first(marked.withColumn("_turn", turn), cap, "_turn", row_id, ["split"], "_kept", fixed=1)
    # One order over all capped splits, each of which now has exactly `cap` rows.
    mixed = kept.where("_kept").drop("pos", "_kept", "_picked", "_turn").withColumn("_mix", draw_key(F.col(row_id), "mix", seed))
    kept = positions(mixed, ["split", "_mix", row_id]).withColumn("pos", F.col("pos") % cap)
    return as_is.unionByName(kept.select(*as_is.columns))


def batch_number(pos: Column, size: int) -> Column:
    """Number of the fixed-size batch that a position falls into."""
    return F.floor(pos / size)
