"""Exact keep-first dedup on normalized text.

Shuffles that decide carry digests and row ids, never text. The texts of the result
stay where they are while the ids of the rows to drop are few enough to be
broadcast; beyond that, one join by row id moves them. ``row_number() = 1`` makes
Catalyst place a group limit in front of the exchange, so each task sends at
most one row per key: a key that holds a third of the table costs one row per
task, not a third of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspool.functions.text import has_text, normalize_text
from larkspool.operators.filters import compute_and_keep
from larkspool.operators.staging import lookup_join, stage


def digest(text: Column) -> Column:
    """32-byte SHA-256 digest of a text."""
    return F.unhex(F.sha2(text, 256))


def first_rows(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The row with the smallest row id for each value of ``key``."""
    order = Window.partitionBy(key).orderBy(row_id)
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).drop("_nth")


def _without(df: DataFrame, rows: DataFrame, kept: DataFrame, row_id: str) -> DataFrame:
    """``df`` without the ``rows`` that are not ``kept``, by their ids."""
    dropped = stage(rows.select(row_id).join(kept.select(row_id), row_id, "left_anti"), "dropped")
    return lookup_join(df, dropped, [row_id], row_id, "left_anti")


def dedup_first(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """``df`` without the later rows that share ``key`` with an earlier one."""
    rows = stage(df.select(row_id, digest(key).alias("_key")), "keys")
    return _without(df, rows, first_rows(rows, "_key", row_id), row_id)


def qa_digests(df: DataFrame, question: Column, answer: Column, *keep: Column | str) -> DataFrame:
    """``keep`` plus digests of both normalized texts, for rows where neither is empty."""
    texts = compute_and_keep(
        df, keep, {"_q": question, "_a": answer}, lambda row: has_text(row["_q"]) & has_text(row["_a"])
    )
    return texts.select(
        *[name for name in texts.columns if name not in ("_q", "_a")],
        digest(normalize_text(F.col("_q"))).alias("question_key"),
        digest(normalize_text(F.col("_a"))).alias("answer_key"),
    )


def first_pairs(digests: DataFrame, row_id: str) -> DataFrame:
    """Keep-first by question, then keep-first by answer among the survivors."""
    return first_rows(first_rows(digests, "question_key", row_id), "answer_key", row_id)


def dedup_qa(df: DataFrame, question: Column, answer: Column, row_id: str) -> DataFrame:
    """``df`` without empty pairs, repeated questions and, after that, repeated answers."""
    pairs = stage(qa_digests(df, question, answer, row_id), "pairs")
    full = compute_and_keep(
        df, df.columns, {"_q": question, "_a": answer}, lambda row: has_text(row["_q"]) & has_text(row["_a"])
    ).select(*df.columns)
    return _without(full, pairs, first_pairs(pairs, row_id), row_id)
