"""Grading of stored predictions against targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspool.functions.algebra import algebra_equal
from larkspool.functions.text import boxed_answer, clean_answer, contains_answer, numeric_equal
from larkspool.operators.filters import both_filled
from larkspool.schemas import with_missing

_TARGET = T.StructType([T.StructField("final_answer", T.StringType())])


def grade(df: DataFrame, predicted: str = "predicted_answer", target: str = "final_answer") -> DataFrame:
    """Add ``match_kind`` (exact, numeric, contains, symbolic, none) and the verdict ``is_match``.

    The rules are tried in that order; an empty or missing answer on either side
    never matches. The containment rule is lenient on purpose: target 5 matches
    0.5, and target 1 matches -1.
    """
    said, meant = F.col(predicted), F.col(target)
    cleaned = clean_answer(said), clean_answer(meant)
    kind = (
        F.when(~both_filled(said, meant), "none")
        .when(cleaned[0] == cleaned[1], "exact")
        .when(numeric_equal(said, meant), "numeric")
        .when(contains_answer(*cleaned), "contains")
        .when(algebra_equal(said, meant), "symbolic")
        .otherwise("none")
    )
    return df.withColumn("match_kind", kind).withColumn("is_match", F.col("match_kind") != "none")


def grade_generations(predictions: DataFrame, targets: DataFrame, key: str = "item_id") -> DataFrame:
    """Join generated texts with their targets, extract the boxed answer and grade it.

    ``predictions`` has the key, ``generation`` and any other columns; ``targets``
    the key, ``instruction`` and, if known, ``final_answer``.
    """
    # Extracting before the join leaves short answers, not texts, to the comparison.
    answers = predictions.withColumn("predicted_answer", boxed_answer(F.col("generation")))
    return grade(answers.join(with_missing(targets, _TARGET), key))


def detail(graded: DataFrame, *by: str) -> DataFrame:
    """Per-sample report: question, raw prediction, extracted answer, target, verdict."""
    return graded.select(
        *by,
        F.col("instruction").alias("question"),
        F.col("generation").alias("prediction"),
        F.col("predicted_answer"),
        F.col("final_answer").alias("target"),
        F.col("is_match"),
    )


def accuracy(
    predictions: DataFrame, targets: DataFrame, by: Sequence[str] = ("model",), key: str = "item_id"
) -> DataFrame:
    """Percentage of matches over the whole test set per group; null if there are no targets.

    A target without a prediction counts as a wrong answer. ``n`` is what the
    percentage is of: graded predictions and unanswered targets. ``unanswered``
    targets and ``orphans``, predictions without a target, are counted.
    """
    answers = predictions.withColumn("predicted_answer", boxed_answer(F.col("generation")))
    known = with_missing(targets, _TARGET).select(key, "final_answer", F.lit(True).alias("_known"))
    graded = grade(answers.select(*by, key, "predicted_answer").join(known, key, "left"))
    # Per group and item first: what is counted of an item is one row, however many predictions it has.
    per_item = graded.groupBy(*by, key).agg(
        F.count_if(F.col("is_match") & F.col("_known")).alias("matches"),
        F.count("_known").alias("graded"),
        F.count_if(F.col("_known").isNull()).alias("orphans"),
    )
    sums = per_item.groupBy(*by).agg(
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("graded"), F.lit(0)).alias("graded"),
        F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"),
        F.count_if(F.col("graded") > 0).alias("answered"),
    )
    unanswered = F.lit(targets.count()) - F.col("answered")
    sums = sums.withColumn("unanswered", unanswered).withColumn("n", F.col("graded") + F.col("unanswered"))
    share = F.when(F.col("n") > 0, F.col("matches") / F.col("n") * 100.0)
    return sums.select(*by, share.alias("accuracy"), "n", "unanswered", "orphans")
