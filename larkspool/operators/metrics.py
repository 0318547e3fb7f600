"""Benchmark metrics and training curves from stored logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.fixed_values import METRIC_KEYS


def pick_metric(task: Column, metrics: Column, keys: Mapping[str, Sequence[str]] = METRIC_KEYS) -> Column:
    """Percentage of the first metric of the task that is present, 0 if none is; null for unknown tasks."""
    score = F.lit(None).cast("double")
    for name, names in keys.items():
        found = F.coalesce(*[F.try_element_at(metrics, F.lit(k)) for k in names], F.lit(0.0))
        score = F.when(task == name, found * 100.0).otherwise(score)
    return score


def task_scores(results: DataFrame, keys: Mapping[str, Sequence[str]] = METRIC_KEYS) -> DataFrame:
    """One row (model, task, score) per known task of nested benchmark results."""
    # A plain explode infers a filter on the map's size, for which the map would be made twice.
    tasks = results.select("model", F.explode_outer("results").alias("task", "metrics"))
    scored = tasks.where(F.col("task").isin(list(keys)))
    return scored.select("model", "task", pick_metric(F.col("task"), F.col("metrics"), keys).alias("score"))


def training_curves(log: DataFrame) -> DataFrame:
    """Loss and accuracy series (in percent) of every run, from sparse log rows with optional keys."""
    points = F.array(
        F.struct(F.lit("loss").alias("series"), F.col("loss").alias("value")),
        F.struct(F.lit("eval_accuracy").alias("series"), (F.col("eval_accuracy") * 100.0).alias("value")),
    )
    return (
        log.where(F.col("step").isNotNull())
        .select("run", "step", F.inline(points))
        .where(F.col("value").isNotNull())
    )
