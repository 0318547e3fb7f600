"""From stored generations and benchmark results to scores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.fixed_values import BENCHMARKS
from larkspool.operators.grading import accuracy
from larkspool.operators.metrics import task_scores


def evaluate(
    predictions: DataFrame, targets: DataFrame, results: DataFrame | None = None, key: str = "item_id"
) -> DataFrame:
    """Scores (experiment, benchmark, score): graded accuracy and stored benchmark metrics per model."""
    reasoning = accuracy(predictions, targets, key=key).select(
        F.col("model").alias("experiment"), F.lit("Reasoning").alias("benchmark"), F.col("accuracy").alias("score")
    )
    if results is None:
        return reasoning
    names = F.create_map(*chain.from_iterable((F.lit(n.lower()), F.lit(n)) for n, _, _ in BENCHMARKS))
    general = task_scores(results).select(
        F.col("model").alias("experiment"), F.try_element_at(names, F.col("task")).alias("benchmark"), "score"
    )
    return reasoning.unionByName(general)
