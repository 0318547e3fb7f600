"""Score tables and their Markdown form.

Scores are long rows (experiment, benchmark, score): a handful per experiment.
Markdown reports are rows (line_no, line).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspool.fixed_values import (
    BENCHMARK_WIDTH,
    BENCHMARKS,
    EXPERIMENT_WIDTH,
    NOT_AVAILABLE,
    SCORE_WIDTH,
)
from larkspool.functions.numbers import left_justified, two_decimals

_NAMES = [name for name, _, _ in BENCHMARKS]


def _benchmark_number(benchmark: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in _NAMES]), benchmark)


def _heading(benchmark: Column) -> Column:
    headings = F.create_map(*chain.from_iterable((F.lit(n), F.lit(h)) for n, h, _ in BENCHMARKS))
    return F.try_element_at(headings, benchmark)


def scores_by_experiment(scores: DataFrame) -> DataFrame:
    """One row per experiment, one column per benchmark."""
    return scores.groupBy("experiment").pivot("benchmark", _NAMES).agg(F.max("score"))


def scores_by_benchmark(scores: DataFrame, experiments: Sequence[str]) -> DataFrame:
    """One row per benchmark in report order (``number``), one column per experiment that ran."""
    known = scores.where(_benchmark_number(F.col("benchmark")) > 0)
    wide = known.groupBy("benchmark").pivot("experiment", list(experiments)).agg(F.max("score"))
    return wide.withColumn("number", _benchmark_number(F.col("benchmark")))


def compare(scores: DataFrame, baseline: str, finetuned: str) -> DataFrame:
    """Both experiments side by side with the change; fails if one of them has no scores."""
    wide = scores_by_benchmark(scores, [baseline, finetuned])
    ran = wide.agg(F.count(f"`{baseline}`"), F.count(f"`{finetuned}`")).first()
    for name, n in zip((baseline, finetuned), ran):
        if not n:
            raise ValueError(f"no scores for {name!r}")
    return wide.withColumn("change", F.col(f"`{finetuned}`") - F.col(f"`{baseline}`"))


def score_cell(score: Column, width: int, signed: bool = False) -> Column:
    """A score with two decimals, or N/A, padded to ``width``."""
    return left_justified(F.coalesce(two_decimals(score, signed), F.lit(NOT_AVAILABLE)), width)


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _with_head(body: DataFrame, head: Sequence[str]) -> DataFrame:
    """Number the ``line`` column of ``body`` by its ``number`` behind the fixed head lines."""
    first = F.lit(len(head))
    lines = F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "line")
    top = body.sparkSession.range(1).select(lines)
    return top.select(F.col("line_no").cast("bigint"), "line").unionByName(
        body.select((F.col("number") - 1 + first).cast("bigint").alias("line_no"), "line")
    )


def report_by_experiment(scores: DataFrame, title: str, experiments: Sequence[str]) -> DataFrame:
    """Markdown table with one line per experiment, in the given order.

    A missing GSM8K score reads 0.00, any other missing score N/A.
    """
    names = F.array(*[F.lit(e) for e in experiments])
    wide = scores_by_experiment(scores.where(F.col("experiment").isin(list(experiments))))
    cells = [left_justified(F.col("experiment"), EXPERIMENT_WIDTH)]
    for name, _, width in BENCHMARKS:
        score = F.coalesce(F.col(name), F.lit(0.0)) if name == "GSM8K" else F.col(name)
        cells.append(score_cell(score, width))
    # Experiments that did not run leave no gap in the line numbers.
    ran = Window.orderBy(F.array_position(names, F.col("experiment")))
    body = wide.select(F.row_number().over(ran).alias("number"), _row(*cells).alias("line"))
    widths = [EXPERIMENT_WIDTH] + [w for _, _, w in BENCHMARKS]
    titles = ["Experiment"] + [h for _, h, _ in BENCHMARKS]
    header = "| " + " | ".join(t.ljust(w) for t, w in zip(titles, widths)) + " |"
    rule = "|" + "|".join("-" * (w + 2) for w in widths) + "|"
    return _with_head(body, [title, "", header, rule])


def _side_by_side(wide: DataFrame, title: str, experiments: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    cells = [left_justified(_heading(F.col("benchmark")), BENCHMARK_WIDTH)]
    cells += [score_cell(F.col(f"`{e}`"), SCORE_WIDTH) for e in experiments]
    body = wide.select("number", _row(*cells, *extra.values()).alias("line"))
    titles = ["Benchmark".ljust(BENCHMARK_WIDTH), *[e.ljust(SCORE_WIDTH) for e in experiments], *extra]
    rule = ["-" * BENCHMARK_WIDTH] + ["-" * SCORE_WIDTH] * (len(experiments) + len(extra))
    return _with_head(body, [title, "", "| " + " | ".join(titles) + " |", "|" + "|".join(rule) + "|"])


def _every_benchmark(wide: DataFrame) -> DataFrame:
    """One row for each known benchmark, numbered from 1, whether or not there are scores."""
    every = wide.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(n) for n in _NAMES])).alias("number", "benchmark")
    )
    return every.withColumn("number", F.col("number") + 1).join(wide.drop("number"), "benchmark", "left")


def report_by_benchmark(scores: DataFrame, title: str, experiments: Sequence[str]) -> DataFrame:
    """Markdown table with one line per benchmark and one column per experiment; every benchmark has a line."""
    return _side_by_side(_every_benchmark(scores_by_benchmark(scores, experiments)), title, experiments, {})


def report_comparison(scores: DataFrame, title: str, baseline: str, finetuned: str) -> DataFrame:
    """Markdown table of two experiments with the signed change; every benchmark has a line."""
    change = score_cell(F.col("change"), SCORE_WIDTH, signed=True)
    wide = _every_benchmark(compare(scores, baseline, finetuned))
    return _side_by_side(wide, title, [baseline, finetuned], {"Change": change})
