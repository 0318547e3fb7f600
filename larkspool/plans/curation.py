"""From raw records to train, eval and test rows.

Texts are read twice and moved at most twice (by the last join and, when written,
by the output order). In between, everything that decides which row goes where
works on narrow rows: row id, source, label, two digests and a flag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larkspool.fixed_values import BATCH_SIZE, HELD_OUT_CAP, SAMPLE_SIZE, SEED
from larkspool.operators.dedup import first_pairs, qa_digests
from larkspool.operators.filters import drop_sources, is_contaminated
from larkspool.operators.ordering import assign_split, cap_splits, stratified_order
from larkspool.operators.records import extract_qa, with_curated
from larkspool.operators.sampling import proportional_sample
from larkspool.operators.staging import stage
from larkspool.sources.writers import write_splits

COLUMNS = ["instruction", "output", "final_answer", "source", "split", "pos"]


@dataclass(frozen=True)
class Curation:
    """``rows`` of all splits, ``sizes`` of the splits, and ``audit``: rows into and out of every stage."""

    rows: DataFrame
    sizes: dict[str, int]
    audit: DataFrame

    def write(self, folder: str, rows_per_file: int = 1_000_000) -> None:
        """Write the splits as JSON lines with the four curated fields."""
        write_splits(self.rows.select(*COLUMNS), folder, self.sizes, rows_per_file)


def candidates(raw: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One narrow row per record with a question and an answer, from one pass over the texts.

    Dedup looks at the record in ``fill`` mode; ``has_answer`` tells whether the
    curated form of the record has a boxed answer.
    """
    rows = extract_qa(with_curated(drop_sources(raw)), "fill")
    keep = [row_id, "label", (F.col("final_answer") != "").alias("has_answer")]
    if "source" in raw.columns:
        keep.append("source")
    return qa_digests(rows, F.col("question"), F.col("answer"), *keep)


def curate_dataset(
    raw: DataFrame,
    size: int = SAMPLE_SIZE,
    row_id: str = "row_id",
    batch_size: int = BATCH_SIZE,
    cap: int = HELD_OUT_CAP,
    seed: int = SEED,
) -> Curation:
    """Drop contaminated sources, dedup, sample, keep boxed answers, order, split and cap.

    Sampling precedes the boxed-answer filter, so the result usually has fewer
    than ``size`` rows. Raises ``ValueError`` if no row is left.
    """
    seen = Observation("raw")
    bad = is_contaminated(F.col("source")) if "source" in raw.columns else F.lit(False)
    counted = raw.observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(~bad).alias("clean"))
    usable = stage(candidates(counted, row_id), "candidates")
    unique = stage(first_pairs(usable, row_id).drop("question_key", "answer_key"), "unique")
    n_unique = unique.count()
    sample = proportional_sample(unique, size, row_id, seed=seed, total=n_unique)
    # Sampling precedes the boxed-answer filter.
    kept = stage(sample.where("has_answer").select(row_id, "label"), "kept")
    total = kept.count()
    if not total:
        raise ValueError("no record with a question and a boxed answer")
    order = stage(stratified_order(kept, "label", row_id, batch_size, seed, total), "order")
    chosen = cap_splits(assign_split(order, total), "label", row_id, cap, seed=seed)
    chosen = stage(chosen.select(row_id, "split", "pos"), "chosen")
    sizes = dict(chosen.groupBy("split").count().collect())  # three rows

    n_raw, n_clean, n_usable = seen.get["all"], seen.get["clean"], usable.count()
    # Records are reduced to what is written before they meet the chosen rows; other raw columns can't clash.
    curated = with_curated(raw).select(row_id, *COLUMNS[:3], F.col("label").alias("source"))
    rows = curated.join(chosen, row_id).select(row_id, *COLUMNS)

    stages = [
        ("source_filter", n_raw, n_clean),
        ("non_empty", n_clean, n_usable),
        ("dedup", n_usable, n_unique),
        ("sample", n_unique, min(size, n_unique)),
        ("boxed_answer", min(size, n_unique), total),
        *[(split, total, sizes.get(split, 0)) for split in ("train", "eval", "test")],
    ]
    audit = raw.sparkSession.createDataFrame(stages, "stage string, rows_in bigint, rows_out bigint")
    return Curation(rows, sizes, audit)
