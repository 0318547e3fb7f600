"""From raw documents to packed token ids, in stages that each write Parquet.

Each stage takes what its predecessor kept; all but the last keep the columns of
``documents``. ``run`` applies them to a table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspool.llm import decontamination, mixing, ngram_join, packing, toxicity
from larkspool.llm.common import ensure_folder, small_batches, stage
from larkspool.llm.queries import quality_domains

#: Target shares of words by kind of document, once toxic documents are gone.
TARGETS = {"q1t0": 0.92, "q0t0": 0.08}
#: How far a share may be off its target; anything more ends the stage with an error.
WITHIN = 0.001


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a classifier trained on the table ``labels`` rejects."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold 10 consecutive words of an item of the table ``benchmark``."""
    small_batches(spark)
    return decontamination.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles."""
    small_batches(spark)
    return ngram_join.drop_near_duplicates(docs, size=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents at rates of 1 or more, so that kinds of documents have their shares; none is dropped.

    The words used are as many as the targets need.
    """
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix_documents(docs, labels, TARGETS, least=1.0, most_budget=None, within=WITHIN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed rows."""
    small_batches(spark)
    return packing.pack(docs, packing.Tokenizer.read())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written to the shared folder and reread."""
    ensure_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
