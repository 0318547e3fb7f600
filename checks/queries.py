"""One query per operator. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks import inputs
from larkspool.fixed_values import PSYCHOLOGY_SYSTEM_PROMPT
from larkspool.functions import algebra, chat, text
from larkspool.operators import dedup, filters, grading, metrics, ordering, ranks, records, reports, sampling
from larkspool.operators.staging import shared_folder, stage
from larkspool.plans.curation import curate_dataset
from larkspool.plans.evaluation import evaluate
from larkspool.schemas import CURATED, RUN_LOG, with_missing
from larkspool.sources import readers, writers

#: Token pattern that stands for the response template in the mask query.
TEMPLATE = [4, 3]
TOKEN_LIMIT = 512
TITLE = "# Results"
EXPERIMENTS = ["Baseline", "Finetuned", "Third run"]
SPLIT_CAP = 500


def _documents(spark, sf_dir, *columns):
    return inputs.texts(spark, sf_dir, "documents").select(*columns)


def _sources(spark, sf_dir):
    """Row id and source of the raw records; one source is null."""
    return inputs.raw_records(spark, sf_dir).select("row_id", "source")


def _folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# --- filters and extraction ---------------------------------------------------


def source_filter(spark, sf_dir):
    return filters.drop_sources(_sources(spark, sf_dir))


def qa_fill(spark, sf_dir):
    return records.extract_qa(inputs.raw_records(spark, sf_dir), "fill").select("row_id", "question", "answer")


def qa_prefer_messages(spark, sf_dir):
    return records.extract_qa(inputs.raw_records(spark, sf_dir)).select("row_id", "question", "answer")


def qa_from_turns(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    return records.qa_from_turns(turns, "conv_id", "turn", "role", "text")


def conversation_fallback(spark, sf_dir):
    rows = records.extract_qa(inputs.raw_records(spark, sf_dir))
    return records.with_conversation_fallback(rows).select("row_id", "question", "answer")


def missing_columns(spark, sf_dir):
    return with_missing(_documents(spark, sf_dir, F.col("doc_id").alias("step"), "text"), RUN_LOG)


def normalized_text(spark, sf_dir):
    return _documents(spark, sf_dir, "doc_id", text.normalize_text(F.col("text")).alias("normalized"))


def non_empty_pairs(spark, sf_dir):
    rows = records.extract_qa(inputs.raw_records(spark, sf_dir), "fill")
    return dedup.qa_digests(rows, F.col("question"), F.col("answer"), "row_id").select("row_id")


# --- dedup --------------------------------------------------------------------


def dedup_question(spark, sf_dir):
    rows = records.extract_qa(inputs.raw_records(spark, sf_dir), "fill").where("question != ''")
    key = text.normalize_text(F.col("question"))
    return dedup.dedup_first(rows, key, "row_id").select("row_id", "question")


def dedup_question_answer(spark, sf_dir):
    rows = records.extract_qa(inputs.raw_records(spark, sf_dir), "fill")
    return dedup.dedup_qa(rows, F.col("question"), F.col("answer"), "row_id").select("row_id", "question", "answer")


def dedup_documents(spark, sf_dir):
    docs = inputs.texts(spark, sf_dir, "documents")
    return dedup.dedup_first(docs, text.normalize_text(F.col("text")), "doc_id").select("doc_id", "source")


# --- curation -----------------------------------------------------------------


def boxed_answers(spark, sf_dir):
    rows = records.extract_qa(inputs.raw_records(spark, sf_dir))
    return rows.select("row_id", text.boxed_answer(F.col("answer")).alias("final_answer"))


def curated_rows(spark, sf_dir):
    return records.curate(inputs.raw_records(spark, sf_dir))


def curated_without_source(spark, sf_dir):
    return records.curate(inputs.raw_records(spark, sf_dir).drop("source"))


def _curated(spark, sf_dir):
    raw = inputs.raw_records(spark, sf_dir)
    half = inputs.table(spark, sf_dir, "documents").count() // 2
    return curate_dataset(raw, half, cap=max(1, half // 40))


def curated_splits(spark, sf_dir):
    return _curated(spark, sf_dir).rows


def curated_from_table(spark, sf_dir):
    """Curation of a named table with a split column, and raw columns named like the result's."""
    rows = inputs.raw_records(spark, sf_dir).withColumns({"split": F.lit("train"), "pos": F.lit("raw")})
    rows.createOrReplaceTempView("larkspool_raw_table")
    raw = readers.read_raw(spark, "larkspool_raw_table", "train")
    quarter = inputs.table(spark, sf_dir, "documents").count() // 4
    return curate_dataset(raw, quarter, cap=max(1, quarter // 40)).rows


def stage_audit(spark, sf_dir):
    return _curated(spark, sf_dir).audit


# --- sampling -----------------------------------------------------------------


def source_distribution(spark, sf_dir):
    return sampling.source_distribution(_sources(spark, sf_dir))


def _quarter(df):
    return df.count() // 4


def source_allocation(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    return sampling.allocate(rows, _quarter(rows))


def stratified_sample(spark, sf_dir):
    rows = stage(_sources(spark, sf_dir), "sources")
    return sampling.stratified_sample(rows, _quarter(rows), "row_id")


def sample_topup(spark, sf_dir):
    rows = stage(_sources(spark, sf_dir), "sources")
    return sampling.proportional_sample(rows, _quarter(rows), "row_id")


def plain_sample(spark, sf_dir):
    rows = _documents(spark, sf_dir, "doc_id", "lang")
    return sampling.plain_sample(rows, _quarter(rows), "doc_id")


def hash_shuffle(spark, sf_dir):
    return sampling.shuffle_positions(inputs.table(spark, sf_dir, "orders"), "o_orderkey")


def head_limit(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.head(rows, _quarter(rows), "o_orderkey")


# --- ordering and splits ------------------------------------------------------


def _order(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    return ordering.stratified_order(orders, "o_orderpriority", "o_orderkey")


def stratified_order(spark, sf_dir):
    return _order(spark, sf_dir)


def split_assign(spark, sf_dir):
    total = inputs.table(spark, sf_dir, "orders").count()
    return ordering.assign_split(_order(spark, sf_dir), total)


def split_capped(spark, sf_dir):
    order = stage(_order(spark, sf_dir), "order")
    split = ordering.assign_split(order, order.count())
    return ordering.cap_splits(split, "o_orderpriority", "o_orderkey", SPLIT_CAP)


def batches(spark, sf_dir):
    order = _order(spark, sf_dir)
    return order.select("o_orderkey", ordering.batch_number(F.col("pos"), 64).alias("batch"))


# --- chat ---------------------------------------------------------------------


def _instructions(spark, sf_dir):
    ask = F.split("text", "\n")[0].alias("instruction")
    return _documents(spark, sf_dir, "doc_id", ask, F.col("text").alias("output"))


def chat_text(spark, sf_dir):
    rows = _instructions(spark, sf_dir)
    return rows.select("doc_id", chat.chat_text(F.col("instruction"), F.col("output")).alias("text"))


def chat_prompt(spark, sf_dir):
    rows = _instructions(spark, sf_dir)
    prompt = chat.chat_prompt(F.col("output"), PSYCHOLOGY_SYSTEM_PROMPT)
    return rows.select("doc_id", prompt.alias("prompt"))


def completion_mask(spark, sf_dir):
    rows = inputs.tokens(spark, sf_dir)
    labels = chat.mask_prompt(F.col("tokens"), TEMPLATE)
    return rows.select("doc_id", F.array_join(labels, " ").alias("labels"))


def completion_text(spark, sf_dir):
    rows = _instructions(spark, sf_dir)
    made = chat.chat_text(F.col("instruction"), F.col("output"))
    return rows.select("doc_id", chat.completion_text(made).alias("completion"))


def truncated_tokens(spark, sf_dir):
    rows = inputs.tokens(spark, sf_dir)
    kept = chat.truncate_tokens(F.col("tokens"), TOKEN_LIMIT)
    return rows.select("doc_id", F.size(kept).alias("n"), F.array_join(kept, " ").alias("tokens"))


# --- grading ------------------------------------------------------------------


def _pairs(spark, sf_dir):
    said = inputs.predictions(spark, sf_dir)
    said = said.withColumn("said", text.boxed_answer(F.col("generation")))
    keys = ["item_id", "model", "l_partkey", "l_linenumber", "said"]
    return said.join(inputs.targets(spark, sf_dir), "item_id").select(*keys, F.col("final_answer").alias("meant"))


def answer_cleaned(spark, sf_dir):
    rows = inputs.targets(spark, sf_dir)
    return rows.select("item_id", text.clean_answer(F.col("final_answer")).alias("cleaned"))


def answer_exact(spark, sf_dir):
    same = text.clean_answer(F.col("said")) == text.clean_answer(F.col("meant"))
    return _pairs(spark, sf_dir).withColumn("same", same)


def answer_numeric(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("same", text.numeric_equal(F.col("said"), F.col("meant")))


def answer_contains(spark, sf_dir):
    same = text.contains_answer(text.clean_answer(F.col("said")), text.clean_answer(F.col("meant")))
    return _pairs(spark, sf_dir).withColumn("same", same)


def answer_equivalent(spark, sf_dir):
    """Pairs of expressions with names, half of them equal by construction."""
    rows = inputs.expressions(spark, sf_dir)
    return rows.withColumn("same", algebra.algebra_equal(F.col("said"), F.col("meant")))


def _graded(spark, sf_dir):
    return grading.grade_generations(inputs.predictions(spark, sf_dir), inputs.targets(spark, sf_dir))


def graded(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return rows.select("item_id", "model", "l_partkey", "l_linenumber", "predicted_answer", "match_kind", "is_match")


def graded_detail(spark, sf_dir):
    return grading.detail(_graded(spark, sf_dir), "item_id", "model")


def accuracy_by_model(spark, sf_dir):
    return grading.accuracy(inputs.predictions(spark, sf_dir), inputs.targets(spark, sf_dir))


# --- metrics and reports ------------------------------------------------------


def metric_choice(spark, sf_dir):
    return metrics.task_scores(readers.parse_results(inputs.results(spark, sf_dir)))


def evaluated_models(spark, sf_dir):
    stored = readers.parse_results(inputs.results(spark, sf_dir))
    return evaluate(inputs.predictions(spark, sf_dir), inputs.targets(spark, sf_dir), stored)


def scores_by_experiment(spark, sf_dir):
    return reports.scores_by_experiment(inputs.scores(spark, sf_dir))


def scores_by_benchmark(spark, sf_dir):
    return reports.scores_by_benchmark(inputs.scores(spark, sf_dir), EXPERIMENTS)


def compare_change(spark, sf_dir):
    wide = reports.compare(inputs.scores(spark, sf_dir), "Baseline", "Finetuned")
    return wide.select("benchmark", "Baseline", "Finetuned", "change")


def report_by_experiment(spark, sf_dir):
    return reports.report_by_experiment(inputs.scores(spark, sf_dir), TITLE, EXPERIMENTS)


def report_by_benchmark(spark, sf_dir):
    return reports.report_by_benchmark(inputs.scores(spark, sf_dir), TITLE, EXPERIMENTS)


def report_comparison(spark, sf_dir):
    return reports.report_comparison(inputs.scores(spark, sf_dir), TITLE, "Baseline", "Finetuned")


def training_curves(spark, sf_dir):
    return metrics.training_curves(inputs.run_log(spark, sf_dir))


# --- files and tables ---------------------------------------------------------


def _stored_splits(spark, sf_dir):
    """A folder of curated rows with a split per language, 100 per file; positions are dense within a split."""
    rows = records.curate(inputs.raw_records(spark, sf_dir))
    lang = _documents(spark, sf_dir, F.col("doc_id").alias("row_id"), F.col("lang").alias("split"))
    order = ranks.positions(rows.join(lang, "row_id"), ["split", "row_id"], "at")
    first = order.groupBy("split").agg(F.min("at").alias("first"))
    placed = order.join(F.broadcast(first), "split").withColumn("pos", F.col("at") - F.col("first"))
    folder = _folder(spark)
    writers.write_splits(placed.drop("at", "first", "row_id"), folder, rows_per_file=100)
    return folder


def split_files(spark, sf_dir):
    """Curated rows written as JSON lines and read back in order, with their positions and batches."""
    rows = readers.read_splits(spark, _stored_splits(spark, sf_dir), CURATED, pos=True)
    return rows.withColumn("batch", ordering.batch_number(F.col("pos"), 32))


def training_text(spark, sf_dir):
    """Chat text of the stored splits, in order."""
    return readers.training_text(spark, _stored_splits(spark, sf_dir))


def ingested_rows(spark, sf_dir):
    """Documents written to several files in the order of their ids, and numbered by file and line."""
    docs = ranks.positions(_documents(spark, sf_dir, "doc_id", "text", "lang"), ["doc_id"])
    folder = _folder(spark)
    writers.write_splits(docs.withColumn("split", F.lit("all")), folder, rows_per_file=150)
    return readers.ingest(readers.read_jsonl(spark, folder, StructType.fromDDL("doc_id long, text string, lang string"))).drop("split")


def jsonl_scan(spark, sf_dir):
    """Raw records written as JSON lines, found by path and read with the declared schema."""
    folder = _folder(spark)
    inputs.raw_records(spark, sf_dir).write.json(folder)
    rows = readers.read_raw(spark, folder)
    return rows.select("row_id", "problem", "solution", F.size("messages").alias("n_messages"), "source")


def table_scan(spark, sf_dir):
    """The same records as a named table with a split column."""
    rows = inputs.raw_records(spark, sf_dir).withColumn("split", F.when(F.col("messages").isNull(), "train"))
    rows.createOrReplaceTempView("larkspool_raw_records")
    return readers.read_raw(spark, "larkspool_raw_records", "train").select("row_id", "problem", "solution")


def result_files(spark, sf_dir):
    """Benchmark results as the harness writes them, with texts and lists among the numbers, read as nested maps and scored."""
    folder = _folder(spark)
    inputs.results(spark, sf_dir).write.text(folder)
    return metrics.task_scores(readers.read_results(spark, folder))


def report_file(spark, sf_dir):
    """A report written as text and read back, one row per line."""
    path = _folder(spark)
    report = reports.report_by_benchmark(inputs.scores(spark, sf_dir), TITLE, EXPERIMENTS)
    writers.write_report(report, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


QUERIES = {
    f.__name__: f
    for f in (
        source_filter, qa_fill, qa_prefer_messages, qa_from_turns, conversation_fallback, missing_columns,
        normalized_text, non_empty_pairs, dedup_question, dedup_question_answer, dedup_documents,
        boxed_answers, curated_rows, curated_without_source, curated_splits, curated_from_table, stage_audit,
        source_distribution, source_allocation, stratified_sample, sample_topup, plain_sample,
        hash_shuffle, head_limit, stratified_order, split_assign, split_capped, batches,
        chat_text, chat_prompt, completion_mask, completion_text, truncated_tokens,
        answer_cleaned, answer_exact, answer_numeric, answer_contains, answer_equivalent, graded, graded_detail, accuracy_by_model,
        metric_choice, evaluated_models, scores_by_experiment, scores_by_benchmark, compare_change,
        report_by_experiment, report_by_benchmark, report_comparison, training_curves,
        split_files, training_text, ingested_rows, jsonl_scan, table_scan, result_files, report_file,
    )
}
