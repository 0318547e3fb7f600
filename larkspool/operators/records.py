"""Question and answer extraction from raw records, and the curated projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.fixed_values import SOURCE_COLUMN_MISSING, SOURCE_NULL
from larkspool.functions.text import boxed_answer
from larkspool.operators.filters import both_filled, compute_and_keep
from larkspool.schemas import CONVERSATION_PART, QA_PART, with_missing


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _turn(turns: Column, index: int, keep) -> Column:
    return F.try_element_at(F.filter(turns, keep), F.lit(index))


def _said(messages: Column, role: str, index: int) -> Column:
    turn = _turn(messages, index, lambda m: (m["role"] == role) & (m["content"] != ""))
    return turn["content"]


def extract_qa(df: DataFrame, mode: str = "prefer_messages") -> DataFrame:
    """Add ``question`` and ``answer`` taken from problem, solution and messages.

    The first non-empty user message fills an empty question; the last non-empty
    assistant message overrides the answer, even a present one.

    ``mode="prefer_messages"`` always reads the messages; ``mode="fill"`` reads
    them only if the problem or the solution is empty.
    """
    if mode not in ("fill", "prefer_messages"):
        raise ValueError(f"unknown mode {mode!r}")
    df = with_missing(df, QA_PART)
    question, answer, messages = _filled(F.col("problem")), _filled(F.col("solution")), F.col("messages")
    asked = F.when(question == "", _filled(_said(messages, "user", 1))).otherwise(question)
    replied = F.coalesce(_said(messages, "assistant", -1), answer)
    if mode == "fill":
        replied = F.when((question == "") | (answer == ""), replied).otherwise(answer)
        asked = F.when((question == "") | (answer == ""), asked).otherwise(question)
    return df.withColumns({"question": asked, "answer": replied})


def with_conversation_fallback(df: DataFrame) -> DataFrame:
    """Where question or answer is still empty, take both from the conversations.

    The last human turn overwrites the question and the last assistant turn the
    answer; if that turn's value is empty its ground truth is used instead.
    """
    df = with_missing(df, CONVERSATION_PART)
    asked = _turn(F.col("conversations"), -1, lambda t: t["from"] == "human")
    replied = _turn(F.col("conversations"), -1, lambda t: t["from"] == "assistant")
    told = F.when(_filled(replied["value"]) != "", replied["value"]).otherwise(
        _filled(replied["ground_truth"]["value"])
    )
    empty = ~both_filled(F.col("question"), F.col("answer"))
    return df.withColumns(
        {
            "question": F.when(empty & asked.isNotNull(), _filled(asked["value"])).otherwise(F.col("question")),
            "answer": F.when(empty & replied.isNotNull(), told).otherwise(F.col("answer")),
        }
    )


def qa_from_turns(turns: DataFrame, record: str, position: str, role: str, content: str) -> DataFrame:
    """``extract_qa`` for messages stored as one row per turn.

    First non-empty user turn and last non-empty assistant turn per record. Their
    positions come from a hash aggregate over numbers; the two texts are fetched by
    them, so turns are not sorted and no record is gathered as a list.
    """
    asked = F.when((F.col(role) == "user") & (F.col(content) != ""), F.col(position))
    replied = F.when((F.col(role) == "assistant") & (F.col(content) != ""), F.col(position))
    ends = turns.groupBy(record).agg(F.min(asked).alias("_asked"), F.max(replied).alias("_replied"))

    def text(at: str, who: str, name: str) -> DataFrame:
        said = turns.where((F.col(role) == who) & (F.col(content) != ""))
        return said.select(record, F.col(position).alias(at), F.col(content).alias(name))

    out = ends.join(text("_asked", "user", "question"), [record, "_asked"], "left")
    out = out.join(text("_replied", "assistant", "answer"), [record, "_replied"], "left")
    return out.select(record, _filled(F.col("question")).alias("question"), _filled(F.col("answer")).alias("answer"))


def source_label(df: DataFrame, source: str = "source") -> Column:
    """The source as text: a null reads ``None``, a missing column ``unknown``."""
    if source not in df.columns:
        return F.lit(SOURCE_COLUMN_MISSING)
    return F.coalesce(F.col(source).cast("string"), F.lit(SOURCE_NULL))


def with_curated(df: DataFrame) -> DataFrame:
    """Add ``instruction``, ``output``, ``final_answer`` and ``label`` to every record.

    The final answer is empty if the record is incomplete or has no boxed answer.
    """
    rows = with_conversation_fallback(extract_qa(df.withColumn("label", source_label(df))))
    question, answer = F.col("question"), F.col("answer")
    final = F.when(both_filled(question, answer), boxed_answer(answer))
    return rows.withColumns(
        {"instruction": question, "output": answer, "final_answer": _filled(final)}
    ).drop("question", "answer")


def curate(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Instruction, output, final answer and source of every record with a boxed answer."""
    return compute_and_keep(
        with_curated(df),
        [row_id, "instruction", "output"],
        {"final_answer": F.col("final_answer"), "source": F.col("label")},
        lambda row: row["final_answer"] != "",
    )
