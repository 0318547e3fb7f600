import random

import pytest
from pyspark.sql import functions as F

from larkspool.operators import filters, records
from larkspool.schemas import RAW, with_missing


def row(row_id=1, problem=None, solution=None, messages=None, conversations=None, source=None):
    return (
        row_id, problem, solution,
        None if messages is None else [dict(role=r, content=c) for r, c in messages],
        None if conversations is None
        else [{"from": f, "value": v, "ground_truth": None if g is None else {"value": g}} for f, v, g in conversations],
        source,
    )


def qa(spark, rows, mode="prefer_messages", fallback=False):
    df = records.extract_qa(spark.createDataFrame(rows, RAW), mode)
    if fallback:
        df = records.with_conversation_fallback(df)
    return [(r.question, r.answer) for r in df.orderBy("row_id").collect()]


CHAT = [("user", ""), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("assistant", "")]


def test_source_filter(spark):
    rows = [row(i, source=s) for i, s in enumerate(["gsm8k", "My_GSM8K_v2", "other", None, ""])]
    df = spark.createDataFrame(rows, RAW)
    assert [r.row_id for r in filters.drop_sources(df).orderBy("row_id").collect()] == [2, 3, 4]
    assert filters.drop_sources(df.drop("source")).count() == 5


def test_extract_modes(spark):
    rows = [row(1, "p", "s", CHAT), row(2, None, "s", CHAT), row(3, "p", "", CHAT), row(4, None, None, None), row(5, "", "", [])]
    assert qa(spark, rows, "fill") == [("p", "s"), ("q1", "a2"), ("p", "a2"), ("", ""), ("", "")]
    assert qa(spark, rows) == [("p", "a2"), ("q1", "a2"), ("p", "a2"), ("", ""), ("", "")]
    with pytest.raises(ValueError):
        qa(spark, rows, "other")


def test_extract_random(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        turns = [(rnd.choice(["user", "assistant", "system"]), rnd.choice(["", "x", "y", None])) for _ in range(rnd.randrange(5))]
        rows.append(row(i, rnd.choice([None, "", "p"]), rnd.choice([None, "", "s"]), rnd.choice([None, turns, turns])))

    def expected(r, mode):
        question, answer = r[1] or "", r[2] or ""
        if mode == "prefer_messages" or not (question and answer):
            users = [m["content"] for m in r[3] or [] if m["role"] == "user" and m["content"]]
            replies = [m["content"] for m in r[3] or [] if m["role"] == "assistant" and m["content"]]
            question = question or (users or [""])[0]
            answer = replies[-1] if replies else answer
        return question, answer

    for mode in ("fill", "prefer_messages"):
        assert qa(spark, rows, mode) == [expected(r, mode) for r in rows]


def test_conversation_fallback(spark):
    talk = [("human", "h1", None), ("assistant", "a1", None), ("human", "h2", None), ("assistant", "", "truth")]
    rows = [
        row(1, "p", "s", None, talk),
        row(2, "p", "", None, talk),
        row(3, None, None, None, talk[:2]),
        row(4, None, None, None, [("assistant", "", None)]),
        row(5, None, "s", None, [("human", "h", None)]),
        row(6, None, "s", None, None),
        row(7, None, "s", None, [("human", None, None), ("assistant", None, "t")]),
    ]
    assert qa(spark, rows, fallback=True) == [
        ("p", "s"), ("h2", "truth"), ("h1", "a1"), ("", ""), ("h", "s"), ("", "s"), ("", "t"),
    ]


def test_turn_rows_agree_with_messages(spark):
    rows = [row(1, None, None, CHAT), row(2, None, None, [("system", "s")]), row(3, None, None, [("assistant", "only")])]
    turns = [(r[0], i, m["role"], m["content"]) for r in rows for i, m in enumerate(r[3])]
    df = spark.createDataFrame(turns, "rec bigint, turn int, role string, content string")
    got = records.qa_from_turns(df, "rec", "turn", "role", "content").orderBy("rec").collect()
    assert [(r.question, r.answer) for r in got] == qa(spark, rows)


def test_curate(spark):
    rows = [
        row(1, "p", "so \\boxed{1}", source="a"),
        row(2, "p", "none", source="a"),
        row(3, "", "\\boxed{2}", source="a"),
        row(4, "p", "\\boxed{ 3 }", source=None),
        row(5, "p", "\\boxed{}", source="b"),
    ]
    df = spark.createDataFrame(rows, RAW)
    got = records.curate(df).orderBy("row_id").collect()
    assert [(r.row_id, r.instruction, r.output, r.final_answer, r.source) for r in got] == [
        (1, "p", "so \\boxed{1}", "1", "a"),
        (4, "p", "\\boxed{ 3 }", "3", "None"),
    ]
    assert {r.source for r in records.curate(df.drop("source")).collect()} == {"unknown"}


def test_missing_columns(spark):
    df = spark.range(2).select(F.col("id").alias("row_id"))
    full = with_missing(df, RAW)
    assert set(full.columns) == set(RAW.fieldNames())
    assert full.schema["messages"].dataType == RAW["messages"].dataType
    assert with_missing(full, RAW) is full


def test_extraction_runs_once(spark):
    """The filter on the final answer must not repeat the extraction below the projection."""
    plan = records.curate(spark.createDataFrame([row()], RAW))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
