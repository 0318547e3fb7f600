import random

import pytest
from pyspark.sql import functions as F

from larkspool.fixed_values import MATH_SYSTEM_PROMPT
from larkspool.functions import chat


def test_chat_text(spark):
    df = spark.createDataFrame([("q", "a"), (None, "a")], "q string, a string")
    made = [r[0] for r in df.select(chat.chat_text(F.col("q"), F.col("a"), "be brief")).collect()]
    assert made == [
        f"<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\n{q}<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
        for q in ("q", "")
    ]
    prompt = df.select(chat.chat_prompt(F.col("q"))).first()[0]
    assert prompt == (
        f"<|im_start|>system\n{MATH_SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    )
    own = chat.ChatTemplate("[", "]")
    assert df.select(chat.chat_prompt(F.col("q"), "s", own)).first()[0] == "[system\ns][user\nq][assistant\n"


def masked(tokens, template):
    for j in range(len(tokens) - len(template) + 1):
        if tokens[j : j + len(template)] == template:
            return [-100] * (j + len(template)) + tokens[j + len(template) :]
    return tokens


@pytest.mark.parametrize("template", [[3], [1, 2], [1, 1, 2], [12]])
def test_mask(spark, template):
    rnd = random.Random(8)
    rows = [([rnd.choice([1, 2, 3, 11, 12, 21]) for _ in range(rnd.randrange(12))],) for _ in range(800)]
    got = spark.createDataFrame(rows, "t array<int>").select(chat.mask_prompt(F.col("t"), template)).collect()
    assert [r[0] for r in got] == [masked(t, template) for (t,) in rows]


def test_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<int>")
    assert [r[0] for r in df.select(chat.truncate_tokens(F.col("t"), 2)).collect()] == [[1, 2], []]
    assert [r[0] for r in df.select(chat.truncate_tokens(F.col("t"))).collect()] == [[1, 2, 3], []]


def test_completion_text(spark):
    df = spark.createDataFrame([("x<|im_start|>assistant\ny<|im_start|>assistant\nz",), ("none",)], "t string")
    got = [r[0] for r in df.select(chat.completion_text(F.col("t"))).collect()]
    assert got == ["y<|im_start|>assistant\nz", "none"]
