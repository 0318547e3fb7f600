import random
import re

import pytest
from pyspark.sql import functions as F

from larkspool.functions import text
from larkspool.functions.binding import let
from larkspool.functions.numbers import left_justified, two_decimals
from tests import models


def values(spark, column, rows, schema="a string, b string"):
    df = spark.createDataFrame(list(rows), schema)
    return [r[0] for r in df.select(column.alias("v")).collect()]


def test_flat_boxes_need_no_fold(spark):
    cases = {
        "\\boxed{0} and \\boxed{ 7 }.": "7", "a\\b \\boxed \\boxed{1}\\": "1", "\\boxed{ }": "", "\\boxed{1}{}": "1",
        "\\boxed{1}\n\\boxed{\n2}\n": "2", "\\boxed{1}\\boxed{2": "1", "\\boxed{1": "",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    found = df.select("want", text.boxed_answer(F.col("text")).alias("got"))
    assert [r for r in found.collect() if r.got != r.want] == []
    # The pattern comes first, the fold is the other branch of its result.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("regexp_extract(text") < plan.index("aggregate(")


def test_boxed_golden(spark):
    cases = {
        "\\boxed{1}\\boxed{": "1",
        "\\boxed{ \\frac{1}{2} }": "\\frac{1}{2}",
        "\\boxed{3}\\boxed{}": "",
        "\\boxed{\\boxed{4}}": "\\boxed{4}",
        "\\boxed{1} \\boxed{2 \\boxed{3}": "1",
        "}} { \\boxed{5} }": "5",
        "\\\\boxed{6}": "6",
        "\\boxed {7}": "",
        "boxed{8}": "",
        "\\boxed{\u00a0 9\x1c}": "9",
        "": "",
        None: "",
    }
    got = values(spark, text.boxed_answer(F.col("a")), [(k, None) for k in cases])
    assert got == list(cases.values())


def test_boxed_random(spark):
    rnd = random.Random(7)
    parts = ["\\boxed{", "{", "}", "}", "\\", "a", " ", "\n", "é", "\\frac", "x y"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    got = values(spark, text.boxed_answer(F.col("a")), [(t, None) for t in texts])
    assert got == [models.boxed(t) for t in texts]
    assert sum(map(bool, got)) > 200


def test_boxed_in_a_long_text(spark):
    long = "\\boxed{" + "{word} " * 30_000
    assert values(spark, text.boxed_answer(F.col("a")), [(f"\\boxed{{1}} {long}", None), (long + "}", None)]) == [
        "1",
        ("{word} " * 30_000).strip(),
    ]


def test_normalize(spark):
    spaces = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    rows = [("A b\tC" + spaces + "É", None), (None, None), (spaces, None), ("ab\u200bc", None)]
    assert values(spark, text.normalize_text(F.col("a")), rows) == [models.normalized(a) for a, _ in rows]
    assert values(spark, text.has_text(F.col("a")), rows) == [bool(models.normalized(a)) for a, _ in rows]


def test_clean(spark):
    rows = [("$1,000. ..", None), (" X = 5 ", None), ("a.b.", None), ("...", None), (None, None)]
    assert values(spark, text.clean_answer(F.col("a")), rows) == ["1000", "x=5", "a.b", "", None]


@pytest.mark.parametrize(
    "left, right, same",
    [
        ("1/2", "0.5", True), ("2/4", "1/2", True), ("1/3", "0.333333", False), ("-1/2", "1/-2", True),
        ("5", "5.0", True), ("5.", "5", True), (".5", "0.50", True), ("+7", "7", True), ("-0", "0.0", True),
        ("007", "7", False), ("00", "0", True), ("1/0", "1/0", False), ("1/0", "2/0", False), ("0/5", "0", True),
        (" 3 / 4 ", "0.75", True), ("x", "x", False), ("1,000", "1000", False), (None, "1", False), ("", "", False),
        ("123456789012345678901234567890", "123456789012345678901234567890.00", True),
        ("123456789012345678901234567890", "123456789012345678901234567891", False),
        ("999999999999.999999", "999999999999999999/1000000", True), ("0.5000000", "1/2", True),
        ("1234567890123/1", "1234567890123", True), ("0.1234567/1", "0.1234567", True), ("1e3", "1000", True), ("-2.5E-1", "-1/4", True),
        ("1e3", "1001", False), ("1e999999999999999", "10e999999999999998", True), ("1e3/1e2", "10", True), ("e3", "e3", False),
        ("1" + "0" * 60 + "/3", "2" + "0" * 60 + "/6", True), ("1" + "0" * 60 + "/3", "2" + "0" * 60 + "1/6", False),
        ("0/5", "-0/7", True), ("1/7", "2/14", True), ("1 2", "12", False),
    ],
)
def test_numeric_golden(spark, left, right, same):
    assert values(spark, text.numeric_equal(F.col("a"), F.col("b")), [(left, right)]) == [same]


def test_numeric_random(spark):
    rnd = random.Random(3)

    def literal():
        n = rnd.choice(["0", "1", "2", "3", "12", "0.5", "1.50", ".25", "2.0", "4."])
        sign = rnd.choice(["", "", "-", "+"])
        bottom = rnd.choice(["", "", "/2", "/4", "/0.5", "/-1"])
        return sign + n + bottom

    rows = [(literal(), literal()) for _ in range(2000)]
    got = values(spark, text.numeric_equal(F.col("a"), F.col("b")), rows)
    assert got == [models.number(a) == models.number(b) for a, b in rows]
    assert 100 < sum(got) < 1900


def test_numeric_long(spark):
    rnd = random.Random(11)

    def literal(value):
        k = rnd.randrange(1, 10**rnd.randrange(1, 25))
        return rnd.choice([f"{value * k}/{k}", f"{value}", f"{value}.000", f"{value}00e-2", f"{value * k}e3/{k * 1000}"])

    values_ = [rnd.randrange(10**rnd.randrange(1, 40)) for _ in range(60)]
    pairs = [(literal(v), literal(v + rnd.choice([0, 0, 1]))) for v in values_ for _ in range(4)]
    got = values(spark, text.numeric_equal(F.col("a"), F.col("b")), pairs)
    assert got == [models.number(a) == models.number(b) for a, b in pairs]


def test_contains(spark):
    rnd = random.Random(5)
    alphabet = ["1", "2", "12", "a", "-", "\\E", "\\Q", "(", "½", "٣", "."]
    rows = [
        ("".join(rnd.choices(alphabet, k=rnd.randrange(6))), "".join(rnd.choices(alphabet, k=rnd.randrange(3))))
        for _ in range(3000)
    ] + [("19", "1"), ("x=1", "1"), ("0.5", "5"), ("-1", "1"), ("5", ""), ("x", "")]
    got = values(spark, text.contains_answer(F.col("a"), F.col("b")), rows)
    assert got == [bool(re.search(r"(?<!\d)" + re.escape(b) + r"(?!\d)", a)) for a, b in rows]
    assert values(spark, text.contains_answer(F.col("a"), F.col("b")), [(None, "1"), ("1", None)]) == [False, False]


def test_two_decimals(spark):
    rnd = random.Random(1)
    numbers = [i / 800 * 100 for i in range(801)] + [rnd.randrange(100_000) / 1000 for _ in range(5000)]
    numbers += [rnd.uniform(0, 100) for _ in range(2000)] + [0.125, 1.005, 2.675, 1.015, 1e-9, 99.995, 100.0]
    numbers += [-x for x in numbers if x]
    rows = [(x, f"{x:.2f}", f"{x:+.2f}") for x in numbers]
    df = spark.createDataFrame(rows, "x double, plain string, signed string")
    wrong = df.where(
        (two_decimals(F.col("x")) != F.col("plain")) | (two_decimals(F.col("x"), True) != F.col("signed"))
    )
    assert wrong.collect() == []


def test_left_justified(spark):
    assert values(spark, left_justified(F.col("a"), 4), [("ab", None), ("abcdef", None)]) == ["ab  ", "abcdef"]


def test_let(spark):
    assert values(spark, let(F.upper("a"), lambda v: F.concat(v, v)), [("x", None), (None, None)]) == ["XX", None]
