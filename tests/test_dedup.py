import random

from pyspark.sql import functions as F

from larkspool.functions.text import normalize_text
from larkspool.operators import dedup
from tests import models


def pairs(n, seed=0):
    rnd = random.Random(seed)
    words = ["A b", "ab", "a\tB ", "c", "C", " ", "", "d e", None]
    # One question and one answer hold a third of the rows each.
    rows = [
        (i, "hot" if rnd.random() < 0.33 else f"{rnd.choice(words)}{rnd.choice(['', '', rnd.randrange(99)])}",
         "HOT " if rnd.random() < 0.33 else rnd.choice(words[:-1]) + str(rnd.randrange(400)))
        for i in range(n)
    ]
    return rows + [(n, None, "x"), (n + 1, "x", None), (n + 2, " \n", "x"), (n + 3, "x", "\u00a0")]


def expected(rows):
    full = [r for r in rows if models.normalized(r[1]) and models.normalized(r[2])]
    once = models.first_by(full, lambda r: models.normalized(r[1]), lambda r: r[0])
    return [r[0] for r in models.first_by(once, lambda r: models.normalized(r[2]), lambda r: r[0])]


def run(df):
    kept = dedup.dedup_qa(df, F.col("q"), F.col("a"), "row_id")
    return sorted(r.row_id for r in kept.collect())


def test_sequential_keep_first(spark):
    rows = pairs(1500)
    want = expected(rows)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "row_id bigint, q string, a string")
    assert run(df.repartition(1)) == want
    assert run(df.repartition(64)) == want
    assert 10 < len(want) < len(rows) / 2


def test_idempotent(spark):
    df = spark.createDataFrame(pairs(300), "row_id bigint, q string, a string")
    once = dedup.dedup_qa(df, F.col("q"), F.col("a"), "row_id")
    assert run(once) == run(df)


def test_order_of_the_two_passes_matters(spark):
    # Row 2 repeats the answer of row 1, which is itself dropped for its question.
    rows = [(0, "q", "a0"), (1, "q", "a1"), (2, "r", "a1")]
    assert run(spark.createDataFrame(rows, "row_id bigint, q string, a string")) == [0, 2]


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.concat(F.lit("same"), F.col("id") % 3).alias("t"))
    keys = df.select("row_id", dedup.digest(normalize_text(F.col("t"))).alias("_key"))
    plan = dedup.first_rows(keys, "_key", "row_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    kept = dedup.dedup_first(df, normalize_text(F.col("t")), "row_id")
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()  # texts stay put
    assert sorted(r.row_id for r in kept.collect()) == [0, 1, 2]
