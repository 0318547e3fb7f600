import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspool.operators import ordering
from larkspool.operators.staging import stage
from tests import models


def table(n, seed=9):
    rnd = random.Random(seed)
    labels = ["hot"] * 10 + [f"l{i:02}" for i in range(20)]
    return [(i, rnd.choice(labels)) for i in rnd.sample(range(10 * n), n)]


def frame(spark, rows, parts=5):
    return stage(spark.createDataFrame(rows, "row_id bigint, label string").repartition(parts), "rows")


def ordered(df):
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [r.row_id for r in rows]


@pytest.mark.parametrize("n", [1, 1000])
def test_order_equals_model(spark, strategy, n):
    rows = table(n)
    assert ordered(ordering.stratified_order(frame(spark, rows), "label", "row_id")) == models.stratified(rows)


def test_batches_are_stratified(spark):
    rows = table(1000)
    labels = dict(rows)
    order = ordered(ordering.stratified_order(frame(spark, rows), "label", "row_id"))
    # 1000 rows in 32 batches: 8 of 32 rows and 24 of 31, so cut by the model's slot sizes.
    dealt = {r: i for i, r in enumerate(sorted(labels, key=lambda r: (labels[r], models.draw(r, "order"), r)))}
    batches = {}
    for r in order:
        batches.setdefault(dealt[r] % 32, []).append(r)
    sizes = {len(b) for b in batches.values()}
    assert max(sizes) - min(sizes) <= 1
    for label in set(labels.values()):
        counts = [sum(labels[r] == label for r in b) for b in batches.values()]
        assert max(counts) - min(counts) <= 1


def test_empty_order(spark, strategy):
    df = frame(spark, [(1, "a")]).where("row_id > 3")
    assert ordered(ordering.stratified_order(df, "label", "row_id")) == []


def split_rows(spark, rows):
    order = stage(ordering.stratified_order(frame(spark, rows), "label", "row_id"), "order")
    return ordering.assign_split(order, len(rows))


def test_splits_are_disjoint_and_complete(spark):
    rows = table(777)
    split = split_rows(spark, rows).collect()
    assert sorted(r.row_id for r in split) == sorted(r for r, _ in rows)
    ends = {s: max(r.pos for r in split if r.split == s) + 1 for s in ("train", "eval", "test")}
    assert ends == {"train": int(777 * 0.90), "eval": int(777 * 0.95), "test": 777}


@pytest.mark.parametrize("cap", [10, 49])
def test_caps_equal_model(spark, strategy, cap):
    rows = table(1000)
    labels = dict(rows)
    order = models.stratified(rows)
    got = ordering.cap_splits(split_rows(spark, rows), "label", "row_id", cap).collect()
    parts = {"train": order[:900], "eval": order[900:950], "test": order[950:]}
    for split, members in parts.items():
        want = members if split == "train" else models.capped([(r, labels[r]) for r in members], cap)
        found = sorted((r.pos, r.row_id) for r in got if r.split == split)
        assert [r for _, r in found] == want
        assert [p for p, _ in found] == list(range(len(want)))


def test_cap_keeps_shares(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(8000)]
    split = split_rows(spark, rows)
    before = Counter(r.label for r in split.where("split = 'eval'").collect())
    got = ordering.cap_splits(split, "label", "row_id", 100).where("split = 'eval'").collect()
    assert sum(before.values()) == 400
    assert Counter(r.label for r in got) == {label: round(n / 400 * 100) for label, n in before.items()}


def test_batch_number(spark):
    df = spark.range(10).select(ordering.batch_number(F.col("id"), 4).alias("b"))
    assert [r.b for r in df.collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
