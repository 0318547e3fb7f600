import random

import pytest
from pyspark.sql import functions as F

from larkspool.operators import sampling, staging
from larkspool.operators.ranks import positions
from larkspool.operators.staging import stage
from tests import models


def table(n=900, seed=4):
    """Rows of which a third have one source and some have none."""
    rnd = random.Random(seed)
    sources = ["hot"] * 12 + [None] * 3 + [f"s{i}" for i in range(21)]
    return [(i, rnd.choice(sources)) for i in rnd.sample(range(10 * n), n)]


def frame(spark, rows, parts=7):
    return stage(spark.createDataFrame(rows, "row_id bigint, source string").repartition(parts), "rows")


def ids(df):
    found = [r.row_id for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_allocation(spark):
    rows = table()
    got = {r.source: r.quota for r in sampling.allocate(frame(spark, rows), 100).collect()}
    counts = {s: sum(x == s for _, x in rows) for s in {x for _, x in rows}}
    assert got == {s: int(n / len(rows) * 100) for s, n in counts.items() if s is not None}
    shares = sampling.source_distribution(frame(spark, rows)).collect()
    assert {r.source: (r["count"], r.share) for r in shares} == {
        s: (n, n / len(rows)) for s, n in counts.items() if s is not None
    }


@pytest.mark.parametrize("size", [0, 100, 899, 5000])
def test_proportional_sample(spark, strategy, size):
    rows = table()
    got = ids(sampling.proportional_sample(frame(spark, rows), size, "row_id"))
    assert got == models.proportional(rows, size)
    assert len(got) == min(size, len(rows))


def test_stratified_sample_and_layout(spark, strategy):
    rows = table()
    one = ids(sampling.stratified_sample(frame(spark, rows, 1), 300, "row_id"))
    many = ids(sampling.stratified_sample(frame(spark, rows[::-1], 40), 300, "row_id"))
    assert one == many
    counts = {s: sum(x == s for _, x in rows) for s in {x for _, x in rows}}
    by_source = {s: sum(r in one for r, x in rows if x == s) for s in counts}
    assert by_source == {s: 0 if s is None else int(n / len(rows) * 300) for s, n in counts.items()}


def test_mostly_null_sources(spark, strategy):
    rows = [(i, None if i % 5 else "a") for i in range(200)]
    assert ids(sampling.proportional_sample(frame(spark, rows), 150, "row_id")) == models.proportional(rows, 150)


@pytest.mark.parametrize("size", [0, 37, 2000])
def test_plain_sample(spark, strategy, size):
    rows = table()
    got = ids(sampling.plain_sample(frame(spark, rows).drop("source"), size, "row_id"))
    order = sorted((r for r, _ in rows), key=lambda r: (models.draw(r, "plain"), r))
    assert got == set(order[:size])


def test_sample_without_source_column(spark):
    rows = table()
    df = frame(spark, rows).drop("source")
    assert ids(sampling.proportional_sample(df, 50, "row_id")) == ids(sampling.plain_sample(df, 50, "row_id"))


def test_equal_keys_are_broken_by_row_id(spark, strategy):
    df = frame(spark, [(i, "a" if i % 3 else "b") for i in range(60)]).withColumn("k", F.lit("f" * 32))
    marked = sampling.mark_first(df, 7, "k", "row_id", ["source"])
    assert ids(marked.where("picked")) == {0, 3, 6, 9, 12, 15, 18, 1, 2, 4, 5, 7, 8, 10}
    assert marked.count() == 60


def test_shuffle(spark, strategy):
    rows = table()
    df = frame(spark, rows)
    order = sorted((r for r, _ in rows), key=lambda r: (models.draw(r, "shuffle"), r))
    assert [r.row_id for r in sampling.shuffled(df, "row_id").collect()] == order
    placed = {r.row_id: r.pos for r in sampling.shuffle_positions(df, "row_id").collect()}
    assert [placed[r] for r in order] == list(range(len(order)))


def test_positions_with_weights(spark, strategy):
    df = stage(spark.range(500).select("id", (F.col("id") % 7).alias("w"), F.md5(F.col("id").cast("string")).alias("k")), "w")
    rows = sorted(positions(df, ["k", "id"], "at", weight="w").collect(), key=lambda r: (r.k, r.id))
    total = 0
    for i, r in enumerate(rows):
        assert (r["at"], r["at_weight"]) == (i, total)
        total += r.w


@pytest.mark.parametrize("size", [None, 250, 901])
def test_head(spark, strategy, size):
    rows = table()
    want = sorted(r for r, _ in rows)[: size or None]
    assert ids(sampling.head(frame(spark, rows), size, "row_id")) == set(want)


@pytest.mark.parametrize("size", [1, 4_000, 19_999, 20_000, 20_001])
def test_head_sorts_only_a_bracket(spark, monkeypatch, size):
    rows = stage(spark.range(20_000).select((F.col("id") * F.col("id") - 5_000).alias("row_id"), "id"), "head")
    ranked = []
    whole = sampling.positions
    monkeypatch.setattr(sampling, "positions", lambda df, order: ranked.append(df.count()) or whole(df, order))
    got = sampling.head(rows, size, "row_id").agg(F.count("id"), F.max("id")).first()
    assert tuple(got) == (min(size, 20_000), min(size, 20_000) - 1)
    assert all(n <= 100 for n in ranked)


def test_head_widens_its_bracket(spark, monkeypatch):
    monkeypatch.setattr(sampling, "QUANTILES", 4)
    real = F.percentile_approx
    off = lambda c, grid, accuracy: real(c, [min(1.0, g + 0.3) for g in grid], accuracy)
    monkeypatch.setattr(sampling.F, "percentile_approx", off)
    assert ids(sampling.head(frame(spark, table()), 250, "row_id")) == set(sorted(r for r, _ in table())[:250])


def test_head_of_other_ids(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("row_id"))
    want = sorted(r["row_id"] for r in rows.collect())[:100]
    assert sorted(r["row_id"] for r in sampling.head(rows, 100, "row_id").collect()) == want


def test_only_heavy_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(staging, "ROWS_PER_SALT", 100)
    even = spark.range(1_000).select("id", (F.col("id") % 50).alias("k"))
    hot = even.withColumn("k", F.when(F.col("id") < 350, 7).when(F.col("id") < 500, None).otherwise(F.col("k")))
    small = stage(spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "small")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan(staging.lookup_join(even, small, ["k"], "id"))
    joined = staging.lookup_join(hot, small, ["k"], "id")
    assert "_salt" in plan(joined)
    salts = small.withColumn("s", staging._salts(hot, ["k"]))
    assert {r["k"]: r["s"] for r in salts.collect() if r["s"] > 1} == {7: 4}
    assert {(r["id"], r["v"]) for r in joined.collect()} == {(r["id"], None if r["k"] is None else 2 * r["k"]) for r in hot.collect()}


def test_empty_table(spark, strategy):
    df = frame(spark, [(1, "a")]).where("row_id > 5")
    assert ids(sampling.proportional_sample(df, 10, "row_id")) == set()
    assert ids(sampling.plain_sample(df, 10, "row_id")) == set()
    assert sampling.shuffle_positions(df, "row_id").count() == 0


def test_other_seed_other_sample(spark):
    df = frame(spark, table())
    assert ids(sampling.plain_sample(df, 100, "row_id", 1)) != ids(sampling.plain_sample(df, 100, "row_id", 2))
