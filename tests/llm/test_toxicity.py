import random
import zlib

import pytest

from larkspool.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus(spark, docs_of):
    rng = random.Random(1)
    clean = [f"word{i}" for i in range(60)]
    bad = ["vile", "rotten", "hateful"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = rng.choices(clean, k=rng.randint(5, 40)) + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(1200, None), (1201, ""), (None, "vile rotten"), (3, rows[3][1]), (1202, "vile " * 20_000 + "rotten hateful")]
    labels += [(None, 1, 1), (5, None, None), (labels[0][0], 1, labels[0][2]), (5000, 0, 1)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_catches_toxic_and_leaves_clean_documents(corpus):
    docs, labels, rows = corpus
    scored = T.with_score(docs, T.fit(docs, labels), name="own_score", keep=["doc_id", "text"]).collect()
    assert len(scored) == len(rows)
    assert all(0 <= r["own_score"] <= 1 for r in scored)
    bad = {"vile", "rotten", "hateful"}
    wrong = [r for r in scored if (r["own_score"] >= T.THRESHOLD) != bool(bad & set((r["text"] or "").split()))]
    assert len(wrong) <= 0.01 * len(rows)


def test_same_model_for_any_layout(corpus):
    docs, labels, _ = corpus
    one, other = T.fit(docs, labels), T.fit(docs.repartition(7), labels.repartition(2))
    assert (one.keys == other.keys).all() and (one.weights == other.weights).all()


def test_rejected_documents_go(corpus):
    docs, labels, rows = corpus
    kept = T.drop_toxic(docs, T.fit(docs, labels))
    assert kept.columns == docs.columns
    assert 0.8 * len(rows) < kept.count() < 0.9 * len(rows)


def test_held_out_rows(spark):
    df = spark.range(200).select(T.held_out("id").alias("h"), "id")
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in df.collect())
    assert spark.range(1).select(T.held_out(T.F.lit(None)).alias("h")).first()["h"] is False


def test_held_out_labels_teach_nothing(corpus):
    docs, labels, _ = corpus
    flipped = labels.withColumn("toxic", T.F.when(T.held_out("doc_id"), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert (T.fit(docs, labels).weights == T.fit(docs, flipped).weights).all()


def test_without_labels_or_documents(spark, docs_of):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs_of(["a", None]), nothing)
    assert [r["own"] for r in T.with_score(docs_of(["a", None]), model, "own").collect()] == [0.0, 0.0]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert T.with_score(docs_of([]), T.fit(docs_of([]), labels), "own").count() == 0
