import numpy as np
import pytest

import corpus_pipeline
from larkspool.llm import mixing as M
from larkspool.llm import queries

TARGETS = {"sea": 0.5, "land": 0.3, "air": 0.2}
POOL = {"sea": "wave fish ship", "land": "tree stone road", "air": "wind cloud bird"}


@pytest.fixture(scope="module")
def corpus(spark, docs_of):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        domain = rng.choice(list(POOL), p=[0.2, 0.7, 0.1])
        rows.append((i, " ".join(rng.choice(POOL[domain].split() + ["the", "of"], rng.integers(3, 30)))))
        if i % 3 == 0:
            labels.append((i, str(domain)))
    rows += [(600, None), (601, ""), (None, "wave ship"), (1, rows[1][1]), (602, "stone road " * 1_000)]
    labels += [(None, "sea"), (5, None), (6, "elsewhere"), labels[0]]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, domain string"), rows


def test_totals_match_the_targets(corpus):
    docs, labels, rows = corpus
    out = M.mixed_rates(docs, labels, TARGETS).collect()
    assert len(out) == len(rows)
    p = np.array([r["posterior"] for r in out])
    used = np.array([r["n_tokens"] * r["rate"] for r in out])
    assert np.allclose(p.sum(axis=1), 1) and min(r["rate"] for r in out) >= 0
    assert np.allclose(p.T @ used / used.sum(), list(TARGETS.values()), atol=1e-3)
    assert abs(used.sum() / sum(r["n_tokens"] for r in out) - 1) < 1e-3
    assert all(np.floor(r["rate"]) <= r["copies"] <= np.ceil(r["rate"]) for r in out)
    assert sum(r["n_tokens"] for r in out) == sum(len((t or "").split()) for _, t in rows)


def test_posteriors_follow_the_labels(corpus):
    docs, labels, rows = corpus
    texts = dict(r for r in rows if r[0] is not None)
    right = total = 0
    for r in M.mixed_rates(docs, labels, TARGETS).where("doc_id < 600").collect():
        domain = max(POOL, key=lambda d: len(set(POOL[d].split()) & set(texts[r["doc_id"]].split())))
        right += list(TARGETS)[int(np.argmax(r["posterior"]))] == domain
        total += 1
    assert right > 0.97 * total


def test_with_least_rate_one_every_document_stays(corpus):
    docs, labels, rows = corpus
    out = M.mix_documents(docs, labels, TARGETS, least=1.0, most_budget=2.0)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == set(rows)


def test_impossible_targets_give_the_nearest(corpus):
    docs, labels, _ = corpus
    out = M.mixed_rates(docs.where("text like '%tree%' and text not like '%wave%'"), labels, {"sea": 1.0, "land": 0.0})
    assert all(0 <= r["rate"] < float("inf") for r in out.collect())


def test_empty_tables(spark, docs_of):
    nothing = spark.createDataFrame([], "doc_id long, domain string")
    assert M.mixed_rates(docs_of([]), nothing, TARGETS).count() == 0
    rows = M.mixed_rates(docs_of(["a b", None]), nothing, TARGETS).collect()
    assert all(np.allclose(r["posterior"], 1 / 3) for r in rows)


def test_no_python_in_the_plan(corpus, tmp_path_factory):
    docs, labels, _ = corpus
    plan = M.mix_documents(docs.sparkSession.read.schema(docs.schema).parquet(str(tmp_path_factory.mktemp("docs"))), labels, TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "Pandas", "Exchange"))


@pytest.mark.parametrize("low", [0.34, 0.5])
def test_pipeline_stage_reaches_its_targets_from_afar(spark, docs_of, tmp_path, low):
    """One low-quality source with a third of all rows or more; no document goes."""
    rng = np.random.default_rng(3)
    kinds = rng.random(900) < low
    pool = {True: "buy cheap click now", False: "theorem proof lemma field"}
    rows = [(i, " ".join(rng.choice(pool[bool(k)].split() + ["the", "of"], rng.integers(5, 40)))) for i, k in enumerate(kinds)]
    labels = [(i, int(not kinds[i]), 0) for i in range(0, 900, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = [(r["doc_id"], len(r["text"].split())) for r in corpus_pipeline.mixing_stage(spark, docs_of(rows), str(tmp_path)).collect()]
    assert {i for i, _ in out} == set(range(900))
    share = sum(n for i, n in out if kinds[i]) / sum(n for _, n in out)
    assert abs(share - corpus_pipeline.TARGETS["q0t0"]) < 0.015


def test_shares_off_the_targets_are_told(corpus):
    docs, labels, _ = corpus
    with pytest.warns(UserWarning, match="shares reached"):
        M.mix_documents(docs, labels, TARGETS, least=1.0, most_budget=1.2)
    with pytest.raises(ValueError, match="shares reached"):
        M.mix_documents(docs, labels, TARGETS, least=1.0, most_budget=1.2, within=0.01)
    with pytest.raises(ValueError, match="shares reached"):
        M.mix_documents(docs, labels, {"sea": 1.0, "land": 0.0}, least=1.0, most_budget=None, within=0.01)


def test_the_query_has_a_target_for_every_kind_of_label(spark):
    labels = queries.quality_domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert {r["domain"] for r in labels.select("domain").distinct().collect()} == set(queries.TARGETS)
