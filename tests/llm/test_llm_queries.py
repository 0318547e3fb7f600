import pytest

import corpus_pipeline
from checks.compare import connect, difference
from larkspool.llm import ngram_join, packing, toxicity
from larkspool.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_op9_equals_the_definition(spark):
    import hashlib

    from tests.llm.test_suffix_dedup import expected

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in expected([tuple(r) for r in docs.collect()], 200)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op9_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_op11_base_spans_equal_the_patterns(spark):
    import hashlib

    from tests.llm.test_pii_crf import PATTERNS, expected

    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op11_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = expected(texts[r["doc_id"]])
        listed = [f"{kind}:{start}:{end}" for kind, start, end in base]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) or not listed


def test_pipeline_stages(spark):
    """Each stage against a plain version on what its predecessor kept."""
    from tests.llm.test_decontamination import expected as hits
    from tests.llm.test_ngram_join import expected as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "packing":
            assert {d for r in out.collect() for d in r["doc_ids"]} == {i for i, _ in rows}
            break
        assert out.columns == docs.columns
        kept = [r["doc_id"] for r in out.collect()]
        if name == "toxicity":
            scores = toxicity.with_score(docs, toxicity.fit(docs, labels), "s", keep=["doc_id"]).collect()
            want = [r["doc_id"] for r in scores if r["s"] < toxicity.THRESHOLD]
        elif name == "near_duplicates":
            want = [i for i, (_, component) in groups(rows, 5, 80, 100).items() if i == component]
        elif name == "decontamination":
            want = [i for i, found in hits(rows, benchmark, 10).items() if not found[0][1]]
        else:
            kept, want = sorted(set(kept)), sorted(i for i, _ in rows)
        assert sorted(kept) == sorted(want), name
        docs = out.sparkSession.createDataFrame(out.collect(), out.schema)


def test_op7_and_op8_over_the_same_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(docs, packing.Tokenizer.read())
    assert {d for r in packed.collect() for d in r["doc_ids"]} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ngram_join.near_duplicates(docs).count() == docs.count()
