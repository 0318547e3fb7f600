import random
import re

import pytest

from larkspool.llm import decontamination as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - n + 1)):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                owners = windows.get(tuple(w[a : a + size]))
                if owners:
                    hit.update(range(a, a + size))
                    found |= owners
        out.setdefault(i, []).append((len(w), len(hit), sorted(found)))
    return {k: sorted(v) for k, v in out.items()}


def marked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], list(r["item_ids"])))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture
def tables(spark, docs_of):
    rng = random.Random(5)
    pool = "the Of and é to in is it THAT x1 y2".split()
    texts = ["".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 7)))) for k in range(12)]
    items += [(3, "é THAT"), (None, "the of"), (20, None), (21, "-- --")]
    rows = [*enumerate(texts), (40, None), (41, ""), (None, items[0][1]), (5, texts[5]), (42, "word " * 30_000)]
    return docs_of(rows), rows, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("block_words", [400_000, 10])
def test_matches_the_definition(tables, monkeypatch, block_words):
    monkeypatch.setattr(D.blocks, "__defaults__", (block_words,))
    docs, rows, benchmark, items = tables
    assert marked(D.mark(docs, benchmark, n=4)) == expected(rows, items, 4)


def test_documents_and_spans_are_removed(tables):
    docs, rows, benchmark, items = tables
    want = expected(rows, items, 4)
    kept = D.drop_documents(docs, benchmark, n=4)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted((i for i, found in want.items() for f in found if not f[1]), key=repr)
    cut = D.remove_spans(docs, benchmark, n=4)
    assert cut.columns == docs.columns
    left = {}
    for r in cut.collect():
        left.setdefault(r["doc_id"], []).append(len(words(r["text"])))
    assert {k: sorted(v) for k, v in left.items()} == {k: sorted(n - hit for n, hit, _ in v) for k, v in want.items()}


def test_empty_tables(spark, docs_of):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.mark(docs_of(["a b"]), nothing).first()["n_hit"] == 0
    assert D.mark(docs_of([]), nothing).count() == 0
