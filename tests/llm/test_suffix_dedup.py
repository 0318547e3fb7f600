import random
from collections import Counter

import pytest

from larkspool.llm import suffix_dedup as S


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdé fgh", k=n))
    passage, other = text(150), text(90)
    rows = [text(rng.randint(0, 100)) + (passage[rng.randint(0, 60) :] if k % 3 else other) + text(rng.randint(0, 120)) for k in range(40)]
    rows += [rows[0], None, "", "x" * 500, "ab" * 300, text(64), passage[:64], passage[:63]]
    rows = [*enumerate(rows), (None, rows[1]), (5, rows[5]), (6, text(80) + passage)]
    return rows


@pytest.mark.parametrize("most_contexts", [256, 3, 1])
def test_matches_the_definition(docs_of, monkeypatch, rows, most_contexts):
    monkeypatch.setattr(S, "MOST_CONTEXTS", most_contexts)
    monkeypatch.setattr(S, "SHARD", 2_000)
    assert got(S.remove_repeats(docs_of(rows), length=64)) == expected(rows, 64)


def test_long_texts_in_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc", k=2_000)) for _ in range(3)]
    rows = [*enumerate(texts), (3, texts[0][100:900] + texts[1][500:1500]), (4, texts[2][::-1])]
    assert got(S.remove_repeats(docs_of(rows), length=80)) == expected(rows, 80)


def test_no_repeats_and_empty_table(docs_of):
    assert got(S.remove_repeats(docs_of(["a" * 64, "b" * 65]), length=64)) == expected([(0, "a" * 64), (1, "b" * 65)], 64)
    assert S.remove_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize(("length", "letters"), [(3, "ab"), (5, "abc"), (8, "ab"), (64, "ab")])
def test_transform_finds_all_repeated_suffixes(length, letters):
    rng = random.Random(length)
    for _ in range(60):
        base = "".join(rng.choices(letters, k=110))
        texts = [("".join(rng.choices(letters, k=rng.randint(0, 30))) + base[rng.randint(0, 20) : rng.randint(70, 110)]).encode() for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [p.tolist() for p in S.repeated_suffixes(texts, length)] == want
