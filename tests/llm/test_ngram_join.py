import random
from collections import defaultdict

import numpy as np
import pytest

from larkspool.llm import graph
from larkspool.llm import ngram_join as N
from larkspool.llm.common import word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, size):
    out = {}
    for i, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)]
        out[i] = frozenset(grams) if w else frozenset()
    return out


def expected(rows, size, num, den):
    sets = sets_of([r for r in rows if r[0] is not None], size)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)]
    rows = []
    while len(rows) < n:
        base = rng.choices(pool, k=rng.choice([1, 2, 3, 5, 9, 14, 30, 60, 120]))
        for _ in range(rng.choice([1, 1, 2, 4, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            if rng.random() < 0.3:
                copy += rng.choices(pool, k=rng.randint(1, 4))
            rows.append((len(rows), rng.choice([" ", "\n", "\t\x0b "]).join(copy)))
    rows += [(n + 500, None), (n + 501, ""), (n + 502, "  \n"), (n + 503, rows[0][1].upper()), (n + 504, "again " * 40_000)]
    return rows


@pytest.mark.parametrize(("size", "num", "den", "by_deletion"), [(3, 90, 100, False), (5, 80, 100, False), (2, 80, 100, True), (3, 100, 100, False)])
def test_links_are_complete_and_exact(docs_of, monkeypatch, size, num, den, by_deletion):
    monkeypatch.setattr(N, "SMALL_GROUP", 2)
    monkeypatch.setattr(N, "PIVOTS", 0)
    monkeypatch.setattr(N, "BLOCK", 5)
    if by_deletion:
        planned = N._planned
        monkeypatch.setattr(N, "_planned", lambda *a: N.Plan(num, den, planned(*a).frequent, frozenset(range(20))))
    rows = near_copies(size, 220)
    want = expected(rows, size, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs_of(rows), size, num, den).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 10


def test_nulls_and_repeated_rows(docs_of):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None)]
    docs = docs_of(rows)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, 3, 90, 100).collect()), key=repr)
    assert got == sorted([(None, 4, None), (1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3)], key=repr)
    kept = N.drop_near_duplicates(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([None, 1, 1, 3], key=repr)


def test_repeated_rows_of_copies_come_once_each(docs_of):
    """Repeated ids that are not the smallest of their copies, and ids with several texts, each with copies of its own."""
    one, two, three = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(1, one), (5, one), (5, one), (5, one), (2, two), (7, two), (7, three), (4, three), (8, three), (9, "s t u v w x")]
    rows += [(20, "aa bb cc dd"), (21, "aa bb cc dd"), (21, "ee ff gg hh"), (22, "ee ff gg hh"), (20, "ii jj kk ll"), (23, "ii jj kk ll")]
    got = sorted((r["doc_id"], r["component_id"]) for r in N.near_duplicates(docs_of(rows), 3, 90, 100).collect())
    component = {1: 1, 5: 1, 2: 2, 7: 2, 4: 2, 8: 2, 9: 9, 20: 20, 21: 20, 22: 20, 23: 20}
    assert got == sorted((i, component[i]) for i, _ in rows)


def test_empty_table(docs_of):
    assert N.near_duplicates(docs_of([])).count() == 0
    assert N.drop_near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_pigeonhole(num):
    """Any two sets of sufficient similarity share an index entry that one of them owns, in either way of indexing."""
    rng = np.random.default_rng(num)
    marks = rng.random(1 << 20) < 0.5
    for _ in range(400):
        n = int(rng.integers(1, 130))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.1])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < num * (len(a) + len(b) - common):
            continue
        for bands in (frozenset(), frozenset(range(64))):
            plan = N.Plan(num, 100, marks, bands)
            found = []
            for x in (a, b):
                keys = [(set(k[:own].tolist()), set(k.tolist())) for k, own in plan.entries(x)]
                found.append((set().union(*(o for o, _ in keys)), set().union(*(k for _, k in keys))))
            (own_a, all_a), (own_b, all_b) = found
            assert own_a & all_b or own_b & all_a


def test_sketches_never_exceed_the_distance_of_the_sets():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
        a, b = pool[rng.random(len(pool)) < 0.6], pool[rng.random(len(pool)) < rng.choice([0.1, 0.6, 1.0])]
        assert np.bitwise_count(N.sketch(a) ^ N.sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_word_hashes_are_those_of_the_words():
    texts = [b"Ab  cD\n", None, b"", "é à\x0bX".encode(), b"x" * 300_000 + b" y", b"word " * 120_000, b"\x1ca b"]
    seen = defaultdict(set)
    for text, hashes in zip(texts, word_hashes(texts), strict=True):
        words = (text or b"").lower().split()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist(), strict=True):
            seen[w].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len({min(h) for h in seen.values()}) == len(seen)


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 5), (7, 7), (20, 21), (22, 21), (23, 22), *((100, i) for i in range(101, 140)), (150, 139), (151, 150)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in (3, 5, 9)} == {3} and {got[i] for i in range(20, 24)} == {20}
    assert {got[i] for i in [*range(100, 140), 150, 151]} == {100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
