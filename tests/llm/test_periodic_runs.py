import random

import numpy as np
import pytest

from larkspool.llm import periodic_runs as R


def expected(words):
    """(start, length, period) of all runs, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def solved(words):
    """The same by tiles, in one process."""
    pieces = {}
    for scale, least, start, anchors, ids in R._tiles_of([str(w).encode() for w in words], R._Powers()):
        tile = np.frombuffer(ids, np.int32).tolist(), np.frombuffer(anchors, np.int32).tolist()
        for q, a, b in R.solve_tile(*tile, scale, least):
            pieces.setdefault(q, []).append((start + a, start + b))
    out = []
    for q, spans in pieces.items():
        joined = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out += [(a, b - a + q, q) for a, b in joined if b - a + q >= max(24, 3 * q)]
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(dice, count):
    """Words with runs of many periods, some next to or inside each other."""
    out = []
    for _ in range(count):
        words = []
        while len(words) < dice.choice([5, 60, 400, 900]):
            period = [dice.choice("abcdefgh"[: dice.randrange(1, 9)]) for _ in range(dice.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40, 70]))]
            words += (period * dice.randrange(1, 9))[: dice.randrange(1, 260)]
            words += [dice.choice("xyz") for _ in range(dice.randrange(4))]
        out.append(words)
    return out


@pytest.mark.parametrize("tile", [16, 4096])
def test_tiles_find_what_the_definition_says(monkeypatch, tile):
    monkeypatch.setattr(R, "TILE_WORDS", tile)
    monkeypatch.setattr(R, "TILE_ANCHORS", 2)
    for words in texts(random.Random(5), 150):
        assert solved(words) == expected(words)


def test_z_function():
    dice = random.Random(1)
    for _ in range(200):
        s = [dice.randrange(2) for _ in range(dice.randrange(1, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert R.z_function(s, len(s)) == want


def test_documents(spark, docs_of):
    dice = random.Random(9)
    rows = [(i, " ".join(words)) for i, words in enumerate(texts(dice, 25))]
    long = " ".join(["p", "q", "r"] * 9000 + [str(i) for i in range(30_000)] + ["s"] * 5000)
    rows += [(100, None), (101, ""), (102, " \t\n "), (None, "a " * 30), (3, "b " * 25), (3, "b " * 25), (103, long), (104, "É é " * 20)]
    df = docs_of(rows).withColumnsRenamed({"source": "runs", "lang": "doc"})
    out = R.collapse_runs(df)
    assert set(df.columns) <= set(out.columns)
    got = sorted(
        ((r["doc_id"], r["text"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=repr
    )
    want = []
    for i, text in rows:
        words = (text or "").split()
        runs = expected(words) if i != 103 else [(0, 27_000, 3), (57_000, 5000, 1)]
        want.append((i, text, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=repr)


def test_strongest_run_breaks_ties(spark):
    rows = [([(9, 30, 3), (2, 40, 4), (2, 30, 3), (0, 29, 3)],), ([],)]
    df = spark.createDataFrame(rows, f"runs {R.RUNS}").selectExpr("sort_array(runs) as runs")
    assert [r[0] and tuple(r[0]) for r in df.select(R.strongest_run()).collect()] == [(2, 30, 3), None]


def test_empty_table(spark, docs_of):
    assert R.collapse_runs(docs_of([(1, "a")]).limit(0)).collect() == []


def test_tiles_are_dealt_out_and_nothing_is_collected(spark, docs_of):
    plan = R._stitched(spark.createDataFrame([], "doc string, period long, start long, end long"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(doc") == 1 and "Python" not in text
