"""What is broadcast passes through the driver: only tables known to have few rows, and never rows that an explode has made."""

from itertools import takewhile

import numpy as np
import pytest

from larkspool.llm import common, graph
from larkspool.llm import ngram_join as N
from larkspool.llm import vectors as V


def _depth(line):
    return len(line) - len(line.lstrip(" :+-"))


def broadcasts(df):
    """Of each broadcast in the plan, the lines below it."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [list(takewhile(lambda x: _depth(x) > _depth(line), plan[i + 1 :])) for i, line in enumerate(plan) if "BroadcastExchange" in line]


@pytest.fixture
def seen(monkeypatch):
    """(label, broadcasts) of each table that is staged."""
    out, real = [], common.stage

    def stage(df, label):
        out.append((label, broadcasts(df)))
        return real(df, label)

    for module in (common, graph, N, V):
        monkeypatch.setattr(module, "stage", stage)
    return out


def exploded(seen):
    return [(label, line) for label, found in seen for below in found for line in below if "Generate" in line]


@pytest.mark.parametrize("most", [None, -1])
def test_vectors(spark, seen, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(5)
    rows = [(10 * i, np.round(v, 3).tolist()) for i, v in enumerate(rng.standard_normal((40, 16)))]
    rows += [(10 * i + 1, (np.array(v) + 0.001).tolist()) for i, v in ((i // 10, v) for i, v in rows[:20])]
    rows += [(3, rows[0][1]), (None, rows[0][1]), (7, None)]
    out = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99)
    seen.append(("result", broadcasts(out)))
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()}
    want = {(10 * i + k, 1, 10 * i) for i in range(1, 20) for k in (0, 1)} | {(10 * i, 0, 10 * i) for i in range(20, 40)}
    assert got == want | {(0, 2, 0), (1, 2, 0), (3, 2, 0), (None, 0, None), (7, 0, 7)}
    assert not exploded(seen)
    if most is not None:  # but for the sizes of clusters
        assert not [label for label, found in seen if found and label != "vector-links"]


@pytest.mark.parametrize("most", [None, -1])
def test_components(spark, seen, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)]
    found = graph.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {tuple(r) for r in found} == {(i, 0) for i in range(31)} | {(i, 100) for i in range(100, 160)}
    assert not exploded(seen)
    assert most is None or not [label for label, found in seen if found]


def test_centroids_of_slices_are_those_of_the_whole(monkeypatch):
    sample = np.random.default_rng(2).standard_normal((500, 12))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    whole = V._fitted(sample, 20_000, 0.95).centroids
    monkeypatch.setattr(V, "SLICE", 7)
    np.testing.assert_allclose(V._fitted(sample, 20_000, 0.95).centroids, whole, atol=1e-12)


@pytest.mark.parametrize("most", [None, -1])
def test_ngram_join(docs_of, seen, monkeypatch, most):
    """Groups beyond SMALL_GROUP, so that blocks are compared as well."""
    monkeypatch.setattr(N, "SMALL_GROUP", 2)
    monkeypatch.setattr(N, "PIVOTS", 0)
    monkeypatch.setattr(N, "BLOCK", 3)
    if most is not None:
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        monkeypatch.setattr(common, "ID_BROADCAST_ROWS", most)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(8)]
    rows += [(100 + i, " ".join([*words[:30], *(f"x{i}y{j}" for j in range(30))])) for i in range(8)]
    rows += [(200 + i, "a b c d e f") for i in range(5)] + [(300, "g h i j"), (201, "g h i j"), (None, "a b c d e f"), (400, None)]
    out = N.near_duplicates(docs_of(rows), 3, 90, 100)
    seen.append(("result", broadcasts(out)))
    got = {(r["doc_id"], r["component_id"]) for r in out.collect()}
    want = {(i, 0) for i in range(8)} | {(100 + i, 100 + i) for i in range(8)} | {(200 + i, 200) for i in range(5)}
    assert got == want | {(300, 200), (None, None), (400, 400)}
    assert not exploded(seen)
    assert most is None or not [label for label, found in seen if found]
