import numpy as np
import pytest

from larkspool.llm import vectors as V


def brute(rows, threshold):
    usable = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    root = {k: k for k, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(range(len(rows)), 0)
    for n, i in enumerate(usable):
        for j in usable[:n]:
            (a, x), (b, y) = rows[i], rows[j]
            if len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return sorted(((k, links[i], None if k is None else top(k)) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 24))
    rows = [(i, (centres[i % 60] + 0.15 * rng.standard_normal(24)).tolist()) for i in range(400)]
    hot = rng.standard_normal(24)
    rows += [(i, (hot + 0.05 * rng.standard_normal(24)).tolist()) for i in range(400, 600)]
    rows += [(i, rows[3][1]) for i in range(600, 640)]
    rows += [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [1.0, None] * 12), (704, []), (705, [float("inf")] * 24)]
    rows += [(706, [1.0, 2.0]), (707, [2.0, 4.1]), (None, rows[0][1]), (708, (np.array(rows[5][1]) * 3).tolist())]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, n string")
    return df.repartition(4), rows


def test_links_and_components(table, monkeypatch):
    monkeypatch.setattr(V, "MEMBERS", 50)
    monkeypatch.setattr(V, "PROBES", 120)
    monkeypatch.setattr(V, "PER_CENTROID", 30)
    df, rows = table
    got = V.near_duplicates(df, 0.95).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    want, got = brute(rows, 0.95), sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)
    assert len(got) == len(want)
    found, true = (sum(n for _, n, _ in x) for x in (got, want))
    assert 0.99 * true <= found <= true
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.97


def test_probing_all_clusters_finds_all_links(table, monkeypatch):
    monkeypatch.setattr(V, "PER_CENTROID", 30)
    df, rows = table
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_duplicates(df, 0.95, None).collect()), key=repr)
    assert got == brute(rows, 0.95)


def test_an_id_of_several_vectors(spark):
    """Rows link by their own vectors; a tree is named by the least id in it, so two trees may have one name."""
    east, north, up = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, east), (1, north), (2, [1.0, 0.01, 0.0]), (3, up), (5, north), (4, up), (4, up), (6, [0.0, 0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in V.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False),
                   (5, 1, 1, False), (6, 3, 3, False)]
    alone = spark.createDataFrame([(1, east), (1, north), (2, east)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_duplicates(alone).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(1)
    codes = V._fitted(np.eye(64)[:1], 1, 0.95)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 4000, 64)))
    y = 0.6 * x + 0.8 * y
    y /= np.linalg.norm(y, axis=1)[:, None]
    (dx, _, _), (dy, _, _) = codes.rotated(x, np.zeros(4000, int)), codes.rotated(y, np.zeros(4000, int))
    factor = np.abs(dx).sum(axis=1) / 8
    off = np.sum(np.sign(dx) * dy, axis=1) / 8 / factor - np.sum(dx * dy, axis=1)
    assert abs(off.mean()) < 0.01
    assert (np.abs(off) <= V.EPSILON * np.sqrt((1 - factor**2) / factor**2 / 63)).mean() > 0.999


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.near_duplicates(df).count() == 0
