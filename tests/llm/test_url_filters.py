from datetime import datetime, timedelta

import pytest

from larkspool.llm import url_filters as U

DAY = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
ENTRIES = [
    ("example.com", "block", 10), ("example.com", "remove", 50), ("example.com", "block", 90),
    ("www.example.com/ok", "allow", 20), ("www.example.com/ok/not", "block", 30), ("tie.org", "allow", 5),
    ("tie.org", "block", 5), (None, "block", 1), ("never.org", "odd", 1), ("never.org", "block", None),
]
CAPTURES = [
    (1, "http://www.example.com/a", 9, None), (2, "http://www.example.com/a", 10, "block"), (3, "http://example.com", 49, "block"),
    (4, "https://WWW.Example.COM:80/a?q=/ok", 50, None), (5, "http://user@www.example.com/ok/x", 25, "allow"),
    (6, "http://www.example.com/ok/not/y#z", 40, "block"), (7, "http://www.example.com/ok/not", 29, "allow"),
    (8, "http://notexample.com/", 20, None), (9, "http://a.tie.org./", 400, "block"), (10, None, 20, None), (11, "no url", 20, None),
    (12, "http://example.com/", None, None), (13, "http://never.org/", 20, None), (14, "http://x.example.com/" + "p/" * 300, 95, "block"),
    (None, "http://example.com/", 20, "block"), (2, "http://www.example.com/a", 10, "block"), (15, "http:///path", 20, None),
]


@pytest.fixture
def tables(spark):
    when = lambda n: None if n is None else DAY(n)
    entries = spark.createDataFrame([(p, a, when(n), "x") for p, a, n in ENTRIES], "pattern string, action string, effective timestamp, rank string")
    captures = spark.createDataFrame([(i, u, when(n), "x") for i, u, n, _ in CAPTURES], "page_id long, url string, fetch_time timestamp, pattern string")
    return captures, entries


@pytest.mark.parametrize("limit", [U.ID_BROADCAST_BYTES, -1])
def test_entries_active_at_fetch_time_decide(tables, monkeypatch, limit):
    monkeypatch.setattr(U, "ID_BROADCAST_BYTES", limit)
    got = {(r["page_id"], r["fetch_time"]): (r["action"], r["blocked"]) for r in U.evaluate(*tables).collect()}
    want = {(i, None if n is None else DAY(n)): (a, a == "block") for i, _, n, a in CAPTURES}
    assert got == want


def test_a_date_far_away_adds_one_period(tables, spark, monkeypatch):
    captures, entries = tables
    far = spark.createDataFrame([(16, "http://example.com/", datetime(9999, 12, 1))], "page_id long, url string, fetch_time timestamp")
    staged = []
    monkeypatch.setattr(U, "stage", lambda df, label, f=U.stage: staged.append(f(df, label)) or staged[-1])
    got = U.evaluate(captures.drop("pattern").unionByName(far), entries).where("page_id = 16").first()
    assert got["action"] == "block" and staged[0].count() < 60


def test_only_patterns_as_deep_as_the_list(spark):
    url = spark.createDataFrame([("http://a.b.c.d.org/1/2/3",)], "url string")
    made = url.select(U.patterns_of(url["url"], 3, 2).alias("p")).first()["p"]
    assert made == ["c.d.org", "d.org", "a.b.c.d.org/1", "a.b.c.d.org/1/2"]
    assert url.select(U.patterns_of(url["url"], 1, 0).alias("p")).first()["p"] == ["d.org"]


def test_empty_tables(tables):
    captures, entries = tables
    assert U.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in U.evaluate(captures, entries.limit(0)).collect())


def test_intervals(tables):
    rows = [(r["valid_from"], r["valid_to"]) for r in U.intervals(tables[1]).where("pattern = 'example.com'").orderBy("valid_from").collect()]
    assert rows == [(DAY(10), DAY(50)), (DAY(90), None)]
