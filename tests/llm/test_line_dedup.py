import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspool.llm import line_dedup
from larkspool.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, threshold):
    """Kept text and counts of each row, by the definition."""

    def keys(text):
        return [line.strip(WHITE).translate(LOWER) for line in (text or "").split("\n")]

    df = Counter(k for _, t in rows for k in set(keys(t)) if k)
    out = []
    for i, text in rows:
        kept = [x for x, k in zip((text or "").split("\n"), keys(text), strict=True) if not (k and df[k] >= threshold)]
        total = len((text or "").split("\n"))
        out.append((i, total, total - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["_n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


ROWS = [
    *((i, f"Header\nbody {i}\n  HEADER\t\n\nfooter É") for i in range(6)),
    (6, None), (7, ""), (8, "\n\n"), (9, "header"), (10, "\x0bheader\x0c\nfooter é"), (None, "header\nnameless"),
    (9, "header"), (9, "other text of the same id\nheader"), (11, "header" * 5000 + "\nHeader"),
]


def test_matches_the_definition(docs_of):
    assert got(dedup_lines(docs_of(ROWS), threshold=4)) == expected(ROWS, 4)


def test_empty_table(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_insert_and_delete_are_exact(docs_of):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(40)]
    old, new = (
        [(i, "\n".join(rng.choices(pool, k=4))) for i in ids] for ids in (range(40), range(40, 70))
    )
    index = LineIndex.build(docs_of(old), threshold=5)
    both = index.insert(docs_of(new))
    assert got(both.drop_lines(docs_of(old + new))) == expected(old + new, 5)
    back = both.delete(docs_of(new))
    assert got(back.drop_lines(docs_of(old))) == expected(old, 5)
    counts = {tuple(r) for r in index.counts.select("hi", "lo", "n").collect()}
    assert {tuple(r) for r in back.counts.select("hi", "lo", "n").collect()} == counts
    only_new = both.delete(docs_of(old))
    assert got(only_new.drop_lines(docs_of(new))) == expected(new, 5)


def test_deleting_what_was_never_inserted_is_an_error(docs_of):
    index = LineIndex.build(docs_of([(1, "a\nb"), (2, "a")]), threshold=2)
    with pytest.raises(ValueError, match="2 lines"):
        index.delete(docs_of([(3, "c\nb\na"), (1, "b")]))
    back = index.delete(docs_of([(1, "a\nb")])).insert(docs_of([(1, "a\nb")]))
    assert got(back.drop_lines(docs_of([(1, "a\nb"), (2, "a")]))) == expected([(1, "a\nb"), (2, "a")], 2)


def test_shards_grow_and_only_a_hot_one_has_many_salts(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 2)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 4)
    monkeypatch.setattr(line_dedup, "LEAST_SALTS", 1)
    monkeypatch.setattr(line_dedup, "PAIRS_PER_GROUP", 5)
    old = [(i, f"hot\nline {i % 3}") for i in range(30)]
    new = [(i, f"hot\nline {i}") for i in range(30, 70)]
    index = LineIndex.build(docs_of(old), threshold=4)
    both = index.insert(docs_of(new))
    assert (index.shards, both.shards) == (4, 32)
    assert got(both.drop_lines(docs_of(old + new))) == expected(old + new, 4)
    staged = []
    monkeypatch.setattr(line_dedup, "stage", lambda df, label, f=line_dedup.stage: staged.append(f(df, label)) or staged[-1])
    both.frequent_pairs(docs_of(old))
    salts = sorted(r["salts"] for r in staged[0].collect())
    assert salts[-1] >= 14 and sum(salts) < 14 + 3 * 32


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_cuckoo_filter_holds_what_was_inserted(n):
    hi, lo = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, (2, n), dtype=np.int64)
    held = CuckooFilter.sized(n)
    assert held.insert(hi, lo)
    held = CuckooFilter.loaded(held.dumped())
    assert held.has(hi, lo).all()
    held.delete(hi[: n // 2], lo[: n // 2])
    assert held.has(hi[n // 2 :], lo[n // 2 :]).all()
    held.delete(hi[n // 2 :], lo[n // 2 :])
    assert not held.table.any()


def test_full_filter_says_so():
    held = CuckooFilter(np.zeros((2, 4), np.uint16))
    hi, lo = np.random.default_rng(0).integers(0, 2**62, (2, 40), dtype=np.int64)
    assert not held.insert(hi, lo)


def test_digest_of_an_empty_document(docs_of):
    row = dedup_lines(docs_of([None])).first()
    assert hashlib.sha256(row["text"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
