import base64
import random

import numpy as np
import pytest

from larkspool.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return P.Tokenizer.read()


TEXTS = ["Hello  world\n\n it's 42", None, "", "é ñ 漢字 " * 40, " lead and trail ", "a\tb \n c", *(f"short {i}" for i in range(30)), "long text " * 9_000]


def test_encoder_equals_the_plain_tokenizer(tokenizer):
    encoder = tokenizer.encoder()
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS[:-1]] + ["".join(rng.choices(" ab\n\t.,'s1É", k=60)) for _ in range(300)]
    for text in texts:
        ids = np.frombuffer(encoder.ids(text), tokenizer.dtype)
        assert ids.tolist() == [*encoder.bpe.encode_ordinary(text), tokenizer.end]


def test_every_document_is_there_once_and_whole(docs_of, tokenizer):
    rows = [*enumerate(TEXTS), (None, "nameless"), (7, "same id")]
    width, end = 64, tokenizer.end
    bpe = tokenizer.encoder().bpe
    pieces = {}
    for r in P.pack(docs_of(rows), tokenizer, row_tokens=width).collect():
        ids = np.frombuffer(r["ids"], tokenizer.dtype)
        ends = r["cu_seqlens"]
        assert len(ids) == width and ends[0] == 0 and ends[-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == end).all()
        resets = np.flatnonzero(np.unpackbits(np.frombuffer(r["resets"], np.uint8))[:width]).tolist()
        assert resets == ends[:-1]
        assert np.flatnonzero(P.position_ids(ends, width)[: r["n_tokens"]] == 0).tolist() == resets
        for doc, k, a, b in zip(r["doc_ids"], r["pieces"], ends, ends[1:], strict=False):
            pieces.setdefault(doc, []).append((k, ids[a:b].tolist()))
    texts = {}
    for doc, found in pieces.items():
        tokens = [t for _, p in sorted(found) for t in p]
        texts[doc] = bpe.decode([t for t in tokens if t != end])
        if doc != 7:
            assert tokens.count(end) == 1 and [k for k, _ in sorted(found)] == list(range(len(found)))
    assert set(texts) == {i for i, _ in rows}
    assert all(texts[i] == (t or "") for i, t in rows if i != 7)


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.randint(1, 40)
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(0, 80))], np.int64)
        rows, room = [], []
        for i in np.argsort(-lengths, kind="stable").tolist():
            fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            if fits:
                least = min(r for r, _ in fits)
                k = max(k for r, k in fits if r == least)
                room[k] -= lengths[i]
            else:
                room.append(size - lengths[i])
        got = P.best_fit_decreasing(lengths, size)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[r]) <= size for r in got)
        assert len(got) == len(room)


def test_rooms_find_the_least_that_is_enough():
    rooms = P.Rooms(20)
    for row, room in enumerate([3, 9, 20, 9]):
        rooms.add(room, row)
    assert rooms.take(4) == (3, 9)
    assert rooms.take(9) == (1, 9)
    assert rooms.take(9) == (2, 20)
    assert rooms.take(4) is None and rooms.take(1) == (0, 3) and rooms.take(1) is None


def test_buffers_are_bounded(docs_of, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "BUFFER_TOKENS", 50)
    packed = P.pack(docs_of([f"text number {i}" for i in range(60)]), tokenizer, row_tokens=32)
    assert sorted(d for r in packed.collect() for d in r["doc_ids"]) == list(range(60))


def test_empty_table_and_wide_ids(docs_of, tokenizer):
    assert P.pack(docs_of([]), tokenizer).count() == 0
    data = b"\n".join(base64.b64encode(i.to_bytes(3, "big")) + b" %d" % i for i in range(70_000))
    assert P.Tokenizer(data).dtype.itemsize == 4
