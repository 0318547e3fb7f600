"""Benchmark decontamination: find passages of test items in training texts and take them out.

Words are what remains of a text after lower-casing A-Z and cutting at every other
ASCII character that is no digit or letter. A window is n consecutive words of an
item; a shorter item is one window as a whole. Every occurrence of a window in a
document is a hit.

The windows travel as broadcast hash sets. A benchmark is read in blocks of at most
BLOCK_WORDS words, which bounds what is broadcast; a larger one takes one scan per
block. Words that are in no item get number 0, so a window is compared by word
numbers: a rolling hash finds candidates and the numbers themselves confirm them.

Null or empty texts have no words. Items without an id or words have no windows; the
rows of a repeated item id are one item. Rows of ``docs`` are judged one by one, so
repeated rows and null ids need no care, and other columns pass through unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import FOLD, FOLDED_WORD, extended, fresh, share, stage, utf8

#: Words of the benchmark per broadcast set.
BLOCK_WORDS = 400_000
_HITS = "struct<n_words:bigint,n_hit:bigint,words:array<int>,bytes:array<int>,items:array<string>>"
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("words", pa.list_(pa.int32())),
     ("bytes", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Windows:
    """The windows of one block: word numbers -> item ids, by length, with a bitmap of rolling hashes."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    items: dict[int, dict[bytes, list[str]]] = field(default_factory=lambda: defaultdict(dict))
    maps: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, item: str, text: bytes, n: int) -> int:
        words = text.translate(FOLD).split()
        ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.uint64)
        size = min(n, len(ids))
        for i in range(len(ids) - size + 1) if size else ():
            owners = self.items[size].setdefault(ids[i : i + size].tobytes(), [])
            if item not in owners:
                owners.append(item)
        return len(ids)

    def seal(self) -> Windows:
        self.items = dict(self.items)
        for size, windows in self.items.items():
            ids = np.frombuffer(b"".join(windows), np.uint64).reshape(-1, size)
            table = self.maps[size] = np.zeros(1 << 20, bool)
            table[_rolling(ids.ravel(), size)[::size] >> np.uint64(44)] = True
        return self

    def hits(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """The number of words, which words are hit, and the items hit."""
        words = text.translate(FOLD).split()
        hit, found = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint64, len(words))
        for size, windows in self.items.items():
            if size > len(ids):
                continue
            for i in np.flatnonzero(self.maps[size][_rolling(ids, size) >> np.uint64(44)]):
                owners = windows.get(ids[i : i + size].tobytes())
                if owners:
                    hit[i : i + size] = True
                    found.update(owners)
        return len(words), hit, found


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value = value * _BASE + ids[j : j + n]
    return (value ^ (value >> np.uint64(29))) * _BASE


def blocks(benchmark: DataFrame, n: int, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The benchmark in blocks of bounded size, read one by one."""
    block, size = Windows(), 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).dropna()
    for item, text in rows.toLocalIterator():
        size += block.add(item, text.encode(), n)
        if size >= block_words:
            yield block.seal()
            block, size = Windows(), 0
    yield block.seal()


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of hit words, alternating."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column of hits, and that column's name."""
    name = fresh("hits", docs.columns)
    schema = extended(docs.schema, f"`{name}` {_HITS}")
    for k, block in enumerate(blocks(benchmark, n)):
        if k:
            docs = stage(docs, "decontamination")
        windows = share(docs.sparkSession, block)

        def scan(batches: Iterator[pa.RecordBatch], k=k, windows=windows) -> Iterator[pa.RecordBatch]:
            block = windows()
            for batch in batches:
                before = batch.column(name).to_pylist() if k else repeat(None)
                out = []
                for raw, old in zip(utf8(batch.column(text)), before, strict=False):
                    total, hit, items = block.hits(raw or b"")
                    if old:
                        for a, b in zip(old["words"][::2], old["words"][1::2], strict=True):
                            hit[a:b] = True
                        items.update(old["items"])
                    spans = []
                    words = _runs(hit)
                    if len(words):
                        places = [m.span() for m in FOLDED_WORD.finditer(raw.translate(FOLD))]
                        spans = [x for a, b in words.reshape(-1, 2) for x in (places[a][0], places[b - 1][1])]
                    out.append(
                        {"n_words": total, "n_hit": int(hit.sum()), "words": words.tolist(), "bytes": spans,
                         "items": sorted(items)}
                    )
                columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != name]
                names = [f.name for f in batch.schema if f.name != name]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _ARROW)], [*names, name])

        docs = docs.mapInArrow(scan, schema)
    return docs, name


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted as strings), spans (byte offsets, in pairs)."""
    marked, hits = with_hits(docs.select("doc_id", "text"), benchmark, n)
    return marked.select(
        "doc_id",
        F.col(hits)["n_words"].alias("n_words"),
        F.col(hits)["n_hit"].alias("n_hit"),
        F.col(hits)["items"].alias("item_ids"),
        F.col(hits)["bytes"].alias("spans"),
    )


def _hit(name: str) -> Column:
    return F.col(name)["n_hit"] > 0


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window."""
    marked, hits = with_hits(docs, benchmark, n)
    return marked.where(~_hit(hits)).drop(hits)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with every run of hit words cut out of the text, from the first word's start to the last one's end."""
    marked, hits = with_hits(docs, benchmark, n)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for i, found in enumerate(batch.column(hits).to_pylist()):
                if found["bytes"]:
                    kept = [0, *found["bytes"], len(texts[i])]
                    texts[i] = b"".join(texts[i][a:b] for a, b in zip(kept[::2], kept[1::2], strict=True))
            names = [f.name for f in batch.schema if f.name != hits]
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return marked.mapInArrow(cut, schema)
