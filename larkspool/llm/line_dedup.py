"""Reversible line dedup: exact reference counts per line, and sharded cuckoo filters in front of them.

A line's key is the line without white space at both ends, A-Z lower-cased; the empty key
is never dropped. A reference-count table holds, by a 128-bit digest of the key, the
number of documents that have it. Keys that reach the threshold are in the cuckoo filter
of their shard (16-bit fingerprints, buckets of four). Cuckoo filters forget entries, so
inserting and deleting documents both are exact updates: counts are summed, and keys that
cross the threshold enter or leave their filter. Deleting more than was inserted is an
error, as nothing that follows would be exact. When inserts outgrow the shards, these double and
all filters are built anew from the counts.

To look lines up, (document, key) pairs meet the filter of their shard, dealt by shard and
by a salt of the document. Each shard has as many salts as its own reference counts need, so a
line that a third of all documents have is spread, and only its filter is copied often. What
passes the filter is confirmed by a join with the counts. Texts move once, by document id.

Every row of a table of documents counts as a document. Null and empty texts are one empty
line. A null id is an id like any other; rows that share an id share the list of keys to
drop, which are frequent for every document, so each row still loses just what it should.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import extended, fresh, join_by_id, stage, utf8

#: Documents from which on a line is dropped.
THRESHOLD = 10
#: Keys per shard aimed at, and shards at least.
KEYS_PER_SHARD, LEAST_SHARDS = 250_000, 128
#: Pairs of document and key that meet one copy of a filter, aimed at, and copies at least.
PAIRS_PER_GROUP, LEAST_SALTS = 200_000, 16
SLOTS, KICKS = 4, 400
_WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of every line of a text, as a 16-byte digest; b'' for an empty key."""
    keys = (line.strip(_WHITE).lower() for line in (text or b"").split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if k else b"" for k in keys]


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def key_counts(docs: DataFrame) -> DataFrame:
    """hi, lo, n: in how many rows of ``docs`` a key occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            hi, lo = _halves(list(seen))
            n = pa.array(list(seen.values()), pa.int64())
            seen.clear()
            return pa.RecordBatch.from_arrays([hi, lo, n], ["hi", "lo", "n"])

        for batch in batches:
            for text in utf8(batch.column(0)):
                seen.update(k for k in set(line_keys(text)) if k)
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    counts = docs.select("text").mapInArrow(count, "hi long, lo long, n long")
    return counts.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


class CuckooFilter:
    """Fingerprints of keys in two possible buckets each; supports deletion."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, math.ceil(math.log2(max(1, keys) / (SLOTS * 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loaded(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumped(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (lo.astype(np.int64) & 0xFFFF).astype(np.uint16)
        print_ = np.where(print_ == 0, np.uint16(1), print_)  # 0 marks an empty slot
        first = (hi.astype(np.int64) >> 24) & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_.astype(np.int64) * 0x5BD1E995)) & self.mask

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(hi, lo)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if no room was found: the filter must then be built anew, larger."""
        rng = np.random.default_rng(0)
        for p, a, b in zip(*self._places(hi, lo), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = p
                    break
            else:
                for _ in range(KICKS):
                    slot = rng.integers(SLOTS)
                    p, self.table[bucket, slot] = self.table[bucket, slot], p
                    bucket = int(self._other(np.int64(bucket), np.uint16(p)))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for p, a, b in zip(*self._places(hi, lo), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def _long(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _built(shard: int, hi: np.ndarray, lo: np.ndarray) -> pa.Table:
    """The filter of a shard's keys, as large as it takes."""
    room = len(hi)
    while not (made := CuckooFilter.sized(room)).insert(hi, lo):
        room *= 2
    return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([made.dumped()], pa.binary())})


def _shards_for(keys: int, shards: int) -> int:
    while shards * KEYS_PER_SHARD < keys:
        shards *= 2
    return shards


@dataclass(frozen=True)
class LineIndex:
    """Reference counts (hi, lo, n) and filters (shard, data), both staged tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    threshold: int = THRESHOLD

    @staticmethod
    def build(docs: DataFrame, threshold: int = THRESHOLD) -> LineIndex:
        """The index of a first table of documents."""
        counts = stage(key_counts(docs), "line-counts")
        index = LineIndex(counts, counts, _shards_for(counts.count(), LEAST_SHARDS), threshold)
        return replace(index, filters=stage(index._filters(index._frequent()), "line-filters"))

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod("hi", F.lit(self.shards)).cast("int"))

    def _frequent(self) -> DataFrame:
        return self._shard(self.counts.where(F.col("n") >= self.threshold))

    def _filters(self, keys: DataFrame) -> DataFrame:
        """Filters of whole shards. A shard's number of keys is bounded by the choice of shards."""

        def build(group: tuple, rows: pa.Table) -> pa.Table:
            return _built(group[0].as_py(), _long(rows, "hi"), _long(rows, "lo"))

        return keys.select("shard", "hi", "lo").groupBy("shard").applyInArrow(build, "shard int, data binary")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._updated(key_counts(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents out again; ``docs`` has their texts as they were inserted."""
        return self._updated(key_counts(docs), -1)

    def _updated(self, delta: DataFrame, sign: int) -> LineIndex:
        old = self.counts.select("hi", "lo", F.col("n").alias("old"), F.lit(0).cast("bigint").alias("change"))
        new = delta.select("hi", "lo", F.lit(0).cast("bigint").alias("old"), (F.col("n") * sign).alias("change"))
        both = old.unionByName(new).groupBy("hi", "lo").agg(F.sum("old").alias("old"), F.sum("change").alias("change"))
        both = stage(both.withColumn("n", F.expr("old + change")), "line-counts")
        missing = both.where("n < 0").count() if sign < 0 else 0
        if missing:
            raise ValueError(f"{missing} lines would be deleted from more documents than they were inserted with")
        crossed = (F.col("old") >= self.threshold) != (F.col("n") >= self.threshold)
        moved = self._shard(both.where(crossed)).withColumn("enters", F.col("n") >= self.threshold)

        def update(group: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
            hi, lo, enters = _long(rows, "hi"), _long(rows, "lo"), rows.column("enters").to_numpy()
            if held.num_rows == 0:
                return _built(group[0].as_py(), hi[enters], lo[enters])
            filter_ = CuckooFilter.loaded(held.column("data")[0].as_py())
            if rows.num_rows == 0:
                return held.select(["shard", "data"])
            filter_.delete(hi[~enters], lo[~enters])
            data = filter_.dumped() if filter_.insert(hi[enters], lo[enters]) else None
            return pa.table(
                {"shard": pa.array([group[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())}
            )

        index = replace(self, counts=both.where("n > 0").select("hi", "lo", "n"))
        shards = _shards_for(index.counts.count(), self.shards)
        if shards > self.shards:
            index = replace(index, shards=shards)
            return replace(index, filters=stage(index._filters(index._frequent()), "line-filters"))
        filters = (
            moved.select("shard", "hi", "lo", "enters")
            .groupBy("shard")
            .cogroup(self.filters.groupBy("shard"))
            .applyInArrow(update, "shard int, data binary")
        )
        filters = stage(filters, "line-filters")
        full = filters.where("data is null").select("shard")  # no room left: built from the counts
        if not full.isEmpty():
            anew = index._filters(index._frequent().join(full, "shard", "left_semi"))
            filters = stage(filters.where("data is not null").unionByName(anew), "line-filters")
        return replace(index, filters=filters)

    def frequent_pairs(self, docs: DataFrame) -> DataFrame:
        """doc_id, hi, lo: the keys of each document that reach the threshold."""
        needed = F.greatest(F.lit(LEAST_SALTS), F.ceil(F.sum("n") / PAIRS_PER_GROUP)).cast("int")
        salts = stage(self._shard(self.counts).groupBy("shard").agg(needed.alias("salts")), "line-salts")
        salts = F.broadcast(salts)  # one row per shard: 1 row for 250,000 keys
        salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(LEAST_SALTS))).cast("int")
        id_type = docs.schema["doc_id"].dataType.simpleString()

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [[k for k in set(line_keys(text)) if k] for text in utf8(batch.column(1))]
                rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                hi, lo = _halves([k for own in keys for k in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), hi, lo], ["doc_id", "hi", "lo"])

        lines = docs.select("doc_id", "text").mapInArrow(pairs, f"doc_id {id_type}, hi long, lo long")
        lines = self._shard(lines).join(salts, "shard", "left").withColumn("salt", salt).drop("salts")
        copies = self.filters.join(salts, "shard").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")

        def passing(rows: pa.Table, held: pa.Table) -> pa.Table:
            rows = rows.select(["doc_id", "hi", "lo"])
            if held.num_rows == 0:
                return rows.slice(0, 0)
            filter_ = CuckooFilter.loaded(held.column("data")[0].as_py())
            return rows.filter(pa.array(filter_.has(_long(rows, "hi"), _long(rows, "lo"))))

        maybe = (
            lines.groupBy("shard", "salt")
            .cogroup(copies.groupBy("shard", "salt"))
            .applyInArrow(passing, f"doc_id {id_type}, hi long, lo long")
        )
        return maybe.join(self._frequent().select("hi", "lo"), ["hi", "lo"], "left_semi").select("doc_id", "hi", "lo")

    def drop_lines(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` reduced to the lines that stay, and the columns n_lines and n_dropped.

        These two get underscores in front if ``docs`` has columns of these names.
        """
        n_lines, n_dropped = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
        found = self.frequent_pairs(docs).groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))
        columns, gone = docs.columns, fresh("keys", docs.columns)
        joined = join_by_id(docs, stage(found.withColumnRenamed("keys", gone), "line-drops"), "doc_id", "left")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lines, dropped = utf8(batch.column("text")), [], []
                for i, keys in enumerate(batch.column(gone).to_pylist()):
                    own = (texts[i] or b"").split(b"\n")
                    drop = {np.array([k["hi"], k["lo"]], ">i8").tobytes() for k in keys or ()}
                    kept = [x for x, k in zip(own, line_keys(texts[i]), strict=True) if k not in drop] if drop else own
                    texts[i] = b"\n".join(kept)
                    lines.append(len(own))
                    dropped.append(len(own) - len(kept))
                out = {c: batch.column(c) for c in columns}
                out["text"] = pa.array(texts, pa.large_binary()).cast(pa.large_string())
                out |= {n_lines: pa.array(lines, pa.int64()), n_dropped: pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

        return joined.mapInArrow(cut, extended(docs.schema, f"`{n_lines}` long, `{n_dropped}` long"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the lines found in at least ``threshold`` of them; see ``LineIndex.drop_lines``."""
    return LineIndex.build(docs, threshold).drop_lines(docs)
