"""Periodic runs of words: scale tiles, boundary Z-functions and stitched fragments.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
identical), at least three periods and 24 words long, that no neighbouring word extends
with that period. Words are what ASCII white space separates; they compare exactly.

Periods are taken by octave. At the scale w of an octave (its least period, but 8 at
least) a document has an anchor at every multiple of w. Words q apart are equal all along
a run but its last q words, so that stretch holds a whole block of w words behind some
anchor. One comparison per word and octave of rolling block hashes finds the anchors
whose block comes again at a lag of the octave; only tiles with such anchors go on, so a
hash collision costs time and nothing else. A tile covers the anchors of a span of the
document and overlaps its neighbours by what its anchors may look at. Tiles are rows of
their own and are dealt out evenly, so one very long document is solved by many tasks.

Two Z-functions at an anchor give, for all lags of the octave at once, how far the words
agree to the right and to the left. A fragment is the stretch around the anchor where they
do, up to a neighbouring anchor that reports the rest. A block of q words that is a power of
a shorter one is no fragment: q isn't the smallest period then. Fragments are shuffled by
document and period, and overlapping or touching ones are stitched.

A null, empty or short text has no runs. Documents are told apart by id and text, so ids
may be null or repeated, and rows that repeat both are solved alike. An empty table gives
an empty one. Columns that the input already has under the names of the results are
replaced. Nothing is capped: memory of a task is a batch of texts, or one text with its
hashes, and the fragments of a document are fewer than its words times its octaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspool.llm.common import ensure_folder, extended, fresh, join_by_id, mix, stage, utf8

#: A run has this many words and periods at least; the anchors rely on both.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words between anchors at the smallest scale; periods below it share that scale.
LEAST_SCALE = 8
#: Words between the first and last anchor of a tile, and anchors at large scales.
TILE_WORDS, TILE_ANCHORS = 4_096, 16
#: Rows of tiles that a task sends at a time.
TILE_ROWS = 256

_TILES = pa.schema(
    [("doc", pa.string()), ("scale", pa.int64()), ("least", pa.int64()), ("start", pa.int64()),
     ("anchors", pa.binary()), ("words", pa.binary())]
)
_BASE = np.uint64(0xD1342543DE82EF97)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def split_words(text: bytes | None) -> list[bytes]:
    """What ASCII white space separates."""
    return (text or b"").split()


class _Powers:
    """Powers of the hash base and of its inverse, as many as the longest document needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size, _BASE)]))
            self.down = np.cumprod(np.concatenate([one, np.full(size, _BACK)]))
        return self.up[:n], self.down[:n]


def _scales(n: int) -> Iterator[tuple[int, int]]:
    """(anchor distance, least period) of each octave that a document of n words may have runs in."""
    yield LEAST_SCALE, 1
    period = LEAST_SCALE
    while LEAST_PERIODS * period <= n:
        yield period, period
        period *= 2


def _most(scale: int, least: int) -> int:
    """The first period beyond the octave."""
    return LEAST_SCALE if least == 1 else 2 * scale


def _anchors(blocks: np.ndarray, scale: int, least: int) -> np.ndarray:
    """Anchors whose block of words may come again at a lag of the octave, from the hashes of all blocks."""
    n = len(blocks)
    rows = -(-n // scale)
    if least == 1:
        hits = np.zeros(rows, bool)
        for lag in range(1, _most(scale, least)):
            again = blocks[lag::scale]
            hits[: len(again)] |= blocks[::scale][: len(again)] == again
        return np.flatnonzero(hits) * scale
    padded = np.zeros(rows * scale, np.uint64)
    padded[:n] = blocks
    grid = padded.reshape(rows, scale)
    return np.flatnonzero((grid[1:] == grid[:-1, :1]).any(axis=1)) * scale


def _tiles_of(words: list[bytes], powers: _Powers) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Scale, least period, first word, anchors and word numbers of the tiles of one document."""
    n = len(words)
    if n < LEAST_WORDS:
        return
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
    if len(numbers) == n:
        return
    up, down = powers.upto(n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up)])
    for scale, least in _scales(n):
        blocks = (prefix[scale:] - prefix[:-scale]) * down[: n - scale + 1]
        anchors = _anchors(blocks, scale, least)
        if not len(anchors):
            continue
        span = max(TILE_WORDS, TILE_ANCHORS * scale)
        for part in np.split(anchors, np.flatnonzero(np.diff(anchors // span)) + 1):
            start = max(0, int(part[0]) - scale)
            stop = min(n, int(part[-1]) + 2 * scale + _most(scale, least))
            yield scale, least, start, (part - start).astype(np.int32).tobytes(), ids[start:stop].tobytes()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, rows = _Powers(), []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            for tile in _tiles_of(split_words(data), powers):
                rows.append((doc, *tile))
                if len(rows) >= TILE_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TILES)], schema=_TILES)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TILES)], schema=_TILES)


def z_function(s: list[int], upto: int) -> list[int]:
    """For each of the first ``upto`` positions, how many items from there on agree with the beginning."""
    n = len(s)
    z = [0] * upto
    if upto:
        z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def solve_tile(words: list[int], anchors: list[int], scale: int, least: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches in which words a period apart agree, around the anchors of a tile."""
    most, open_, found = _most(scale, least), {}, []
    for c in anchors:
        ahead = words[c : c + 2 * scale + most]
        z = z_function(ahead, min(most, len(ahead)))
        lags = [q for q in range(least, len(z)) if z[q] >= scale]
        lags = [q for q in lags if not any(z[q // p] >= q - q // p for p in _prime_factors(q))]
        if not lags:
            continue
        stop = min(c + most, len(words))
        left = words[max(0, c - scale) : c][::-1]
        behind = [*left, -1, *words[max(0, c - scale) : stop][::-1]]
        back = z_function(behind, len(left) + 2 + stop - c - least)
        for q in lags:
            start, end = c - back[len(left) + 1 + stop - c - q], c + min(z[q], 2 * scale)
            if q in open_ and start <= open_[q][1]:
                open_[q][1] = max(open_[q][1], end)
                open_[q][0] = min(open_[q][0], start)
            else:
                if q in open_:
                    found.append((q, *open_[q]))
                open_[q] = [start, end]
    return found + [(q, *span) for q, span in open_.items()]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, periods, starts, ends = [], [], [], []
        for doc, scale, least, start, anchors, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pieces = solve_tile(np.frombuffer(words, np.int32).tolist(), np.frombuffer(anchors, np.int32).tolist(), scale, least)
            docs += [doc] * len(pieces)
            periods += [p[0] for p in pieces]
            starts += [start + p[1] for p in pieces]
            ends += [start + p[2] for p in pieces]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.string()), *(pa.array(x, pa.int64()) for x in (periods, starts, ends))],
            ["doc", "period", "start", "end"],
        )


def _stitched(fragments: DataFrame) -> DataFrame:
    """doc, period, start, end: overlapping and touching fragments of a document and period made one."""
    order = Window.partitionBy("doc", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(before >= F.col("start"), 0).otherwise(1)
    island = F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = fragments.withColumn("cut", cut).withColumn("island", island)
    return pieces.groupBy("doc", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _document(docs: DataFrame, doc_id: str, text: str) -> F.Column:
    """A digest that tells documents apart by id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text)))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (digest of id and text) and runs, by start and period, of the documents that have any."""
    ensure_folder(docs.sparkSession)
    texts = docs.select(_document(docs, doc_id, text).alias("doc"), F.col(text).cast("binary").alias("text"))
    tiles = stage(texts.mapInArrow(_tiles, "doc string, scale long, least long, start long, anchors binary, words binary"), "run-tiles")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tiles.repartition(parts, "doc", "scale", "start")
    spans = _stitched(dealt.mapInArrow(_solved, "doc string, period long, start long, end long"))
    length = F.col("end") - F.col("start") + F.col("period")
    runs = spans.select("doc", "start", length.alias("length"), "period").where(
        f"length >= {LEAST_WORDS} and length >= {LEAST_PERIODS} * period"
    )
    listed = F.sort_array(F.collect_list(F.struct("start", "length", "period")))
    return stage(runs.groupBy("doc").agg(listed.alias("runs")), "runs")


def _collapse(words: list[bytes], runs: list[dict]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for start, end in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
        kept += words[at:start] if start > at else []
        at = max(at, end)
    return b" ".join(kept + words[at:])


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``runs`` (start, length and period in words), ``n_words`` and ``collapsed``, the text with one period of each run.

    Words of ``collapsed`` are joined by one space, of documents without runs as well.
    """
    docs = docs.drop("runs", "n_words", "collapsed")
    doc = fresh("doc", docs.columns)
    keyed = docs.withColumn(doc, _document(docs, doc_id, text))
    found = join_by_id(keyed, find_runs(docs, doc_id, text).withColumnRenamed("doc", doc), doc, "left").drop(doc)
    found = found.withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts = [], []
            for data, runs in zip(utf8(batch.column(text)), batch.column("runs").to_pylist(), strict=True):
                words = split_words(data)
                sizes.append(len(words))
                texts.append(_collapse(words, runs).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], [*batch.schema.names, "n_words", "collapsed"]
            )

    return found.mapInArrow(collapsed, extended(found.schema, "n_words long, collapsed string"))


def strongest_run(runs: str = "runs") -> F.Column:
    """The run of the greatest exact length over period; of equal ones the first start, then the least period."""
    none = f"cast(null as struct<start:bigint,length:bigint,period:bigint>)"
    better = "acc is null or x.length * acc.period > acc.length * x.period"
    return F.expr(f"aggregate({runs}, {none}, (acc, x) -> if({better}, x, acc))")
