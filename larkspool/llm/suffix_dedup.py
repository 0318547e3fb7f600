"""Remove every byte covered by a string of LENGTH bytes that starts anywhere else too.

Which strings meet. A window is LENGTH bytes of a text. Its anchor is the leftmost smallest
hash among its GRAM-byte substrings, so equal windows have equal anchors at the same place.
Consecutive windows with the same anchor form a context: the bytes from the first one's
start to the last one's end. Windows can only be equal to windows of contexts with the
same anchor hash. Every window is in just one context.

What is compared. Anchors that occur once are dropped after a count. Equal contexts (by
128-bit digest) are one with a weight, and repeat as a whole. Where an anchor has several
different contexts, one copy of each is fetched, and tasks take whole anchor groups, about
SHARD bytes at a time: they sort the suffixes of the concatenated contexts, and derive the
common prefixes of neighbours from the Burrows-Wheeler transform alone. Breadth-first
backward extension visits the intervals of strings by increasing length l; an interval
whose right border has no value yet gives it the value l and is extended further, others
are done. It stops at LENGTH: borders without a value have common prefixes of LENGTH or
more, and the windows on both sides are repeated.

An anchor with more than MOST_CONTEXTS different contexts (the edge of a passage that
very many documents quote differently) would be a large group for one task. Its windows are
taken in blocks of BLOCK, by their place relative to the anchor, and counted by 128-bit
digests with a partial sum in every task: blocks that are equal as a whole repeat; blocks whose
core, the bytes that all their windows share, occurs once do not; the windows of the others
are counted one by one.

Texts are joined by a shuffle at every size of the input.

Texts are read as UTF-8, null as empty, and matches never cross documents. Rows are told
apart by id and text, so ids may be null or repeat; rows that repeat both are documents
that repeat each other. Long runs of one pattern have equal contexts within their document,
which are settled there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import extended, fresh, mix, signed, stage, utf8

#: Bytes of a repeated string, and of the substrings whose hashes make anchors.
LENGTH, GRAM = 200, 32
#: Bytes of text that are hashed at a time, and bytes of contexts that are sorted at a time.
CHUNK, SHARD = 1 << 20, 900_000
#: Different contexts of an anchor that are compared in one task.
MOST_CONTEXTS = 256
#: Windows of a block, where there are more.
BLOCK = 8
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SCAN = "doc_id {id}, row long, sure array<int>, anchor long, hi long, lo long, start int, windows int, weight int"


def contexts(text: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """anchor hash, first window, number of windows, place of the anchor of every context of a text."""
    grams = length - GRAM + 1  # of one window
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        part = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)
        value, span = _TABLE[part], 1
        for factor in _FACTORS:
            value = value[:-span] * factor + value[span:]
            span *= 2
        value = mix(value)
        least = (value >> np.uint64(24) << np.uint64(24)) | np.arange(len(value), dtype=np.uint64)
        span = 1
        while 2 * span <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(first, append=len(place))
        anchors = place[first]
        columns = (signed(value[anchors]), first + at, count, anchors + at)
        yield from zip(*(c.tolist() for c in columns), strict=True)


def _scan(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, sure, anchor, digest, start, windows, weight = [], [], [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(2))):
                own: dict[bytes, list] = {}
                text = text or b""
                for a, first, count, _ in contexts(text, length):
                    own.setdefault(xxhash.xxh3_128_digest(text[first : first + count + length - 1]), []).append((a, first, count))
                for key, found in own.items():
                    of.append(i)
                    digest.append(key)
                    anchor.append(found[0][0])
                    start.append(found[0][1])
                    windows.append(found[0][2])
                    weight.append(min(2, len(found)))
                    # Equal contexts within a text repeat; their bytes, as starts and ends.
                    spans = [x for _, f, c in found for x in (f, f + c + length - 1)] if len(found) > 1 else None
                    sure.append(spans)
            both = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sure, pa.list_(pa.int32())),
                 pa.array(anchor, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(start, pa.int32()),
                 pa.array(windows, pa.int32()), pa.array(weight, pa.int32())],
                ["doc_id", "row", "sure", "anchor", "hi", "lo", "start", "windows", "weight"],
            )

    return scan


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Places in the order of their keys, equal keys in the order of their places: key and place sorted as one number."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


#: Symbols that the first sort of suffixes looks at.
FIRST = 5


def _sorted_suffixes(symbol: np.ndarray, n_texts: int, length: int) -> np.ndarray:
    """Suffixes in the order of their first symbols, ``length`` at least; symbols below ``n_texts`` are unique ends.

    A suffix has as its rank the place of the first one that looks the same so far. Each
    round doubles the symbols looked at, and sorts only suffixes that still share a rank.
    """
    n = len(symbol)
    # An end within the first symbols tells a suffix from all others; what follows it doesn't count.
    padded = np.concatenate([np.maximum(symbol - n_texts + 1, 0), np.zeros(FIRST, np.int64)])
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(FIRST):
        part = padded[k : n + k]
        open_ &= part > 0
        key = key * 257 + np.where(open_, part, 0)
    order = _ordered(key)
    fresh = np.append(True, (np.diff(key[order]) != 0) | ~open_[order[1:]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    span = FIRST
    while span < length:
        shared = ~(fresh & np.append(fresh[1:], True))
        tied = order[shared]
        if not len(tied):
            break
        tied = np.sort(tied)
        after = np.zeros(len(tied), np.int64)
        inside = tied + span < n
        after[inside] = rank[tied[inside] + span] + 1
        old = rank[tied]
        bits = n.bit_length()
        if 3 * bits <= 63:
            both = np.sort((old << (2 * bits)) | (after << bits) | np.arange(len(tied)))
            place = both & ((1 << bits) - 1)
            both >>= bits
        else:
            both = old * (n + 1) + after
            place = np.argsort(both, kind="stable")
            both = both[place]
        moved, old = tied[place], old[place]
        begins = np.append(True, np.diff(both) != 0)
        at = np.arange(len(tied))
        first_of_old = np.maximum.accumulate(np.where(np.append(True, np.diff(old) != 0), at, 0))
        head = old + np.maximum.accumulate(np.where(begins, at, 0)) - first_of_old
        rank[moved] = head
        row = old + at - first_of_old
        order[row] = moved
        fresh[row] = begins
        span *= 2
    return order


def repeated_suffixes(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For every text, the places where a string of ``length`` bytes starts that starts elsewhere in them too."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1  # of each text: a symbol of its own, smaller than all bytes
    symbol = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
    symbol[ends] = np.arange(len(texts))
    n = len(symbol)
    suffix = _sorted_suffixes(symbol, len(texts), length)

    transform = symbol[suffix - 1]  # the symbol in front of each suffix
    to = np.empty(n, np.int64)  # row of the suffix that starts one symbol earlier
    to[_ordered(transform)] = np.arange(n)
    common = np.full(n + 1, -1, np.int16)  # at i: common prefix of suffixes i - 1 and i
    common[0] = common[n] = 0
    heads = np.flatnonzero(np.diff(symbol[suffix], prepend=-1))
    is_head = np.zeros(n, bool)
    is_head[heads] = True
    low, high = heads, np.append(heads[1:], n)  # intervals [low, high) of single symbols
    for value in range(length):
        new = common[high] < 0
        common[high[new]] = value
        low, high = low[new], high[new]
        if not len(low):
            break
        size = high - low
        one = size == 1
        lows, highs = [to[low[one]]], [to[low[one]] + 1]
        if not one.all():
            low, size = low[~one], size[~one]
            owner = np.repeat(np.arange(len(low)), size)
            row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]
            # Rows of one interval and symbol go to consecutive rows: each such run is an extended interval.
            both = np.sort((to[row] << 32) | owner)
            where, owner = both >> 32, both & 0xFFFFFFFF
            begins_run = (np.diff(where, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0) | is_head[where]
            split = np.flatnonzero(begins_run)
            lows.append(where[split])
            highs.append(where[np.append(split[1:], len(where)) - 1] + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
    long_ = common < 0
    here = np.sort(suffix[long_[:n] | long_[1:]])
    begins = ends - sizes
    return [here[slice(*np.searchsorted(here, (b, e)))] - b for b, e in zip(begins, ends, strict=True)]


def _runs(places: np.ndarray) -> list[int]:
    """Sorted places as runs: first, behind last, alternating."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return np.stack([places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + 1], 1).ravel().tolist()


_FOUND = "anchor long, hi long, lo long, runs array<int>"


def _by_transform(length: int):
    """Repeated windows of whole anchor groups, rows sorted by anchor."""

    def settle(rows: list) -> pa.RecordBatch:
        places = repeated_suffixes([r[3] for r in rows], length)
        found = [(*r[:3], _runs(p)) for r, p in zip(rows, places, strict=True) if len(p)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "hi", "lo", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hi", "lo", "bytes")), strict=True):
                if size >= SHARD and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield settle(rows)

    return run


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _blocks(length: int):
    """Every context in blocks: their first window, number of windows, digests of the core and of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cores, wholes = [], [], []
            for key in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hi", "lo", "bytes")), strict=True):
                text = key[3]
                _, _, n, at = next(contexts(text, length))
                first = 0
                while first < n:
                    start = (first - at) // BLOCK * BLOCK + at  # of the whole block, relative to the anchor
                    behind = min(n, start + BLOCK)
                    rows.append((*key[:3], first, behind - first))
                    cores.append(xxhash.xxh3_128_digest(text[start + BLOCK - 1 : start + length]))
                    wholes.append(xxhash.xxh3_128_digest(text[first : behind + length - 1], first - start))
                    first = behind
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *_halves(cores), *_halves(wholes)],
                ["anchor", "hi", "lo", "first", "windows", "c_hi", "c_lo", "f_hi", "f_lo"],
            )

    return run


def _block_windows(length: int):
    """Digests of the windows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            names = ("f_hi", "f_lo", "n", "first", "windows", "bytes")
            for f_hi, f_lo, n, first, windows, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for i in range(windows):
                    rows.append((f_hi, f_lo, n, i))
                    digests.append(xxhash.xxh3_128_digest(text[first + i : first + i + length]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *_halves(digests)],
                ["f_hi", "f_lo", "n", "place", "w_hi", "w_lo"],
            )

    return run


def _by_blocks(fetched: DataFrame, length: int) -> DataFrame:
    """anchor, hi, lo, runs of repeated windows of contexts (anchor, hi, lo, bytes), groups of any size."""
    core, whole, window = ["c_hi", "c_lo"], ["f_hi", "f_lo"], ["w_hi", "w_lo"]
    blocks = fetched.mapInArrow(
        _blocks(length),
        "anchor long, hi long, lo long, first int, windows int, c_hi long, c_lo long, f_hi long, f_lo long",
    )
    blocks = stage(blocks, "suffix-blocks")
    kinds = blocks.groupBy(*core, *whole).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("anchor", "hi", "lo", "first", "windows")).alias("copy")
    )
    kinds = stage(kinds, "suffix-block-kinds")
    several = kinds.groupBy(*core).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(*core)
    unsure = kinds.join(stage(several, "suffix-cores").hint("merge"), core).select(*whole, "n", "copy.*")
    unsure = unsure.join(fetched.select("anchor", "hi", "lo", "bytes").hint("merge"), ["anchor", "hi", "lo"])
    windows = unsure.mapInArrow(
        _block_windows(length), "f_hi long, f_lo long, n long, place int, w_hi long, w_lo long"
    )
    windows = stage(windows, "suffix-windows")
    twice = windows.groupBy(*window).agg(F.sum("n").alias("times")).where("times > 1").select(*window)
    some = windows.join(stage(twice, "suffix-twice").hint("merge"), window).groupBy(*whole).agg(
        F.collect_set("place").alias("places")
    )
    all_places = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("copy.windows") - 1))
    found = kinds.select(*whole, "n", "copy").join(some, whole, "left").select(*whole, F.coalesce(all_places, "places").alias("places"))
    found = stage(found.where("places is not null"), "suffix-places")
    hit = blocks.join(found.hint("merge"), whole)
    runs = F.flatten(F.transform("places", lambda p: F.array(F.col("first") + p, F.col("first") + p + 1)))
    hit = hit.select("anchor", "hi", "lo", runs.alias("runs"))
    return hit.groupBy("anchor", "hi", "lo").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _join_rows(docs: DataFrame, lookup: DataFrame, how: str) -> DataFrame:
    """Join texts with a staged table by row number (a hash of id and text) and id."""
    lookup = lookup.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    same = (docs["row"] == lookup["_row"]) & docs["doc_id"].eqNullSafe(lookup["_id"])
    return docs.join(lookup.hint("merge"), same, how).drop("_id", "_row")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row, spans: bytes covered by repeated strings, as unsorted starts and ends; texts without any are left out.

    ``row`` is xxhash64(doc_id, text). A staged table.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be at least {2 * GRAM}")
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    seen = stage(docs.mapInArrow(_scan(length), _SCAN.format(id=id_type)), "suffix-contexts")

    shared = seen.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor")
    met = seen.join(stage(shared, "suffix-anchors").hint("merge"), "anchor")
    met = stage(met.select("doc_id", "row", "anchor", "hi", "lo", "start", "windows", "weight"), "suffix-met")

    kinds = met.groupBy("anchor", "hi", "lo").agg(
        F.sum("weight").alias("n"),
        F.min("windows").alias("windows"),
        F.min(F.struct("row", "doc_id", "start")).alias("from"),
    )
    kinds = stage(kinds, "suffix-kinds")
    several = stage(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-several")
    wanted = kinds.join(several.hint("merge"), "anchor").groupBy("from.doc_id", "from.row").agg(
        F.collect_list(F.struct("anchor", "hi", "lo", "windows", F.col("from.start").alias("start"), "kinds")).alias("wanted")
    )
    wanted = stage(wanted, "suffix-wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, some in zip(utf8(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                names = ("anchor", "hi", "lo", "kinds")
                arrays = [pa.array([w[c] for w in some], pa.int64()) for c in names]
                pieces = [text[w["start"] : w["start"] + w["windows"] + length - 1] for w in some]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(pieces, pa.binary())], [*names, "bytes"])

    fetched = _join_rows(docs, wanted, "inner").select("text", "wanted")
    fetched = stage(fetched.mapInArrow(fetch, "anchor long, hi long, lo long, kinds long, bytes binary"), "suffix-bytes")
    few = fetched.where(F.col("kinds") <= MOST_CONTEXTS).drop("kinds").repartition("anchor").sortWithinPartitions("anchor")
    found = few.mapInArrow(_by_transform(length), _FOUND)

    many = _by_blocks(fetched.where(F.col("kinds") > MOST_CONTEXTS).drop("kinds"), length)
    found = stage(found.unionByName(many), "suffix-found").withColumnRenamed("runs", "part")

    whole = F.when(F.col("n") > 1, F.array(F.lit(0), F.col("windows")))
    runs = kinds.join(found, ["anchor", "hi", "lo"], "left").select("anchor", "hi", "lo", F.coalesce(whole, "part").alias("runs"))
    runs = stage(runs.where("runs is not null"), "suffix-runs")
    marked = met.join(runs.hint("merge"), ["anchor", "hi", "lo"])
    # Runs of windows (first, behind last) to bytes (start, end).
    spans = F.transform("runs", lambda x, i: x + F.col("start") + F.when(i % 2 == 1, length - 1).otherwise(0))
    marked = marked.select("doc_id", "row", spans.cast("array<int>").alias("spans"))
    sure = seen.where("sure is not null").select("doc_id", "row", F.col("sure").alias("spans"))
    marked = marked.unionByName(sure).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return stage(marked, "suffix-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with kept (binary: a cut can split a character), n_bytes, n_removed and n_spans.

    New columns get underscores in front if ``docs`` has columns of these names.
    """
    spans = repeated_spans(docs, length)
    names = [fresh(c, docs.columns) for c in ("kept", "n_bytes", "n_removed", "n_spans")]
    columns, gone = docs.columns, fresh("spans", docs.columns)
    row = fresh("row_hash", docs.columns)
    lookup = spans.withColumnsRenamed({"spans": gone, "row": f"{row}_", "doc_id": f"{row}_id"})
    hashed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    same = (hashed[row] == lookup[f"{row}_"]) & hashed["doc_id"].eqNullSafe(lookup[f"{row}_id"])
    joined = hashed.join(lookup.hint("merge"), same, "left").select(*columns, gone)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names}
            for text, some in zip(utf8(batch.column("text")), batch.column(gone).to_pylist(), strict=True):
                text = text or b""
                edge = [0]
                for a, b in sorted(zip(some[::2], some[1::2], strict=True)) if some else ():
                    if len(edge) > 1 and a <= edge[-1]:
                        edge[-1] = max(edge[-1], b)
                    else:
                        edge += [a, b]
                edge.append(len(text))
                kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                for name, value in zip(names, (kept, len(text), len(text) - len(kept), len(edge) // 2 - 1), strict=True):
                    out[name].append(value)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], [*columns, *names])

    schema = extended(docs.schema, ", ".join(f"`{n}` {t}" for n, t in zip(names, ("binary", "long", "long", "long"), strict=True)))
    return joined.mapInArrow(cut, schema)
