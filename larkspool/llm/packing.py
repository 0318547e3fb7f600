"""Token ids in fixed-length rows: best-fit-decreasing packing with a segment tree.

A document is its tokens and an end token. What is longer than a row is cut into whole
rows and a rest, losing nothing. Pieces are packed longest first, each into the fullest
row that still has room; a segment tree over the room left finds that row in log(length)
steps. Every row of a matrix has its ids as little-endian integers filled up with the pad
token, the cumulative lengths of its segments, and a bit mask of the places where
position ids start again at 0.

Packing is done by each task over its own documents, BUFFER_TOKENS tokens at a time, so
that texts and tokens are not shuffled and memory is bounded. The rows of a table depend on
how its files are split; every document is in it once, whole, whatever the split.

Null and empty texts are an end token alone. Ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larkspool.llm.common import pieces as slices
from larkspool.llm.common import share

#: Tokens of one row, and tokens that a task packs at a time.
ROW_TOKENS, BUFFER_TOKENS = 2_048, 4_000_000
#: Pieces of text whose ids a task remembers.
REMEMBERED = 250_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of the tokenizer file: how it cuts a text, and its end token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_TOKEN = 50_256
_TWO_SPACES = re.compile(r" \s|\s ")
SCHEMA = (
    "row_id long, ids binary, n_tokens int, cu_seqlens array<int>, resets binary, doc_ids array<{id}>, pieces array<int>"
)


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE given by its file of ranks."""

    data: bytes
    end: int = END_TOKEN

    @staticmethod
    def read(path: str = TOKENIZER, end: int = END_TOKEN) -> Tokenizer:
        with open(path, "rb") as file:
            return Tokenizer(file.read(), end)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if max(self.data.count(b"\n"), self.end) < 1 << 16 else "<u4")

    def encoder(self) -> Encoder:
        return Encoder(self)


class Encoder(dict):
    """Texts to ids as bytes. Pieces between single spaces are encoded once and remembered.

    The pattern never joins what stands before a single space with what follows it, so
    pieces can be encoded one by one. Texts with other white space beside a space are
    encoded in one go.
    """

    def __init__(self, tokenizer: Tokenizer):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tokenizer.data.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = tokenizer.dtype
        self.end = np.array([tokenizer.end], self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(piece), self.dtype).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if _TWO_SPACES.search(text):
            return np.array(self.bpe.encode_ordinary(text), self.dtype).tobytes() + self.end
        first, *rest = text.split(" ")
        return b"".join([self[first], *map(self.__getitem__, [" " + x for x in rest]), self.end])


class Rooms:
    """Open rows by the room they have left: a segment tree over 0..size that finds the least room that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Take out the row with the least room of at least ``need``, and its room."""
        node = need + self.leaves
        while not self.filled[node]:
            while node & 1:  # a right child, or the root: go up
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.filled[node] = 0
            while (node := node >> 1) and not (self.filled[2 * node] or self.filled[2 * node + 1]):
                self.filled[node] = 0
        return row, room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Pieces (by place) of each row; no length exceeds ``size``."""
    rows: list[list[int]] = []
    rooms = Rooms(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        row, room = rooms.take(need) or (len(rows), size)
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if room > need:
            rooms.add(room - need, row)
    return rows


def pack(docs: DataFrame, tokenizer: Tokenizer, row_tokens: int = ROW_TOKENS, pad: int | None = None) -> DataFrame:
    """Packed rows of the documents (doc_id, text).

    row_id; ids (binary); n_tokens without padding; cu_seqlens (0, then the end of each
    segment); resets (bits, most significant first, one per token of the row); doc_ids and
    pieces (the number of the piece within its document) per segment.
    """
    shared = share(docs.sparkSession, tokenizer)
    id_type = docs.schema["doc_id"].dataType
    fill = tokenizer.end if pad is None else pad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared().encoder()
        width = encoder.dtype.itemsize
        full = row_tokens * width
        filler = np.full(row_tokens, fill, encoder.dtype).tobytes()
        made = TaskContext.get().partitionId() << 33
        pieces: list[tuple[bytes, int, int]] = []  # ids, place of the document id, number
        ids: list = []
        arrow_id = None

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made
            lengths = np.array([len(p[0]) // width for p in pieces], np.int64)
            packed = best_fit_decreasing(lengths, row_tokens)
            for at in range(0, len(packed), 500):
                some = packed[at : at + 500]
                out = {k: [] for k in ("ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "pieces")}
                for row in some:
                    ends = np.cumsum(lengths[row])
                    starts = np.zeros(row_tokens, bool)
                    starts[0] = True
                    starts[ends[:-1]] = True
                    used = b"".join(pieces[i][0] for i in row)
                    out["ids"].append(used + filler[len(used) :])
                    out["n_tokens"].append(int(ends[-1]))
                    out["cu_seqlens"].append([0, *ends.tolist()])
                    out["resets"].append(np.packbits(starts).tobytes())
                    out["doc_ids"].append([ids[pieces[i][1]] for i in row])
                    out["pieces"].append([pieces[i][2] for i in row])
                types = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(arrow_id), pa.list_(pa.int32()))
                numbers = pa.array(np.arange(made, made + len(some)), pa.int64())
                made += len(some)
                yield pa.RecordBatch.from_arrays(
                    [numbers, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["row_id", *out]
                )

        held = 0
        for batch in slices(batches):
            arrow_id = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = encoder.ids(text)
                ids.append(doc_id)
                cut = range(0, len(tokens), full)
                pieces += [(tokens[a : a + full], len(ids) - 1, k) for k, a in enumerate(cut)]
                held += len(tokens) // width
                if held >= BUFFER_TOKENS:
                    yield from rows()
                    pieces, ids, held = [], [], 0
        if pieces:
            yield from rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=id_type.simpleString()))


def position_ids(cu_seqlens: list[int], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Positions of a row's tokens, from 0 in each segment; the padding counts on as a segment of its own."""
    starts = np.zeros(row_tokens, np.int64)
    inner = [x for x in cu_seqlens if x < row_tokens]
    starts[inner] = inner
    return np.arange(row_tokens) - np.maximum.accumulate(starts)
