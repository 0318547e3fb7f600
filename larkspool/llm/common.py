"""What the operators share: Arrow batches, word hashes, staged tables and joins by id."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspool.operators.staging import stage

#: A staged id table of up to this many bytes and rows is broadcast; a larger one is joined by a shuffle. Files don't show how
#: large a table gets in memory: as a hash table a row takes some 100 bytes of the driver and of each executor.
ID_BROADCAST_BYTES, ID_BROADCAST_ROWS = 8 << 20, 500_000
#: A lookup table of which only a bound of its rows is known is broadcast up to this bound; copies of it that a hot key is dealt over.
BROADCAST_ROWS, SALTS = 100_000, 16
#: Words that a task remembers at a time.
REMEMBERED_WORDS = 100_000
#: Rows and bytes of a batch that a task turns into Python values at a time.
PIECE_ROWS, PIECE_BYTES = 1_024, 4 << 20
#: Bytes of rows that an executor sends to a Python worker at a time.
BATCH_BYTES = 8 << 20
#: Rows of a file of a staged table whose size is known beforehand, and its least number of files.
ROWS_PER_FILE, LEAST_FILES = 50_000, 12
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: A word of a folded text: digits, lower-case letters and whatever is not ASCII.
FOLDED_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def ensure_folder(spark: SparkSession) -> None:
    """Give a local session without ``spark.checkpoint.dir`` a folder of its own, as in tests."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))


def small_batches(spark: SparkSession) -> None:
    """Lower the bound on Arrow batches of whole texts to BATCH_BYTES, unless the session has a lower one.

    A batch is held outside of the heap: as growing vectors and a message by the executor and
    once more by the worker. With Spark's 64 MB that is several hundred MB per running task.
    """
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to ``rows`` rows and about ``size`` bytes, one row at least.

    Spark's batches hold thousands of whole texts; as Python values these are several times as
    large, and a worker that is used again for the next task doesn't give memory back by itself.
    """
    give_back()
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it (Spark compares names without case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def staged_bytes(df: DataFrame) -> int:
    """Size of a table written by ``stage``, from the names of its files."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def stage_few(df: DataFrame, label: str, most: int) -> DataFrame:
    """Stage a narrow table of at most ``most`` rows in files of a fair size.

    Rounds over a few thousand rows otherwise write one tiny file per shuffle partition each.
    The number of files follows the rows and never exceeds that of the partitions.
    """
    return stage(df.coalesce(max(LEAST_FILES, -(-most // ROWS_PER_FILE))), label)


def join_by_id(docs: DataFrame, lookup: DataFrame, key: str, how: str) -> DataFrame:
    """Join wide rows with a staged table of ids; a null id meets a null id.

    If the staged files have at most ID_BROADCAST_BYTES and ID_BROADCAST_ROWS the ids are
    broadcast and the texts stay where they are; else both sides are shuffled by the id. The
    answer is the same.
    """
    small = staged_bytes(lookup) <= ID_BROADCAST_BYTES and lookup.count() <= ID_BROADCAST_ROWS
    own = fresh("lookup_id", [*docs.columns, *lookup.columns])
    lookup = lookup.withColumnRenamed(key, own)
    joined = docs.join(F.broadcast(lookup) if small else lookup.hint("merge"), docs[key].eqNullSafe(lookup[own]), how)
    return joined.drop(own)


def sized(lookup: DataFrame, most: int | None) -> DataFrame:
    """``lookup`` with the hint for a join that its number of rows asks for, at most ``most`` (None: any number).

    Catalyst goes by the size of compressed files and leaves out that an explode makes rows. It would
    broadcast tables through the driver that are many times as large as its limit.
    """
    return F.broadcast(lookup) if most is not None and most <= BROADCAST_ROWS else lookup.hint("merge")


def join_dealt(big: DataFrame, lookup: DataFrame, keys: list[str], deal: Column, most: int | None = None) -> DataFrame:
    """``big`` with the rows of ``lookup`` of the same keys, which may have a large part of the rows of ``big``.

    A ``lookup`` of few rows (``most``, if known) is broadcast as it is. Else its rows are copied for each
    salt, over which ``deal`` (an integer) spreads the rows of ``big``, and both sides are shuffled.
    """
    if most is not None and most <= BROADCAST_ROWS:
        return big.join(F.broadcast(lookup), keys)
    dealt = big.withColumn("salt", F.pmod(deal, F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(sized(copies, None), [*keys, "salt"]).drop("salt")


def give_back() -> None:
    """Return memory that earlier tasks of this Python worker have freed to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of this package's classes; the function gives it to a task, which then starts with little memory."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load() -> object:
        give_back()
        return pickle.loads(data.value)

    return load


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(_WHITE)] = True
#: Bytes whose words are hashed at a time.
_PIECE = 1 << 18
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0xD1342543DE82EF97)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


_POWERS, _INVERSES = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece: polynomials of random byte values, from prefix sums."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    powers, inverses = (_POWERS, _INVERSES) if n <= _PIECE else (_powers(_BASE, n), _powers(_INVERSE, n))
    edges = np.flatnonzero(np.diff(_IS_WHITE[text], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * powers[:n])])
    return mix((prefix[ends] - prefix[starts]) * inverses[starts]), starts


def word_hashes(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words: what ASCII white space separates, A-Z lower-cased."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        nonlocal size
        hashes, starts = _hashed(b"\n".join(group))
        first = np.cumsum([0] + [len(t) + 1 for t in group])
        cut = np.searchsorted(starts, first)
        yield from (hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
        group.clear()
        size = 0

    for text in texts:
        text = text or b""
        if group and size + len(text) >= _PIECE:
            yield from flush()
        if len(text) < _PIECE:
            group.append(text)
            size += len(text) + 1
            continue
        found, at = [], 0
        while at < len(text):  # a long text, in pieces that end at white space
            end = at + _PIECE
            if end < len(text):
                cut = max(text.rfind(bytes([c]), at, end) for c in _WHITE)
                after = [p for c in _WHITE if (p := text.find(bytes([c]), end)) >= 0] if cut <= at else []
                end = cut if cut > at else min(after, default=len(text))
            found.append(_hashed(text[at:end])[0])
            at = end
        yield np.concatenate(found)
    if group:
        yield from flush()


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def extended(schema: StructType, extra: str, keep: list[str] | None = None) -> StructType:
    """The fields ``keep`` of ``schema`` (all, if None) followed by those of the DDL string ``extra``."""
    kept = [f for f in schema.fields if keep is None or f.name in keep]
    return StructType([*kept, *StructType.fromDDL(extra).fields])


__all__ = [
    "FOLD", "FOLDED_WORD", "ensure_folder", "fresh", "join_by_id", "join_dealt", "extended", "mix",
    "pieces", "share", "signed", "sized", "small_batches", "stage", "stage_few", "staged_bytes", "utf8", "word_hashes",
]
