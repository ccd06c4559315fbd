"""What several operators share: word scanning over Arrow buffers, hashing, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimforge.session import ensure_checkpoint_dir

#: Fixed value: the bytes that separate words, 0x20 and 0x09-0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_WORD = np.where(_IS_SPACE, np.uint64(0), _BYTE)


def keep_freed_memory() -> None:
    """Freed blocks of up to 32 MB serve the next arrays, which the C library grants once it has freed one as large.

    Before that, each large array of a loop over arrays is pages that the system hands out and clears anew.
    """
    np.empty(31 << 20, np.uint8)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ~_IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (maximal runs of ``is_word`` bytes within a row), and the first word of each row."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def byte_weights(is_word: np.ndarray) -> np.ndarray:
    """What bytes count for in ``word_hashes``: those between words count for nothing."""
    return np.where(is_word, _BYTE, np.uint64(0))


def word_hashes(raw: np.ndarray, starts: np.ndarray, weights: np.ndarray = _BYTE_WORD) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = raw[starts[0]:]
    starts = starts - starts[0]
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
    power = np.full(int(lengths.max()), _ODD, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    return mix(np.add.reduceat(weights[raw] * power[place], starts))


#: The lowest bytes of an integer, none to all eight of them.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_integers(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int = 0) -> np.ndarray:
    """Bytes ``8 * k`` to ``8 * k + 7`` of each word as an integer, the first one lowest; 0 for those beyond its end.

    ``raw`` goes on for eight bytes behind the last one that is asked for.
    """
    found = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[starts + 8 * k]
    found &= _LOWEST.take(lengths - 8 * k, mode="clip")
    return found


def plain_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, faster than ``word_hashes`` and another: words are read as integers."""
    lengths = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = word_integers(padded, starts, lengths)
    out ^= lengths.astype(np.uint64) * _ODD
    out = mix(out)
    for k in (1, 2):
        over = np.flatnonzero(lengths > 8 * k)
        if not len(over):
            return out
        more = word_integers(padded, starts[over], lengths[over], k)
        out[over] = mix(out[over] + more * _ODD)
    over = np.flatnonzero(lengths > 24)
    if len(over):
        n = lengths[over]
        begins = np.cumsum(n) - n
        out[over] = word_hashes(raw[np.repeat(starts[over] - begins, n) + np.arange(int(n.sum()))], begins)
    return out


def size_in_bytes(df: DataFrame) -> int:
    """Bytes that the plan's scans read, by Catalyst's estimate; no job. A leaf of unknown size counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 2**60)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions within hand Python batches of ``most`` bytes or a row."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, most)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def shared_path(df: DataFrame, name: str) -> str:
    """A new folder under the checkpoint folder, which the driver and all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` and, as the last column, a number for each row, the same whenever it is read: ``_row``, or longer if taken.

    A table just read from Parquet is numbered by file and place in the file; anything else is written first.
    """
    row, columns = "_row", docs.columns
    while row in columns:
        row += "_"
    if not _just_read(docs):
        to = shared_path(docs, "rows")
        docs.write.parquet(to)
        docs = docs.sparkSession.read.parquet(to)
    ensure_checkpoint_dir(docs.sparkSession)
    file, at = (f"{name}_{uuid.uuid4().hex}" for name in ("file", "at"))
    place = docs.metadataColumn("_metadata")
    files = docs.select(place["file_path"].alias(file)).distinct()
    files = files.withColumn(row, F.row_number().over(Window.orderBy(file)).cast("long")).checkpoint()  # a row a file
    placed = docs.select("*", place["file_path"].alias(file), place["row_index"].alias(at)).join(broadcast_if_small(files), file)
    return placed.select(*columns, (F.shiftleft(row, 40) + F.col(at)).alias(row))


def _just_read(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files as it was read: behind a join or a union a place in a file is no row's own."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and bool(docs.inputFiles())


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one or two 8-byte columns that may be broadcast: 16 MB at most.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has few rows; beyond that as it is, and the join shuffles.

    For DataFrames that are cheap to count: rows of a few bytes, read from a table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class WordTable:
    """Values of words, worked out once for each word that a worker meets; emptied when it holds ``most`` words.

    ``fill`` gets new words (UTF-8) and gives a row of ``width`` numbers for each.
    """

    def __init__(self, width: int, fill, most: int = 600_000, dtype=np.float64):
        self.width, self.fill, self.most, self.dtype = width, fill, most, dtype
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.values = np.zeros((1 << 14, self.width), self.dtype)
        self.count = 0

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of ``values`` of each word; valid until the next call."""
        if self.count > self.most:
            self._clear()
        data, known = raw.tobytes(), self.known
        found = np.fromiter((known[data[a:b]] for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        if known.new:
            rows = self.fill(known.new)
            while self.count + len(rows) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[self.count:self.count + len(rows)] = rows
            self.count += len(rows)
            known.new = []
        return found


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id written as text; a null id's is null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Bytes of text that are scanned at once.
SCAN_BYTES = 4 << 20


def scan_rows(batches: Iterator[pa.RecordBatch], text: int, most: int = SCAN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the bytes and offsets of their text column."""
    for batch in batches:
        raw, offsets = string_buffers(batch.column(text))
        for a, b in slices(offsets, most):
            yield batch.slice(a, b - a), raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def sum_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row's words, row k's being ``first[k]:first[k + 1]``."""
    before = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, 0)])
    return before[first[1:]] - before[first[:-1]]
