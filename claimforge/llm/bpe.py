"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text becomes an array of codepoint classes.  A twelve-state automaton says where tokens of the
pre-tokenisation pattern start; as functions on states compose associatively, each block of the
array is scanned for all start states at once, the blocks' functions are composed, and a second
scan with known start states marks the boundaries.  No regular expression runs.  The slices between
boundaries feed pair merging through a cache; what was sliced where is kept, so ids map back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import common

#: Bytes of text that are cut into pieces at once; what that takes, a worker keeps for later stages.
SCAN_BYTES = 512 << 10
#: Pieces whose ids are remembered, and the longest such piece in bytes.
CACHE_PIECES, CACHE_BYTES = 170_000, 64

# Classes of codepoints.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, R_OR_V, ELL, E = range(10)
CLASSES = 10
#: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every codepoint, by its Unicode general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = BLANK
    table[32], table[ord("'")] = SPACE, QUOTE
    for letters, kind in (("stmd", ONE), ("rv", R_OR_V), ("l", ELL), ("e", E)):
        table[[ord(c) for c in letters]] = kind
    return table


# States: what has been read just before a codepoint.
(BEGIN, SPACE_1, BLANK_1, SPACE_2, BLANK_2, IN_LETTERS, IN_NUMBERS, IN_OTHER, APOSTROPHE, AWAITS_E, AWAITS_L, CONTRACTED) = range(12)
STATES = 12
HERE, BEFORE = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state, and whether a token starts here or at the codepoint before."""
    marks = 0
    if state in (AWAITS_E, AWAITS_L):
        if kind == (E if state == AWAITS_E else ELL):
            return CONTRACTED, 0
        state, marks = IN_LETTERS, BEFORE  # the quote stands alone; its letter began a token
    if kind in (SPACE, BLANK):
        if state in (SPACE_1, BLANK_1, SPACE_2, BLANK_2):
            return (SPACE_2 if kind == SPACE else BLANK_2), marks
        return (SPACE_1 if kind == SPACE else BLANK_1), marks | HERE
    joined = state in (SPACE_1, SPACE_2)  # a space belongs to the token that follows it
    if state in (SPACE_2, BLANK_2):
        marks |= BEFORE  # of several white spaces the last one stands apart
    if kind in (OTHER, QUOTE):
        if joined or state in (IN_OTHER, APOSTROPHE):
            return IN_OTHER, marks
        return (APOSTROPHE if kind == QUOTE else IN_OTHER), marks | HERE
    if kind == NUMBER:
        return IN_NUMBERS, marks if joined or state == IN_NUMBERS else marks | HERE
    if state == APOSTROPHE:
        if kind == ONE:
            return CONTRACTED, marks
        if kind == R_OR_V:
            return AWAITS_E, marks
        if kind == ELL:
            return AWAITS_L, marks
    return IN_LETTERS, marks if joined or state == IN_LETTERS else marks | HERE


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and marks by ``class * STATES + state``; the classes come again for a text's first codepoint."""
    moves, marks = np.zeros((2, CLASSES, STATES), np.uint8), np.zeros((2, CLASSES, STATES), np.uint8)
    for kind in range(CLASSES):
        for state in range(STATES):
            moves[0, kind, state], marks[0, kind, state] = _step(state, kind)
            moves[1, kind, state], marks[1, kind, state] = _step(BEGIN, kind)
            if state in (AWAITS_E, AWAITS_L):
                marks[1, kind, state] |= BEFORE  # the text before ended within "'r"
    return moves.ravel(), marks.ravel()


MOVES, MARKS = _tables()


def boundaries(kinds: np.ndarray, first: np.ndarray, block: int = 512) -> np.ndarray:
    """Where tokens start in an array of classes; ``first`` are the indices where texts start."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64)
    at = kinds.astype(np.int16)
    at[first] += CLASSES
    at *= STATES
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.int16)
    grid[:n] = at
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    function = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:  # each block's function from start state to end state
        function = MOVES.take(column[:, None] + function)
    state, carried = BEGIN, np.empty(rows, np.uint8)
    for k, f in enumerate(function.tolist()):
        carried[k] = state
        state = f[state]
    marks = np.empty_like(grid, dtype=np.uint8)
    for k, column in enumerate(grid):
        index = column + carried
        marks[k] = MARKS.take(index)
        carried = MOVES.take(index)
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    if state in (AWAITS_E, AWAITS_L) and n % block == 0 or n % block and _ends_open(at):
        starts[-1] = True
    return np.flatnonzero(starts)


def _ends_open(at: np.ndarray) -> bool:
    """Whether the last text ends within "'r", "'v" or "'l"."""
    tail, state = at[-64:].tolist(), BEGIN
    for index in tail:  # after two codepoints the state no longer hangs on what came before a quote's run
        state = MOVES[index + state]
    return state in (AWAITS_E, AWAITS_L)


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of UTF-8 rows, and each row's first piece (``n + 1`` numbers)."""
    data = raw.tobytes()
    codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    rows = offsets[:-1][np.diff(offsets) > 0]
    starts = lead[boundaries(class_table()[codes], np.searchsorted(lead, rows))]
    return starts, np.searchsorted(starts, offsets)


class Vocabulary:
    """Ranks of byte strings, and pair merging by them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.text = [b"%d" % i for i in range(len(self.bytes))]
        self.known: dict[bytes, list[int]] = {}

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x)})

    def encode_piece(self, piece: bytes) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            whole = self.ranks.get(piece)
            found = [whole] if whole is not None else self._merge(piece) if len(piece) <= 48 else self._merge_long(piece)
            if len(piece) <= CACHE_BYTES:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _merge(self, piece: bytes) -> list[int]:
        """The pair of lowest rank merges first, the leftmost of equals."""
        ranks, parts = self.ranks, [piece[i:i + 1] for i in range(len(piece))]
        none = len(self.bytes)
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        ranks, n = self.ranks, len(piece)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(piece[i:ends[j]])) is not None:
                heapq.heappush(heap, (rank, i, ends[i], ends[j]))

        for i in range(n):
            push(i)
        alive = [True] * n
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != middle or after[i] >= n or ends[after[i]] != end:
                continue
            j = after[i]
            alive[j], ends[i], after[i] = False, end, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ranks[piece[i:ends[i]]] for i in range(n) if alive[i]]

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
        """Ids of each row."""
        starts, first = pieces(raw, offsets)
        data, cuts, encode = raw.tobytes(), [*starts.tolist(), len(raw)], self.encode_piece
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            ids: list[int] = []
            for k in range(a, b):
                ids += encode(data[cuts[k]:cuts[k + 1]])
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        own = self.bytes
        return b"".join([own[i] for i in ids])


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def _vocabulary(lines: bytes) -> Vocabulary:
    """One per worker and file; its cache lives as long as the worker."""
    key = hashlib.md5(lines).digest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary.parse(lines)
    return _VOCABULARIES[key]


def load_ranks(path: str) -> bytes:
    """The file's lines; they are broadcast, so their size is checked: 64 MB at most."""
    with open(path, "rb") as f:
        lines = f.read((64 << 20) + 1)
    if len(lines) > 64 << 20:
        raise ValueError(f"{path}: over 64 MB of ranks")
    return lines


def _rows(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = common.string_buffers(batch.column(text))
        for a, b in common.slices(offsets, SCAN_BYTES):
            yield batch.slice(a, b - a), raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, starts array<int>``: ids of the whole text and the byte where each begins.

    Null and empty texts have no ids.  One row per input row, whatever repeats; a null id stays null.
    """
    lines = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(lines.value)
        sizes = np.array([len(x) for x in own.bytes], np.int32)
        kind = pa.list_(pa.int32())
        for rows, raw, offsets in _rows(batches, 1):
            ids = list(own.encode_rows(raw, offsets))
            begins = [np.concatenate([[0], np.cumsum(sizes[x])[:-1]]).astype(np.int32) if x else [] for x in ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, kind), pa.array(begins, kind)], ["doc_id", "ids", "starts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes binary`` of rows of ``doc_id, ids``; null ids give null, an unknown id raises IndexError."""
    lines = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(lines.value)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids, and keeps digests only."""
    lines = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(lines.value)
        for rows, raw, offsets in _rows(batches, 1):
            counts, of_ids, of_bytes = [], [], []
            for ids in own.encode_rows(raw, offsets):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join([own.text[i] for i in ids])).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
