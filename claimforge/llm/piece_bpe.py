"""Encoding and decoding with a merge-type piece vocabulary, by an agenda of adjacent symbol pairs.

Every pair of neighbouring symbols whose join is a piece goes on the agenda, the best score first and the
leftmost of equals; the first pair is joined, its new neighbours go on, and entries of symbols that are gone
are passed over.  No piece spans two characters that are never neighbours within a piece, so texts are cut
there first, in arrays of codepoints; chunks between cuts merge on their own and are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import common

#: Bytes of text that are cut at once.
SCAN_BYTES = 2 << 20
#: Characters of all remembered chunks together, and of the longest one.
CACHE_CHARS, CACHE_LONGEST = 4_000_000, 32
#: Bytes of a model file that may be broadcast.
MODEL_BYTES = 64 << 20
#: Fixed value: what a space becomes.
BLANK = "▁"
#: Fixed values of the file format: numbers of message fields, kinds of models and of pieces.
F_PIECE, F_TRAINER, F_NORMALIZER, F_TYPE = 1, 2, 3, 3
T_MODEL_TYPE, T_SUFFIX_SPACE, T_BYTE_FALLBACK = 3, 24, 35
N_CHARSMAP, N_DUMMY_PREFIX, N_REMOVE_SPACES, N_ESCAPE = 2, 3, 4, 5
BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialised message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at:at + size]
        at += size


class Model:
    """Pieces and scores of a merge-type model, encoding and decoding by them.

    Models that normalise by a table, drop white space, lack byte pieces, or hold pieces of other kinds than
    normal, byte, control and unknown raise ValueError: their texts would get other ids than the library's.
    """

    def __init__(self, file: bytes):
        trainer, normaliser, pieces = {}, {}, []
        for field, value in _fields(file):
            if field == F_PIECE:
                pieces.append(dict(_fields(value)))
            elif field == F_TRAINER:
                trainer = dict(_fields(value))
            elif field == F_NORMALIZER:
                normaliser = dict(_fields(value))
        self.prefix = bool(normaliser.get(N_DUMMY_PREFIX, 1))
        if trainer.get(T_MODEL_TYPE, 1) != BPE or not trainer.get(T_BYTE_FALLBACK, 0) or trainer.get(T_SUFFIX_SPACE, 0):
            raise ValueError("a merge-type model with byte fallback and spaces before words is needed")
        if normaliser.get(N_CHARSMAP) or normaliser.get(N_REMOVE_SPACES, 1) or not normaliser.get(N_ESCAPE, 1):
            raise ValueError("a model that leaves texts as they are, but for spaces, is needed")
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.kinds: list[int] = []
        of_byte = {}
        for number, piece in enumerate(pieces):
            text, kind = piece[1].decode("utf-8"), piece.get(F_TYPE, NORMAL)
            self.kinds.append(kind)
            if kind == NORMAL:
                self.ids[text] = number
                self.rank[text] = -float(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0])
                self.bytes.append(text.replace(BLANK, " ").encode("utf-8"))
            elif kind == BYTE:
                of_byte[int(text[3:5], 16)] = number
                self.bytes.append(bytes([int(text[3:5], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                surface = trainer.get(44, " ⁇ ".encode())
                self.bytes.append(b"" if kind == CONTROL else surface)
            else:
                raise ValueError(f"piece {number} is of kind {kind}")
        self.of_byte = [of_byte[b] for b in range(256)]
        self.text = [str(i) for i in range(len(pieces))]
        self.known: dict[str, list[int]] = {}
        self.held = 0
        self._tabulate()

    def _tabulate(self) -> None:
        """Which characters are neighbours within a piece."""
        letters = sorted({c for piece in self.ids for c in piece})
        self.letter = np.zeros(0x110000, np.uint32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        pairs = {(piece[i], piece[i + 1]) for piece in self.ids for i in range(len(piece) - 1)}
        self.joined = np.zeros(self.letters * self.letters, bool)
        for a, b in pairs:
            self.joined[int(self.letter[ord(a)]) * self.letters + int(self.letter[ord(b)])] = True

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk whose spaces are marked already."""
        found = self.known.get(text)
        if found is None:
            found = self._agenda(text)
            if len(text) <= CACHE_LONGEST:
                self.held += len(text)
                if self.held > CACHE_CHARS:
                    self.known.clear()
                    self.held = len(text)
                self.known[text] = found
        return found

    def _agenda(self, text: str) -> list[int]:
        rank, n = self.rank, len(text)
        stop, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive, agenda = [True] * n, []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (score := rank.get(text[i:stop[j]])) is not None:
                heapq.heappush(agenda, (score, i, j, stop[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, end = heapq.heappop(agenda)
            if not (alive[i] and alive[j]) or right[i] != j or stop[j] != end:
                continue
            alive[j], stop[i], right[i] = False, end, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        ids: list[int] = []
        for i in range(n):
            if alive[i]:
                own = self.ids.get(text[i:stop[i]])
                ids += [own] if own is not None else [self.of_byte[b] for b in text[i:stop[i]].encode("utf-8")]
        return ids

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
        """Ids of each row of UTF-8 texts."""
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]  # codepoints before each row
        filled = np.diff(begins) > 0
        if self.prefix:
            codes = np.insert(codes, begins[:-1][filled], ord(BLANK))
            begins = begins + np.concatenate([[0], np.cumsum(filled)])
        codes = np.where(codes == 32, np.uint32(ord(BLANK)), codes)
        kinds = self.letter[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joined[kinds[:-1] * np.uint32(self.letters) + kinds[1:]]
        cut[begins[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, begins).tolist()
        text, cuts, chunk = codes.tobytes().decode("utf-32-le"), [*starts.tolist(), len(codes)], self.chunk
        for a, b in zip(first[:-1], first[1:]):
            ids: list[int] = []
            for k in range(a, b):
                ids += chunk(text[cuts[k]:cuts[k + 1]])
            yield ids

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return next(self.encode_rows(raw, np.array([0, len(raw)])))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a byte that belongs to no character becomes U+FFFD, the first space goes if texts get one."""
        own, kinds = self.bytes, self.kinds
        start = 0
        while start < len(ids) and kinds[ids[start]] == CONTROL:
            start += 1
        whole = b"".join([own[i] for i in ids])
        if self.prefix and start < len(ids) and kinds[ids[start]] == NORMAL and own[ids[start]][:1] == b" ":
            whole = whole[1:]
        try:
            return whole.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_by_runs(ids)

    def _decode_by_runs(self, ids: list[int]) -> str:
        out, run, fresh = [], bytearray(), self.prefix
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += self.bytes[i]
                continue
            out.append(_characters(bytes(run)))
            fresh = fresh and not run
            run.clear()
            if i < 0 or self.kinds[i] == CONTROL:
                continue
            text = self.bytes[i].decode("utf-8")
            out.append(text[1:] if fresh and self.kinds[i] == NORMAL and text[:1] == " " else text)
            fresh = False
        return "".join(out)


def _characters(run: bytes) -> str:
    """Characters of a run of bytes, each byte of none being U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at:at + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


_MODELS: dict[bytes, Model] = {}


def _model(file: bytes) -> Model:
    """One a worker: another file takes its place, so that a long-lived worker holds one cache."""
    key = hashlib.md5(file).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(file)
    return _MODELS[key]


def load_model(path: str) -> bytes:
    """The model file; it is broadcast, so its size is checked."""
    with open(path, "rb") as f:
        file = f.read(MODEL_BYTES + 1)
    if len(file) > MODEL_BYTES:
        raise ValueError(f"{path}: over {MODEL_BYTES >> 20} MB")
    Model(file)  # an unfit model fails here rather than in a task
    return file


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: ids of the whole text, one row per input row, whatever repeats.

    Null and empty texts have no ids; a null id stays null; other columns don't matter.  A text of any length is
    encoded whole: its chunks are as long as no cut falls into them.
    """
    file = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(file.value)
        for rows, raw, offsets in common.scan_rows(batches, 1, SCAN_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(own.encode_rows(raw, offsets)), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids give null, an unknown id raises IndexError."""
    file = encoded.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(file.value)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids, and keeps digests only."""
    file = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(file.value)
        for rows, raw, offsets in common.scan_rows(batches, 1, SCAN_BYTES):
            counts, of_ids, of_text = [], [], []
            for ids in own.encode_rows(raw, offsets):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([own.text[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def differences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, library_ids`` of the rows whose ids or decoded text aren't the sentencepiece library's; none if all is well."""
    file = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        own, library = _model(file.value), SentencePieceProcessor(model_proto=file.value)
        kind = pa.list_(pa.int32())
        for rows, raw, offsets in common.scan_rows(batches, 1, SCAN_BYTES):
            ids = list(own.encode_rows(raw, offsets))
            theirs = library.encode([x or "" for x in rows.column(1).to_pylist()], num_threads=1)
            odd = [k for k, (x, y) in enumerate(zip(ids, theirs)) if x != y or own.decode(x) != library.decode(y)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(odd, pa.int64())), pa.array([ids[k] for k in odd], kind), pa.array([theirs[k] for k in odd], kind)], ["doc_id", "ids", "library_ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, library_ids array<int>")
