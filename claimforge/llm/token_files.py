"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

A segment's header has its distinct ids, dealt into buckets, with their frequencies: the state from
which every block starts, so each block decodes alone.  For every id there are three predictions.
Order 0 is the id's bucket, whose frequencies adapt to the block, and its frequency within the bucket.
Orders 1 and 2 are the ids last seen after the same id and the same two ids.  The chance that the
favoured guess of these two is right is mixed in the logistic domain, by weights that learn, from the
confidence of both guesses and from what order 0 gives the guess.  An id that isn't guessed is coded by order 0.
Blocks are lanes of numpy arrays: one step codes one id of every lane.  What is coded hangs on
integers only, so that any machine decodes alike.

A segment is a run of whole documents in ascending id order: an index of ids and token counts, and
its blocks.  Spark's writer stores segments, so a file can be anywhere that Spark can write.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm import common

MAGIC, VERSION = b"CMR1", 2
#: Ids of a block, about; ids of a segment after which a new one begins at the next document.
BLOCK_IDS, SEGMENT_IDS = 1024, 6 << 20
#: Lanes that are coded together.
LANES = 8192
#: Bytes of text that are tokenised at once; words whose ids are remembered.
SCAN_BYTES, CACHE_WORDS = 4 << 20, 1_000_000
#: Bits of the slots in which words are found without their bytes.
SLOT_BITS = 20

_ONE, _TWO = 512, 1024  # slots of each context table of a lane
_BUCKETS, _TOTAL = 32, 4096  # of order 0, and their frequencies' sum
_REFRESH = 64  # ids between refreshes of the buckets' frequencies
_TOP = np.uint64(1) << np.uint64(48)
_MASK = _TOP - np.uint64(1)
_MOST = 15  # confidence of a guess
_WIDE = 1 << 13  # the squash table reaches from -_WIDE to _WIDE

_U12, _U16, _U48 = (np.uint64(x) for x in (12, 16, 48))


def _stretch_table() -> np.ndarray:
    """ln(p / (1 - p)) of p in 4096ths, in 256ths."""
    p = (np.arange(4096) + 0.5) / 4096
    return np.clip(np.rint(256 * np.log(p / (1 - p))), -2047, 2047).astype(np.int32)


def _squash_table() -> np.ndarray:
    """Its inverse, in 65536ths, kept within 64 and 65536 - 64."""
    x = np.arange(-_WIDE, _WIDE) / 256
    return np.clip(np.rint(65536 / (1 + np.exp(-np.clip(x, -40, 40)))), 64, 65536 - 64).astype(np.int32)


_STRETCH, _SQUASH = _stretch_table(), _squash_table()
#: What the confidence of a guess speaks for, in the same units: nothing without a guess, then an eighth to fifteen sixteenths.
_SAYS = np.concatenate([[0], _STRETCH[np.linspace(512, 3840, 15).astype(int)]]).astype(np.int32)


#: What a miss (first 16) or hit adds to the confidence of an order-1 guess, and whether the guess stays.
_CHANGE = np.concatenate([-(np.arange(16) >> 1), np.arange(16) < _MOST]).astype(np.int32)
_OUTLIVES = np.concatenate([np.arange(16) > 1, np.ones(16)]).astype(np.int32)


class _Prior:
    """Order 0 at the start of every block of a segment: buckets of neighbouring ids, and frequencies within them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, share: np.ndarray, freq: np.ndarray, bits: int):
        self.ids, self.sizes, self.share, self.freq, self.bits = ids, sizes, share.astype(np.int32), freq.astype(np.int64), bits
        first = np.cumsum(sizes) - sizes
        self.bucket = np.repeat(np.arange(_BUCKETS), sizes)
        before = np.cumsum(self.freq) - self.freq
        self.start = before - before[first[self.bucket]] if len(ids) else before
        # log odds of each id in 256ths, by whole numbers: p is of 2 ** (bits + 10)
        p = (self.share[self.bucket] + 1) * self.freq
        power = np.frexp(p.astype(float))[1].astype(np.int64)
        tail = (p << 5 >> power) - 16 if len(ids) else p
        self.odds = np.maximum(-2047, -(177 * (16 * (bits + 11 - power) - tail)) // 16).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> _Prior:
        """Buckets hold about equal parts of both the ids and their occurrences."""
        most = 2 * len(ids) // _BUCKETS + 2
        bits = max(12, int(most - 1).bit_length() + 2)
        total = int(counts.sum())
        weight = counts * len(ids) + total
        after = np.cumsum(weight)
        bucket = (2 * after - weight) * _BUCKETS // (2 * int(after[-1]))
        sizes, mass = np.bincount(bucket, minlength=_BUCKETS), np.bincount(bucket, counts, _BUCKETS).astype(np.int64)
        freq = 1 + counts * ((1 << bits) - sizes[bucket]) // mass[bucket]
        # what rounding leaves goes to the last of each bucket
        full, last = np.flatnonzero(sizes), np.cumsum(sizes) - 1
        freq[last[full]] += (1 << bits) - np.add.reduceat(freq, (last - sizes + 1)[full])
        return cls(ids, sizes, mass * 1024 // total, freq, bits)

    def pack(self) -> bytes:
        parts = [np.diff(self.ids, prepend=0), self.freq, self.sizes, self.share]
        return struct.pack("<BI", self.bits, len(self.ids)) + zlib.compress(b"".join(x.astype("<u4").tobytes() for x in parts), 6)

    @classmethod
    def unpack(cls, data: bytes) -> _Prior:
        bits, n = struct.unpack_from("<BI", data)
        ids, freq, sizes, share = np.split(np.frombuffer(zlib.decompress(data[5:]), "<u4").astype(np.int64), [n, 2 * n, 2 * n + _BUCKETS])
        return cls(np.cumsum(ids), sizes, share, freq, bits)

    def lookup(self) -> np.ndarray:
        """The id's number for each bucket and place within it."""
        out = np.zeros((_BUCKETS, 1 << self.bits), np.int32)
        out[self.sizes > 0] = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq).reshape(-1, 1 << self.bits)
        return out.ravel()


class _Model:
    """Predictions for one id of each of ``lanes`` blocks, and what they learn from it.

    Tables are flat with a stretch for each lane.  A slot holds ``id << 4 | confidence``.
    """

    def __init__(self, lanes: int, prior: _Prior):
        lane = np.arange(lanes)
        self.odds = prior.odds
        self.slots1, self.slots2, self.buckets, self.sums = lane * _ONE, lane * _TWO, lane * _BUCKETS, lane * (_BUCKETS + 1)
        self.one, self.two = np.zeros(lanes * _ONE, np.int32), np.zeros(lanes * _TWO, np.int32)
        # weights of orders 0, 1 and 2, in 65536ths
        self.weights = np.full(lanes, 1 << 13, np.int32), np.full(lanes, 1 << 15, np.int32), np.full(lanes, 1 << 15, np.int32)
        self.seen = np.tile(8 * prior.share + 1, (lanes, 1))
        self._cumulate()

    def _cumulate(self) -> None:
        """The buckets' counts to cumulative frequencies, each frequency 1 at least."""
        share = self.seen * (_TOTAL - _BUCKETS) // self.seen.sum(1, keepdims=True, dtype=np.int32) + 1
        sums = np.zeros((len(share), _BUCKETS + 1), np.int32)
        np.cumsum(share, 1, out=sums[:, 1:])
        sums[:, -1] = _TOTAL
        self.cumulative = sums.ravel()

    def refresh(self, recent: np.ndarray) -> None:
        """Takes in the buckets of the last steps; older ones fade."""
        self.seen += 8 * np.bincount((recent + self.buckets).ravel(), minlength=self.seen.size).astype(np.int32).reshape(self.seen.shape)
        self.seen -= self.seen >> 5
        self._cumulate()

    def contexts(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the last id, and of the last two."""
        one = (last * np.int32(0x9E35) >> 3) & np.int32(_ONE - 1)
        two = ((last * np.int32(0x2F0B5) ^ before * np.int32(0x1D4E7)) >> 4) & np.int32(_TWO - 1)
        return one + self.slots1, two + self.slots2

    def predict(self, at1: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The favoured guess and the probability in 65536ths that it is right."""
        self.at1, self.at2 = at1, at2
        self.s1, self.s2 = s1, s2 = self.one.take(at1), self.two.take(at2)
        self.c1, self.c2 = c1, c2 = s1 & 15, s2 & 15
        self.g1, self.g2 = g1, g2 = s1 >> 4, s2 >> 4
        x1, x2 = _SAYS.take(c1), _SAYS.take(c2)
        second = c2 > 0
        guess = np.where(second, g2, g1)
        x1 *= g1 == guess  # another guess says nothing of the favoured one
        self.inputs = self.odds.take(guess), x1, x2
        dot = self.weights[1] * x1
        dot += self.weights[2] * x2
        dot += self.weights[0] * self.inputs[0]
        dot >>= 16
        dot += _WIDE
        return guess, _SQUASH.take(dot, mode="clip")

    def learn(self, ids: np.ndarray, hit: np.ndarray, p: np.ndarray) -> None:
        error = hit * np.int32(65535)
        error -= p
        error >>= 4
        for weight, x in zip(self.weights, self.inputs):
            x *= error
            x >>= 14
            weight += x
        fresh = ids << 4
        fresh |= 1
        # a frequent order-1 guess outlives a miss, by half its confidence; an order-2 guess doesn't
        same = (self.g1 == ids).view(np.int8)
        same <<= 4
        change = self.c1 | same
        s = self.s1
        s += _CHANGE.take(change)
        s ^= fresh
        s *= _OUTLIVES.take(change)
        s ^= fresh
        self.one[self.at1] = s
        s = self.s2
        s += self.c2 < _MOST
        self.two[self.at2] = _chosen(self.g2 == ids, s, fresh)


def _chosen(here: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """What ``np.where`` gives, without a branch for each element; overwrites ``no``."""
    no ^= yes
    no *= ~here
    no ^= yes
    return no


def _unsettled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose range is small, or whose first 16 bits no longer change."""
    return np.flatnonzero((span < _TOP) | ((low ^ (low + span)) < _TOP))


def _shift(low: np.ndarray, span: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Take the first 16 bits off the live lanes, and return those that aren't done."""
    l, s = low.take(live), span.take(live)
    cut = np.flatnonzero((l ^ (l + s)) >= _TOP)
    s[cut] = (~l[cut] + np.uint64(1)) & _MASK  # a carry may not pass: the range is cut
    l <<= _U16
    s <<= _U16
    low[live], span[live] = l, s
    return live.take(_unsettled(l, s))


def _transpose(rows: np.ndarray, out: np.ndarray) -> None:
    """Columns of ``rows`` to rows of ``out``, in parts whose lines stay in the cache."""
    for a in range(0, rows.shape[0], 64):
        for b in range(0, rows.shape[1], 1024):
            out[b:b + 1024, a:a + 64] = rows[a:a + 64, b:b + 1024].T


def _encode_lanes(numbers: np.ndarray, prior: _Prior) -> list[bytes]:
    """Rows of ids of one length, by their numbers in the prior, each coded on its own."""
    lanes, steps = numbers.shape
    model, bits = _Model(lanes, prior), np.uint64(prior.bits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    width = steps // 2 + 4 * _REFRESH
    out, base = np.zeros((lanes, width), np.uint16), np.arange(lanes) * width
    filled = base.copy()
    rows = np.zeros((steps + 2, lanes), np.int32)
    _transpose(numbers, rows[2:])
    all_starts, all_freqs = prior.start.astype(np.uint64), prior.freq.astype(np.uint64)
    for a in range(0, steps, _REFRESH):
        part_of = rows[a + 2:a + 2 + _REFRESH]
        n = len(part_of)
        ones, twos = model.contexts(rows[a + 1:a + 1 + n], rows[a:a + n])
        recent = prior.bucket.take(part_of)
        at = recent + model.sums
        below = model.cumulative.take(at)
        wide, below = (model.cumulative.take(at + 1) - below).astype(np.uint64), below.astype(np.uint64)
        start, freq = all_starts.take(part_of), all_freqs.take(part_of)
        for k, now in enumerate(part_of):
            guess, p = model.predict(ones[k], twos[k])
            hit = now == guess
            unit = span >> _U16
            part = unit * p.astype(np.uint64)
            unit = (unit << _U16) - part >> _U12
            each = unit * wide[k] >> bits
            unit *= below[k]
            unit += part
            unit += each * start[k]
            unit *= ~hit
            low += unit
            each *= freq[k]
            span = _chosen(hit, part, each)
            live = _unsettled(low, span)
            while len(live):
                to = filled.take(live)
                out.reshape(-1)[to] = (low.take(live) >> _U48).astype(np.uint16)
                to += 1
                filled[live] = to
                live = _shift(low, span, live)
            model.learn(now, hit, p)
        model.refresh(recent)
        filled -= base
        if filled.max() + 4 * _REFRESH > width:  # 3 units an id at most
            out = np.concatenate([out, np.zeros((lanes, steps // 2 + 4 * _REFRESH), np.uint16)], 1)
            width = out.shape[1]
            base = np.arange(lanes) * width
        filled += base
    out = out.reshape(-1)
    for k in range(4):
        out[filled + k] = (low >> _U48).astype(np.uint16)
        low = low << _U16
    return [out[a:b].astype("<u2").tobytes() for a, b in zip(base.tolist(), (filled + 4).tolist())]


def _decode_lanes(coded: list[bytes], steps: int, prior: _Prior, lookup: np.ndarray) -> np.ndarray:
    lanes = len(coded)
    longest = max(map(len, coded)) // 2 + 8
    words = np.zeros((lanes, longest), np.uint16)
    for k, x in enumerate(coded):
        words[k, :len(x) // 2] = np.frombuffer(x, "<u2", len(x) // 2)
    words, base = words.ravel(), np.arange(lanes) * longest
    model, bits, within = _Model(lanes, prior), np.uint64(prior.bits), np.uint64((1 << prior.bits) - 1)
    start, freq = prior.start.astype(np.uint64), prior.freq.astype(np.uint64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    code, read, end = np.zeros(lanes, np.uint64), base + 4, base + longest - 1
    for k in range(4):
        code = code << _U16 | words[base + k].astype(np.uint64)
    numbers = np.empty((steps, lanes), np.int32)
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for step in range(steps):
        if step % _REFRESH == 0:
            if step:
                model.refresh(prior.bucket[numbers[step - _REFRESH:step]])
            tops = np.ascontiguousarray(model.cumulative.reshape(lanes, -1)[:, 1:].T).astype(np.int16)
        guess, p = model.predict(*model.contexts(last, before))
        unit = span >> _U16
        part = unit * p.astype(np.uint64)
        beyond = code - low
        hit = beyond < part
        beyond -= part
        unit = (unit << _U16) - part >> _U12
        place = np.minimum(beyond // unit, np.uint64(_TOTAL - 1)).astype(np.int16)
        bucket = (tops <= place).view(np.int8).sum(0, dtype=np.int8).astype(np.int64)
        at = bucket + model.sums
        below = model.cumulative.take(at)
        each = unit * (model.cumulative.take(at + 1) - below).astype(np.uint64) >> bits
        unit *= below.astype(np.uint64)
        beyond -= unit
        found = lookup.take((bucket << prior.bits) + np.minimum(beyond // each, within).astype(np.int64))
        unit += part
        unit += each * start.take(found)
        unit *= ~hit
        low += unit
        each *= freq.take(found)
        span = _chosen(hit, part, each)
        now = _chosen(hit, guess, found)
        live = _unsettled(low, span)
        while len(live):
            at = read.take(live)
            code[live] = code.take(live) << _U16 | words.take(np.minimum(at, end.take(live))).astype(np.uint64)
            at += 1
            read[live] = at
            live = _shift(low, span, live)
        numbers[step] = now
        model.learn(now, hit, p)
        before, last = last, now
    out = np.empty((lanes, steps), np.int32)
    _transpose(numbers, out)
    return out


_HEAD = "<4sIIIQI"


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, each id's number among them, and their counts."""
    if ids.max() >= 1 << 22:  # a table of all ids up to the largest would be large
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[ids], counts[distinct]


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids of 32 bits to bytes: a header with the prior, each block's size and checksum, the blocks.

    All blocks have one length; the last is filled up with the first id's number 0.
    """
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 2**32):
        raise ValueError("ids: 0 to 2 ** 32 - 1")
    count = -(-len(ids) // BLOCK_IDS)
    steps = -(-len(ids) // count) if count else 0
    blocks: list[bytes] = []
    sums: list[int] = []
    packed = b""
    if count:
        distinct, numbers, counts = _numbered(ids)
        prior = _Prior.of(distinct, counts)
        packed = prior.pack()
        grid = np.zeros(count * steps, np.int32)
        grid[:len(ids)] = numbers
        grid = grid.reshape(count, steps)
        own = prior.ids.astype("<u4")
        for k in range(0, count, LANES):
            blocks += _encode_lanes(grid[k:k + LANES], prior)
            sums += [zlib.crc32(x) for x in own.take(grid[k:k + LANES])]
    head = struct.pack(_HEAD, MAGIC, VERSION, steps, len(packed), len(ids), zlib.crc32(packed))
    table = np.array([[len(x), c] for x, c in zip(blocks, sums)], "<u4").tobytes()
    return b"".join([head, packed, table, *blocks])


def decode_ids(data: bytes) -> np.ndarray:
    """What ``encode_ids`` was given, as 4-byte little endian; raises ValueError if a header or a block's checksum is wrong."""
    magic, version, steps, size, total, check = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    if magic != MAGIC or version != VERSION or (steps == 0) != (total == 0) or zlib.crc32(data[at:at + size]) != check:
        raise ValueError("not a token file of this version")
    if not total:
        return np.zeros(0, "<u4")
    prior = _Prior.unpack(data[at:at + size])
    count = -(-total // BLOCK_IDS)
    table = np.frombuffer(data, "<u4", 2 * count, at + size).reshape(count, 2)
    cuts = np.cumsum(np.append(at + size + 8 * count, table[:, 0].astype(np.int64)))
    blocks = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    lookup, own, out = prior.lookup(), prior.ids.astype("<u4"), np.empty((count, steps), "<u4")
    for k in range(0, count, LANES):
        np.take(own, _decode_lanes(blocks[k:k + LANES], steps, prior, lookup), out=out[k:k + LANES], mode="clip")
    for k, (block, check) in enumerate(zip(out, table[:, 1].tolist())):
        if zlib.crc32(block) != check:
            raise ValueError(f"block {k}: wrong checksum")
    return out.reshape(-1)[:total]


#: Kinds of bytes: 0 white space, 1 ASCII letters, 2 ASCII digits, 3 ASCII marks, 4 all that may stick to its neighbours.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[ord("'")], _KIND[list(common.SPACES)] = 2, 1, 1, 4, 0


#: The steps before the model for which texts may be cut into such parts; files with others are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte at the library's byte level: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class Tokenizer:
    """The tokenizers library, asked once for each word.

    The file's pre-tokenizer leaves white space out and parts ASCII letters, digits and marks (the apostrophe
    aside, which can go either way), so ids of a text are those of such parts of it in turn.
    """

    @staticmethod
    def _parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all parts, and each row's first."""
        if not len(raw):
            return common.words(raw, offsets)
        kind = _KIND[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] < 4) & (kind[:-1] < 4)
        edge[1:-1] |= (kind[1:] == 0) != (kind[:-1] == 0)
        inside = kind > 0
        starts = np.flatnonzero(inside & edge[:-1])
        return starts, np.flatnonzero(inside & edge[1:]) + 1, np.searchsorted(starts, offsets)

    def __init__(self, data: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(data)
        self.library.encode_special_tokens = True
        self.end = end
        own = json.loads(data)
        self.by_words = (own["normalizer"], own["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self._clear()

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """The library's ids of words; words of plain lower-case letters go to its model at once."""
        found: list[list[int] | None] = []
        other, tokenize = [], self.library.model.tokenize
        for word in words:
            if word.isalpha():  # ASCII letters, which stand for themselves; A-Z are lower-cased before
                found.append([x.id for x in tokenize(word.decode("ascii"))])
                continue
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0250" and text == text.lower():  # Latin letters: normal forms as they are
                found.append([x.id for x in tokenize(word.decode("latin-1").translate(BYTE_LETTERS))])
            else:
                other.append(text)
                found.append(None)
        rest = iter(self.library.encode_batch_fast(other, add_special_tokens=False) if other else ())
        return [next(rest).ids if x is None else x for x in found]

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # the number of a word; no word has number 0
        self.low, self.high, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int8)  # 0 for words that are in no slot
        self.count = self.used = 0
        self._add([[self.end]])  # number 0 stands for the end of a text

    def _add(self, found: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(found) > len(self.begin):
            self.begin, self.length, self.low, self.high, self.size = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.low, self.high, self.size))
        self.ids[self.used:self.used + len(flat)] = flat
        at = slice(self.count, self.count + len(found))
        self.length[at] = lengths
        self.begin[at] = self.used + np.cumsum(lengths) - lengths
        self.used, self.count = self.used + len(flat), self.count + len(found)

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of UTF-8 rows, each row followed by the end id; and the number of each row's ids."""
        if not self.by_words:
            return self._whole_rows(raw, offsets)
        if self.count > CACHE_WORDS:
            self._clear()
        raw = common.LOWER[raw]  # as the file's normalizer does
        starts, ends, first = self._parts(raw, offsets)
        numbers = np.insert(self._numbers(raw, starts, ends), first[1:], 0)
        lengths = self.length[numbers]
        after = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.begin[numbers] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]
        lasts = after[first[1:] + np.arange(len(offsets) - 1)]
        return ids, np.diff(lasts, prepend=0)

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word.  A word of up to 16 bytes is compared, as two integers, with the last one met in its slot."""
        hashes, lengths = common.plain_hashes(raw, starts, ends), ends - starts
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        low, high = common.word_integers(padded, starts, lengths), np.zeros(len(starts), np.uint64)
        over = np.flatnonzero(lengths > 8)
        high[over] = common.word_integers(padded, starts[over], lengths[over], 1)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        numbers = self.slots.take(slots)
        other = self.low.take(numbers) != low
        other |= self.high.take(numbers) != high
        other |= self.size.take(numbers) != lengths
        other = np.flatnonzero(other)
        if not len(other):
            return numbers
        # the rest are grouped by their hash; each distinct one is looked up once, those that only share its hash on their own
        starts, ends = starts[other], ends[other]
        _, one, back = np.unique(hashes[other], return_index=True, return_inverse=True)
        strange = _unlike(raw, starts, ends, one[back])
        if len(strange):
            back[strange] = len(one) + np.arange(len(strange))
            one = np.concatenate([one, strange])
        data, known, new, total = raw.tobytes(), self.known, [], self.count
        of_distinct = np.empty(len(one), np.int32)
        for k, (a, b) in enumerate(zip(starts[one].tolist(), ends[one].tolist())):
            word = data[a:b]
            number = known.get(word)
            if number is None:
                number = known[word] = total + len(new)
                new.append(word)
            of_distinct[k] = number
        if new:
            self._add(self._ids(new))
        short = np.flatnonzero(lengths[other[one]] <= 16)
        at, number = other[one[short]], of_distinct[short]
        self.low[number], self.high[number], self.size[number] = low[at], high[at], lengths[at]
        self.slots[slots[at]] = number
        numbers[other] = of_distinct[back]
        return numbers

    def _whole_rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library on whole texts, for files that cut texts in another way."""
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found = [np.array([*x.ids, self.end], np.int64) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.int64), np.array([len(x) for x in found], np.int64)


def _unlike(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Words whose bytes differ from those of word ``model[k]``."""
    lengths = ends - starts
    differ = lengths != lengths[model]
    kept = np.flatnonzero(~differ & (model != np.arange(len(starts))))
    lengths = lengths[kept]
    own = np.repeat(starts[kept] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    wrong = np.flatnonzero(raw[own] != raw[own + np.repeat(starts[model[kept]] - starts[kept], lengths)])
    if len(wrong):
        differ[kept[np.searchsorted(np.cumsum(lengths), wrong, side="right")]] = True
    return np.flatnonzero(differ)


_TOKENIZERS: dict[tuple[int, int], Tokenizer] = {}


def _tokenizer(data: str, end: int) -> Tokenizer:
    key = (zlib.crc32(data.encode()), end)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(data, end)
    return _TOKENIZERS[key]


def write(docs: DataFrame, tokenizer_path: str, to: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Segments of token ids in ascending id order (a null id first), each document followed by ``end_id``.

    Null texts count as empty; rows that repeat an id stand side by side, in the order of a hash of their texts; other
    columns are not read.
    Columns: ``file`` and ``segment`` (their order is the ids'), ``doc_ids`` and ``counts`` (8-byte little
    endian, the least long for a null id), ``data`` (see ``encode_ids``).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read((64 << 20) + 1)
    if len(text) > 64 << 20:
        raise ValueError(f"{tokenizer_path}: over 64 MB")
    sent = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_freed_memory()
        own = _tokenizer(sent.value, end_id)
        names, counts, parts, held, number = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [[number], [np.concatenate(names).astype("<i8").tobytes()], [np.concatenate(counts).astype("<i8").tobytes()], [len(ids)], [encode_ids(ids)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["segment", "doc_ids", "counts", "tokens", "data"])

        for batch in batches:
            names_here = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            raw, offsets = common.string_buffers(batch.column(1))
            for a, b in common.slices(offsets, SCAN_BYTES):
                ids, lengths = own.encode_rows(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                names.append(names_here[a:b])
                counts.append(lengths)
                parts.append(ids)
                held += len(ids)
                if held >= SEGMENT_IDS:
                    yield segment()
                    names, counts, parts, held, number = [], [], [], 0, number + 1
        if parts:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.col("hash")  # rows of one id, the null one among them, may fill many ranges
    ordered = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("hash")
    ordered.mapInArrow(run, "segment long, doc_ids binary, counts binary, tokens long, data binary").withColumn(
        "file", F.spark_partition_id()).write.parquet(to)


def read(docs_spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the files, from decoded ids."""
    files = docs_spark.read.parquet(path)
    # a row a segment: their tokens are summed up without reading the blocks
    before = files.select("file", "segment", "tokens").withColumn("start", F.sum("tokens").over(Window.orderBy("file", "segment")) - F.col("tokens")).drop("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_freed_memory()
        for batch in batches:
            for row in range(len(batch)):
                names, counts, start, data = (batch.column(k)[row].as_py() for k in range(4))
                names, counts, ids = np.frombuffer(names, "<i8"), np.frombuffer(counts, "<i8"), decode_ids(data)
                after = np.cumsum(counts)
                raw = memoryview(ids).cast("B") if len(ids) else b""
                sums = [zlib.crc32(raw[4 * (b - c):4 * b]) for b, c in zip(after.tolist(), counts.tolist())]
                least = names == -(2**63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=least), pa.array(start + after - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(before, ["file", "segment"]).select("doc_ids", "counts", "start", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
