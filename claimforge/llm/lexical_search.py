"""Ranked lexical search over a tiered index.

The index is cut into segments of documents, each an inverted index of its own for all its terms.  A term's
postings are ordered by impact and cut into tiers: the first tenth and a few at least, the rest down to a third,
and all others; beyond each tier the segment keeps the largest impact that is left, the term's residual bound.

A search adds up the first tier.  The fiftieth best sum is a floor of the result; where the residual bounds of an
item's terms together stay below it in every segment, no document that the tiers read so far don't show can be
among the best: the item is proven.  Items without that proof go on to the next tier with a floor that has risen,
the last tier being all there is.  Then documents whose sum and bounds reach the floor get exact scores.

Scores are integers: a term's weight times what its share in a document is worth (``worth``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimforge.llm import common

#: Bytes of text and documents of a segment, at most; a longer text is a segment of its own.  Segments are rows: a heap of a
#: few GB holds rows of some 100 KB well, and fills up with rows of megabytes.
SEGMENT_BYTES, SEGMENT_DOCS = 160 << 10, 4096
#: Bytes of a row group of the index: a writer holds one in memory.
ROW_GROUP = 16 << 20
#: Bytes of rows that a task gets at once; more of rows as large as segments would fill executors' memory beside the heap.
BATCH = "4m"
#: Share of a term's postings in a segment that the tiers before the last end at, and how many the first holds at least.
SHARES, FEWEST = (0.1, 0.35), 4
TIERS = len(SHARES) + 1
#: Documents of an item's result.
TOP = 50
#: Items that are searched for at once, and sums that are worked out at once.
ITEMS, SUMS = 512, 1 << 19

#: Bytes of terms: digits, letters, and whatever isn't ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
_WEIGHTS = common.byte_weights(IS_TERM)

_PARTS = ["terms", "ends", "hashes", "df"]
_TIER_PARTS = ["rest", "doc", "q"]
INDEX_SCHEMA = ", ".join(["docs array<long>", *(f"{x} binary" for x in _PARTS), *(f"{x}{k} binary" for k in range(TIERS) for x in _TIER_PARTS)])


def worth(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What ``tf`` occurrences among a document's ``n`` terms are worth, below 1,000,000."""
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Index:
    """Where segments are, and how many documents with terms and terms they hold."""

    path: str
    documents: int
    terms: int


def build_index(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document of ``docs`` in the folder ``to``; a null text has no terms.

    Two scans: the first counts documents and terms, which impacts depend on; no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for _, raw, offsets in common.scan_rows(batches, 1, SEGMENT_BYTES):
            n = np.diff(common.words(raw, offsets, IS_TERM)[2])
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])

    with common.small_batches(docs.sparkSession, BATCH):
        size = rows.mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = size[0] or 0, size[1] or 0

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in common.scan_rows(batches, 1, SEGMENT_BYTES):
            for a in range(0, len(offsets) - 1, SEGMENT_DOCS):
                at = offsets[a:a + SEGMENT_DOCS + 1]
                yield _segment(batch.column(0).slice(a, len(at) - 1), raw[at[0]:at[-1]], at - at[0], documents, terms)

    with common.small_batches(docs.sparkSession, BATCH):
        rows.mapInArrow(segments, INDEX_SCHEMA).write.option("parquet.block.size", ROW_GROUP).parquet(to)
    return Index(to, documents, terms)


def _depths(df: np.ndarray) -> list[np.ndarray]:
    """How many of a term's ``df`` postings each tier ends at; with ``df`` it tells where everything is, so nothing else is stored."""
    return [np.minimum(df, np.maximum(FEWEST, np.ceil(df * share).astype(np.int64))) for share in SHARES] + [df]


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of words one after the other."""
    ends = np.cumsum(sizes)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _segment(ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    raw = common.LOWER[raw]
    starts, stops, first = common.words(raw, offsets, IS_TERM)
    n = np.diff(first)
    of_doc = np.repeat(np.arange(len(n)), n)
    hashes = common.word_hashes(raw, starts, _WEIGHTS)
    order = np.argsort(hashes, kind="stable")
    sizes = (stops - starts)[order]
    text = _gather(raw, starts[order], sizes)
    hashes, of_doc = hashes[order], of_doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    if not _same_bytes(text, sizes, fresh):  # two terms of one hash: in the order of their bytes
        data, ends = text.tobytes(), np.cumsum(sizes)
        words = [data[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]
        again = np.array(sorted(range(len(words)), key=lambda k: (hashes[k], words[k], k)), np.int64)
        words = [words[k] for k in again]
        hashes, of_doc, sizes = hashes[again], of_doc[again], sizes[again]
        text = np.frombuffer(b"".join(words), np.uint8)
        fresh = np.array([True, *(x != y for x, y in zip(words[1:], words[:-1]))], bool)
    heads = np.flatnonzero(fresh)
    ends = np.cumsum(sizes)
    terms_ = _gather(text, (ends - sizes)[heads], sizes[heads])
    posting = fresh.copy()
    posting[1:] |= of_doc[1:] != of_doc[:-1]
    at = np.flatnonzero(posting)
    tf = np.diff(np.append(at, len(order)))
    doc, of_term = of_doc[at], np.cumsum(fresh)[at] - 1
    q = worth(tf, n[doc], documents, max(terms, 1))
    df = np.bincount(of_term, minlength=len(heads)) if len(heads) else np.zeros(0, np.int64)
    order = np.lexsort((doc, -q, of_term))
    doc, q = doc[order], q[order]
    begin = np.cumsum(df) - df
    rank = np.arange(len(q)) - np.repeat(begin, df)
    parts = terms_, np.cumsum(sizes[heads]).astype(np.int32), hashes[heads], df.astype(np.uint16)
    columns = [pa.array([ids.cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
    low = np.zeros(len(df), np.int64)
    for high in _depths(df):
        kept = (rank >= np.repeat(low, df)) & (rank < np.repeat(high, df))
        rest = q[(begin + high)[high < df]]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (rest.astype(np.int32), doc[kept].astype(np.uint16), q[kept].astype(np.int32))]
        low = high
    return pa.RecordBatch.from_arrays(columns, ["docs", *_PARTS, *(f"{x}{k}" for k in range(TIERS) for x in _TIER_PARTS)])


def _same_bytes(text: np.ndarray, sizes: np.ndarray, fresh: np.ndarray) -> bool:
    """Whether each word that isn't ``fresh`` has the bytes of the word before it."""
    if (~fresh[1:] & (sizes[1:] != sizes[:-1])).any():
        return False
    again = np.flatnonzero(np.repeat(~fresh, sizes))
    return bool((text[again] == text[again - np.repeat(sizes, sizes)[again]]).all())


class _Block:
    """Items that are searched for at once: their terms, and the items of each term."""

    def __init__(self, items: list[tuple]):
        self.ids = [key for key, _ in items]
        of: dict[bytes, list[int]] = {}
        for k, (_, terms) in enumerate(items):
            for term in terms:
                of.setdefault(term, []).append(k)
        self.terms = list(of)
        self.degree = np.array([len(x) for x in of.values()], np.int64)
        self.begin = np.cumsum(self.degree) - self.degree
        self.items = np.array([k for x in of.values() for k in x], np.int64)
        raw = np.frombuffer(b"\n".join(self.terms), np.uint8)
        self.hashes = common.word_hashes(raw, common.words(raw, np.array([0, len(raw)]), IS_TERM)[0], _WEIGHTS)
        self.weight = np.zeros(len(self.terms), np.int64)

    def spread(self, asked: np.ndarray, values: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
        """Add each value, one of a term's, to the sums of all items of that term, at its place."""
        count = self.degree[asked]
        ends = np.cumsum(count)
        a = 0
        while a < len(asked):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SUMS, side="right")))
            c = count[a:b]
            total = np.cumsum(c)
            item = self.items[np.arange(int(total[-1])) + np.repeat(self.begin[asked[a:b]] - (total - c), c)]
            np.add.at(out, (item, np.repeat(places[a:b], c)), np.repeat(values[a:b], c))
            a = b


class _Segment:
    """A row of the index, as far as it was read, seen by a block of items."""

    def __init__(self, batch: pa.RecordBatch, row: int, block: _Block):
        self.row = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
        self.block = block
        self.df = self.array("df", np.uint16)
        self.depths = _depths(self.df)
        self._find()

    def array(self, name: str, kind=np.int32) -> np.ndarray:
        return np.frombuffer(self.row[name].as_py(), kind).astype(np.uint64 if kind is np.uint64 else np.int64, copy=False)

    def _find(self) -> None:
        """Which asked terms this segment holds, compared byte by byte."""
        hashes, ends, terms = self.array("hashes", np.uint64), self.array("ends"), self.row["terms"].as_py()
        at = np.searchsorted(hashes, self.block.hashes)
        asked, own = [], []
        likely = np.flatnonzero(at < len(hashes))
        likely = likely[hashes[at[likely]] == self.block.hashes[likely]]
        for a in likely.tolist():
            k = int(at[a])
            while k < len(hashes) and hashes[k] == self.block.hashes[a]:
                if terms[int(ends[k - 1]) if k else 0:int(ends[k])] == self.block.terms[a]:
                    asked.append(a)
                    own.append(k)
                    break
                k += 1
        self.asked, self.own = np.array(asked, np.int64), np.array(own, np.int64)

    def postings(self, tier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a tier: the asked term, its place among those found, document and worth of each posting."""
        held = self.depths[tier] - (self.depths[tier - 1] if tier else 0)
        count, start = held[self.own], (np.cumsum(held) - held)[self.own]
        ends = np.cumsum(count)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)
        place = np.repeat(np.arange(len(count)), count)
        return self.asked[place], place, self.array(f"doc{tier}", np.uint16)[index], self.array(f"q{tier}")[index]

    def rest(self, tier: int) -> np.ndarray:
        """The residual bound of each term found: what its best posting beyond a tier may bring."""
        more = self.depths[tier] < self.df
        out = np.zeros(len(self.own), np.int64)
        open_ = more[self.own]
        out[open_] = self.array(f"rest{tier}")[(np.cumsum(more) - 1)[self.own[open_]]]
        return self.block.weight[self.asked] * out

    def sums(self, tiers: range, only: np.ndarray | None = None) -> np.ndarray:
        """What documents have from some tiers, a row an item; ``only`` says which documents are of interest."""
        out = np.zeros((len(self.block.ids), len(self.row["docs"])), np.int64)
        for tier in tiers:
            asked, _, doc, q = self.postings(tier)
            if only is not None:
                kept = only[doc]
                asked, doc, q = asked[kept], doc[kept], q[kept]
            self.block.spread(asked, self.block.weight[asked] * q, doc, out)
        return out

    def residual(self, tier: int) -> np.ndarray:
        """What the terms of each item may still bring beyond a tier."""
        out = np.zeros((len(self.block.ids), 1), np.int64)
        self.block.spread(self.asked, self.rest(tier), np.zeros(len(self.own), np.int64), out)
        return out[:, 0]

    def seen(self, tier: int) -> np.ndarray:
        """What documents can't have beyond a tier, as the tiers so far showed them the terms."""
        out = np.zeros((len(self.block.ids), len(self.row["docs"])), np.int64)
        rest = self.rest(tier)
        for k in range(tier + 1):
            asked, place, doc, _ = self.postings(k)
            self.block.spread(asked, rest[place], doc, out)
        return out


def _columns(tiers: int) -> list[str]:
    return ["docs", *_PARTS, *(f"{x}{k}" for k in range(tiers) for x in _TIER_PARTS)]


def _segments(batches: Iterator[pa.RecordBatch], block: _Block) -> Iterator[_Segment]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Segment(batch, row, block)


def search(spark: SparkSession, index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``top`` documents of each row of ``items``, those with a score above 0.

    Equal scores go by ascending doc_id, a null one last.  Repeated items and documents are rows of their own.  Items without
    terms, null ones too, have no result.  Items are taken in blocks of ``ITEMS``, whose distinct terms the driver holds.
    """
    with common.small_batches(spark, BATCH):
        blocks, waiting = [], []
        for row in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
            raw = common.LOWER[np.frombuffer((row[1] or "").encode("utf-8"), np.uint8)]
            starts, stops, _ = common.words(raw, np.array([0, len(raw)]), IS_TERM)
            data = raw.tobytes()
            if len(starts):
                waiting.append((row[0], {data[a:b] for a, b in zip(starts.tolist(), stops.tolist())}))
            if len(waiting) == ITEMS:
                blocks.append(_search_block(spark, index, _Block(waiting), top))
                waiting = []
        if waiting or not blocks:
            blocks.append(_search_block(spark, index, _Block(waiting), top))
    found = blocks[0]
    for other in blocks[1:]:
        found = found.unionByName(other)
    return found


def _search_block(spark: SparkSession, index: Index, block: _Block, top: int) -> DataFrame:
    rows = spark.read.schema(INDEX_SCHEMA).parquet(index.path)
    context = spark.sparkContext
    first = context.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(first.value.terms), np.int64)
        for segment in _segments(batches, first.value):
            df[segment.asked] += segment.df[segment.own]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    for term, df in rows.select(_columns(0)).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        block.weight[term] = weight(df, index.documents)
    known = context.broadcast(block)
    floor, level = np.zeros(len(block.ids), np.int64), np.full(len(block.ids), TIERS - 1)
    for tier in range(TIERS - 1):
        open_ = np.flatnonzero(level == TIERS - 1)
        if not len(open_):
            break
        sums, rests = _scan_tier(rows, known, tier, open_, top)
        floor[open_] = np.maximum(floor[open_], sums)
        level[open_[rests < np.maximum(floor[open_], 1)]] = tier
    return _exact(rows, known, floor, level, top)


def _scan_tier(rows: DataFrame, known, tier: int, open_: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the items that are still open: the ``top``-th best sum so far, and the most that an unseen document may have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rest = np.zeros((len(open_), top), np.int64), np.zeros(len(open_), np.int64)
        for segment in _segments(batches, known.value):
            sums = segment.sums(range(tier + 1))[open_]
            best = np.partition(np.concatenate([best, sums], 1), -top, 1)[:, -top:]
            rest = np.maximum(rest, segment.residual(tier)[open_])
        item, place = np.nonzero(best)
        item, value = np.concatenate([item, np.arange(len(open_))]), np.concatenate([best[item, place], -rest - 1])  # bounds are below 0
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(value)], ["item", "value"])

    found = rows.select(_columns(tier + 1)).mapInArrow(scan, "item long, value long").checkpoint()
    rest, floor = np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
    for item, value in found.where("value < 0").groupBy("item").agg(F.max(-F.col("value") - 1)).collect():
        rest[item] = value
    sums = found.where("value > 0").select("item", "value", F.monotonically_increasing_id().alias("id"))
    for item, value in _best(sums, top, ["item"], [F.desc("value"), F.col("id")]).where(F.col("rank") == top).select("item", "value").collect():
        floor[item] = value
    return floor, rest


def _best(rows: DataFrame, top: int, by: list[str], order: list) -> DataFrame:
    """The first ``top`` rows of each group with their ``rank``; in two steps, so no task gets what all tasks found."""
    some = Window.partitionBy(*by, F.pmod(F.xxhash64(*rows.columns), F.lit(64))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def _exact(rows: DataFrame, known, floor: np.ndarray, level: np.ndarray, top: int) -> DataFrame:
    """Scores of the documents that can reach each item's floor, by what the tiers up to its level say."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = known.value, np.maximum(floor, 1)[:, None]
        best: list[list[tuple]] = [[] for _ in block.ids]
        for segment in _segments(batches, block):
            docs = segment.row["docs"].as_py()
            scores, may = np.zeros((len(block.ids), len(docs)), np.int64), np.zeros((len(block.ids), len(docs)), bool)
            for tier in sorted(set(level.tolist())):
                own = (level == tier)[:, None]
                so_far = segment.sums(range(tier + 1))
                most = so_far if tier == TIERS - 1 else so_far + segment.residual(tier)[:, None] - segment.seen(tier)
                reach = own & (most >= least)
                if tier < TIERS - 1 and reach.any():
                    so_far = so_far + segment.sums(range(tier + 1, TIERS), reach.any(0))
                scores, may = np.where(own, so_far, scores), may | reach
            may &= scores >= least
            for item in np.flatnonzero(may.any(1)).tolist():
                place = np.flatnonzero(may[item])
                best[item] += [(-score, docs[k] is None, docs[k] or 0) for k, score in zip(place.tolist(), scores[item, place].tolist())]
                if len(best[item]) > top:
                    best[item] = sorted(best[item])[:top]
        out = [(k, block.ids[k], None if null else doc, -score) for k, found in enumerate(best) for score, null, doc in found]
        kinds = ("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    found = rows.select(_columns(TIERS)).mapInArrow(scan, "item long, item_id long, doc_id long, score long").withColumn("id", F.monotonically_increasing_id()).checkpoint()
    ranked = _best(found, top, ["item"], [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("id")])
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index all documents in the shared folder, and search for all items."""
    index = build_index(docs, common.shared_path(docs, "index"))
    return search(docs.sparkSession, index, items, top=top)
