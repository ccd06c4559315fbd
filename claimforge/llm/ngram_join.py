"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact at any size.

A document is its set of distinct word shingles.  Two documents link when
``100 * |intersection| >= threshold * |union|``.  The plan:

1. *Document frequencies.*  Shingle hashes go to key ranges as packed blobs, one for each run of
   documents and range.  Only a shingle of two or more documents can be in an intersection, so
   each range sends back just those, with their frequency.
2. *Survivors.*  A document with too few shared shingles to reach the threshold with anybody links
   with nothing.  Of the rest, documents with equal sets are one class, met by its smallest id.
3. *Prefixes.*  In order of (frequency, hash), documents that link share a shingle of their first
   ``n - ceil(threshold * n) + 1``.  Components of "shares a prefix shingle" are closed under links.
4. *Search.*  Each such component is searched in cells of bounded size: inverted lists, of which
   DivideSkip merges the short ones and probes the long ones.  A component larger than a block is cut
   into bands of set sizes, since sizes of documents that link differ by a factor at most, and bands into
   blocks; pairs of cells of the same or of neighbouring bands are searched, so no task holds more than
   two.  A search leaves out partners that are already connected, so copies of copies aren't expanded into pairs.

Hot keys: a frequent shingle is last in every prefix; a large group of copies is one class, combined
before the shuffle; a large group of near copies is split into blocks.

Shingles are told apart by 64-bit hashes, of which those of other documents are compared by 48 bits
and their key range: two different shingles of a pair of documents pass for equal with a chance of
less than 2 ** -48 for each pair of shingles that is compared.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import common
from claimforge.operators.components import connected_components
from claimforge.session import ensure_checkpoint_dir

#: Bytes of text whose shingles are sent together.
RUN_BYTES = 8 << 20
#: Bytes of text that are hashed at once.
SCAN_BYTES = 1 << 20
#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = 4 << 20
#: Bytes of input for each key range.
RANGE_BYTES = 8 << 20
#: Documents of a block of the search.
BLOCK = 1024
#: Lists whose total length is over this are merged by numpy's sort of runs instead of a heap in Python.
HEAP_MOST = 512

_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; A-Z count as a-z."""
    raw = common.LOWER[raw]
    starts, _, first = common.words(raw, offsets)
    hashed = common.word_hashes(raw, starts)
    if len(hashed) >= width:
        n = len(hashed) - width + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = rolled * _MULTIPLY + hashed[k:k + n]
        rolled = common.mix(rolled)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            sets.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = common.mix(whole * _MULTIPLY + hashed[k:k + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _run_name(ids: np.ndarray, n: np.ndarray, place: tuple[int, int]) -> int:
    """A hash of the run's documents and of its place, partition and ordinal: equal rows elsewhere are another run."""
    folded = common.mix(ids.astype(np.uint64) + common.mix(np.arange(1, len(ids) + 1, dtype=np.uint64)))
    named = common.mix(np.array([folded.sum(dtype=np.uint64) + np.uint64(int(n.sum()))]))
    return int(common.mix(named + common.mix(np.array([place[0] << 32 | place[1]], np.uint64)))[0].astype(np.int64))


_SENT = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])


def _packed(owner: np.ndarray, docs: int) -> bytes:
    """Sorted owners: how many each document has, or, where that is shorter, the owners themselves after a -1."""
    if len(owner) + 1 < docs:
        return np.concatenate([[-1], owner]).astype(np.int32).tobytes()
    return np.bincount(owner, minlength=docs).astype(np.int32).tobytes()


def _owners(packed: bytes) -> np.ndarray:
    found = np.frombuffer(packed, np.int32)
    return found[1:] if len(found) and found[0] == -1 else np.repeat(np.arange(len(found)), found)


def _send(width: int, buckets: int):
    """Documents to blobs for each (run of documents, range of hashes), and one row that names the run's documents."""

    def rows(ids: list, sets: list, place: tuple[int, int]) -> pa.RecordBatch:
        ids, sizes = np.array(ids, np.int64), np.array([len(x) for x in sets], np.int64)
        run, out = _run_name(ids, sizes, place), {k: [] for k in _SENT.names}

        def add(*values):
            for k, v in zip(_SENT.names, values):
                out[k].append(v)

        add(run, abs(run) % buckets, ids.tobytes(), sizes.tobytes(), None)
        hashed = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        bucket = ((hashed >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(bucket, kind="stable")
        hashed, owner, bucket = hashed[order], owner[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                low = hashed[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
                add(run, k, None, _packed(owner[a:b], len(ids)), low.tobytes())
        return pa.RecordBatch.from_pydict(out, schema=_SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0  # a document of any length is in one run
        task, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = common.string_buffers(batch.column(1))
            for a, b in common.slices(offsets, SCAN_BYTES):
                ids += names[a:b].tolist()
                sets += shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                held += int(offsets[b] - offsets[a])
                if held >= RUN_BYTES:
                    yield rows(ids, sets, (task, run))
                    ids, sets, held, run = [], [], 0, run + 1
        if ids:
            yield rows(ids, sets, (task, run))

    return send


def _widen(low: bytes) -> np.ndarray:
    six = np.frombuffer(low, np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, :6] = six
    return eight.view(np.uint64).ravel()


_BACK = pa.schema([("run", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("seen", pa.binary())])


def _count(table: pa.Table) -> pa.Table:
    """All blobs of a range of hashes: sends back to each run the hashes of two or more documents, with their frequency."""
    out = {k: [] for k in _BACK.names}
    blobs = []
    for row in table.to_pylist():
        if row["hashes"] is None:
            for k in ("run", "ids", "counts"):
                out[k].append(row[k])
            out["hashes"].append(None)
            out["seen"].append(None)
        else:
            blobs.append(row)
    if blobs:
        parts = [_widen(x["hashes"]) for x in blobs]
        joined = np.concatenate(parts)
        order = np.argsort(joined)
        ordered = joined[order]
        fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(fresh, len(ordered)))
        seen = np.empty(len(joined), np.int64)
        seen[order] = np.repeat(times, times)
        cut = 0
        for x, part in zip(blobs, parts):
            own = seen[cut:cut + len(part)]
            cut += len(part)
            kept = own > 1
            if kept.any():
                owner = _owners(x["counts"])
                out["run"].append(x["run"])
                out["ids"].append(None)
                out["counts"].append(_packed(owner[kept], len(x["counts"]) // 4))
                # the range is part of the hash, by its last 16 bits
                out["hashes"].append((part[kept] | (np.uint64(x["bucket"] & 65535) << np.uint64(48))).tobytes())
                out["seen"].append(np.minimum(own[kept], 2**31 - 1).astype(np.uint32).tobytes())
    return pa.Table.from_pydict(out, schema=_BACK)


def least_overlap(n: int, threshold: int) -> int:
    """Shingles that a document of n must share with any partner, whatever the partner's size."""
    return -(-threshold * n // 100)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("digest", pa.binary()), ("body", pa.binary())])


def _gather(threshold: int):
    """The ranges' answers for one run of documents: a row a document; survivors with their shared shingles, rarest first."""

    def gather(table: pa.Table) -> pa.Table:
        ids = sizes = None
        owners, hashes, seen = [], [], []
        for row in table.to_pylist():
            if row["hashes"] is None:
                ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
            else:
                owners.append(_owners(row["counts"]))
                hashes.append(np.frombuffer(row["hashes"], np.uint64))
                seen.append(np.frombuffer(row["seen"], np.uint32))
        shared, digests, bodies = np.zeros(len(ids), np.int64), [None] * len(ids), [None] * len(ids)
        if owners:
            owner, hashed, often = np.concatenate(owners), np.concatenate(hashes), np.concatenate(seen)
            order = np.lexsort((hashed, often, owner))
            owner, hashed = owner[order], hashed[order]
            cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
            shared = np.diff(cuts)
            for k in np.flatnonzero((shared > 0) & (100 * shared >= threshold * sizes)):
                own = hashed[cuts[k]:cuts[k + 1]]
                bodies[k] = own.tobytes()
                if shared[k] == sizes[k]:  # else no other set equals it
                    a = common.mix(own)
                    digests[k] = np.array([len(own), a.sum(dtype=np.uint64), common.mix(a + np.uint64(1)).sum(dtype=np.uint64)], np.uint64).tobytes()
        return pa.Table.from_pydict({"doc_id": ids, "n": sizes, "shared": shared, "digest": digests, "body": bodies}, schema=_KEPT)

    return gather


def _post(threshold: int):
    """A row for each prefix shingle of each class."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, hashes = [], []
            for node, n, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = np.frombuffer(body, np.uint64)
                k = n - least_overlap(n, threshold) + 1 - (n - len(own))  # shingles of one document come first, and match nobody
                hashes.append(own[:k])
                nodes.append(np.full(len(hashes[-1]), node, np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(nodes))], ["hash", "node"])

    return post


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids on at least ``least`` of the sorted lists, with how many: a heap merge that skips what can't reach it."""
    found: dict[int, int] = {}
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found[top] = len(popped)
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            to = heap[0][0]
        for _, i, at in popped:
            own = lists[i]
            at = bisect_left(own, to, at)
            if at < len(own):
                heapq.heappush(heap, (own[at], i, at))
    return found


def divide_skip(lists: list[np.ndarray], least: int, ids: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidates with their counts on the short lists, and the long lists that are still to be probed.

    At most ``least - 1`` lists are long, so a result is on one short list at least.  ``ids`` bounds the ids.
    """
    lists = sorted(lists, key=len)
    long = long_lists(np.array([len(x) for x in lists], np.int64), least)
    short, probed = lists[:len(lists) - long], lists[len(lists) - long:]
    return *merge(short, least - long), probed


def long_lists(lengths: np.ndarray, least: int) -> int:
    """How many of the lists, whose lengths ascend, are probed instead of merged."""
    long = min(least - 1, len(lengths) - 1) if len(lengths) > 1 else 0
    return min(long, len(lengths) - int(np.searchsorted(lengths, 8, side="right")))  # short lists cost less in the merge


def merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids on at least ``least`` of the sorted lists, with how many."""
    if sum(map(len, lists)) <= HEAP_MOST:
        found = merge_skip([x.tolist() for x in lists], least)
        return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
    merged = np.sort(np.concatenate(lists), kind="stable")  # merges ascending runs
    fresh = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    counts = np.diff(np.append(fresh, len(merged)))
    enough = counts >= least
    return merged[fresh[enough]], counts[enough]


def probe(candidates: np.ndarray, counts: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Counts with the long lists, each searched for all candidates at once."""
    counts = counts.copy()
    for own in lists:
        at = np.searchsorted(own, candidates)
        counts += own[np.minimum(at, len(own) - 1)] == candidates
    return counts


def probe_enough(candidates: np.ndarray, counts: np.ndarray, lists: list[np.ndarray], enough: np.ndarray) -> np.ndarray:
    """The candidates whose counts reach ``enough`` with the long lists; those that can't any more drop out on the way."""
    for k in range(0, len(lists) + 1, 8):
        alive = counts + (len(lists) - k) >= enough
        candidates, counts, enough = candidates[alive], counts[alive], enough[alive]
        if not len(candidates):
            break
        counts = probe(candidates, counts, lists[k:k + 8])
    return candidates[counts >= enough]


def search_links(nodes: np.ndarray, sizes: np.ndarray, bodies: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """What links among these documents, directly or through others: each with the smallest node it is connected with.

    Stars instead of the links that were found: components of many such results settle in few rounds.
    """
    order = np.lexsort((nodes, sizes))
    nodes, sizes, bodies = nodes[order], sizes[order], [np.sort(bodies[i]) for i in order]
    total = len(nodes)
    joined = np.concatenate(bodies) if total else np.zeros(0, np.uint64)
    lengths = np.array([len(x) for x in bodies], np.int64)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(total), lengths)
    by_hash = np.argsort(joined, kind="stable")
    posted, ordered = owner[by_hash], joined[by_hash]
    number = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if total else owner
    least = -(-threshold * sizes // 100)
    smallest = np.searchsorted(sizes, least)  # an earlier document has as many shingles at most
    # the list of each shingle of each document: documents before it that aren't too small
    ends = np.empty(len(joined), np.int64)
    ends[by_hash] = np.arange(len(joined))
    begins = np.searchsorted(number * total + posted, number[ends] * total + smallest[owner])
    root = np.arange(total)

    def join(k: int, q: int) -> None:
        root[root == root[k]] = root[q]

    for q in range(total):
        n, need = int(sizes[q]), int(least[q])
        a, b = begins[cuts[q]:cuts[q + 1]], ends[cuts[q]:cuts[q + 1]]
        some = b > a
        if smallest[q] >= q or some.sum() < need:
            continue
        a, b = a[some], b[some]
        by_length = np.argsort(b - a, kind="stable")
        a, b = a[by_length], b[by_length]
        short = len(a) - long_lists(b - a, need)
        # who comes last on the short lists is likely a partner; what it is connected with needs no search
        last, often = np.unique(posted[b[:short] - 1], return_counts=True)
        for k in last[np.argsort(-often, kind="stable")[:2]]:
            overlap = len(np.intersect1d(bodies[q], bodies[k], assume_unique=True))
            if root[k] != root[q] and 100 * overlap >= threshold * (n + sizes[k] - overlap):
                join(k, q)
        lists = []
        for x, y in zip(a[:short].tolist(), b[:short].tolist()):
            own = posted[x:y]
            own = own[root[own] != root[q]]
            if len(own):
                lists.append(own)
        if not lists:
            continue
        found, counts = merge(lists, need - (len(a) - short))
        long = [posted[x:y] for x, y in zip(a[short:].tolist(), b[short:].tolist())] if len(found) else []
        likely = np.argsort(-counts, kind="stable")
        # a few likely partners first: what they are connected with drops out of the rest, which are probed at once
        for part in (likely[:16], likely[16:]):
            some = part[root[found[part]] != root[q]]
            enough = -(-threshold * (n + sizes[found[some]]) // (100 + threshold))  # overlap at which they link
            for k in probe_enough(found[some], counts[some], long, enough):
                if root[k] != root[q]:
                    join(k, q)
    least_node = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(least_node, root, nodes)
    far = np.flatnonzero(least_node[root] != nodes)
    return list(zip(least_node[root[far]].tolist(), nodes[far].tolist()))


def _search(threshold: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        links = search_links(pdf["node"].to_numpy(), pdf["n"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["body"]], threshold)
        return pd.DataFrame(links, columns=["src", "dst"], dtype="int64")

    return search


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; links are exact at ``threshold`` per cent Jaccard.

    Null and empty texts, and texts of separators only, have no shingle and link with nothing.  Fewer
    words than ``width`` are one shingle.  A row without id comes back with a null component.  Rows that
    repeat an id are one document: what any of them links with, all do.  Other columns are not read.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("threshold: 50 to 100")
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    unnamed = rows.where("doc_id is null").select("text")
    rows = rows.where("doc_id is not null")
    buckets = min(1 << 24, max(common.shuffle_partitions(docs), ceil(common.size_in_bytes(docs) / RANGE_BYTES)))  # the hash has 24 bits for them
    sent = rows.mapInArrow(_send(width, buckets), "run long, bucket int, ids binary, counts binary, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_count, "run long, ids binary, counts binary, hashes binary, seen binary")
    with common.small_batches(docs.sparkSession, BATCH_BYTES):
        kept = answers.groupBy("run").applyInArrow(_gather(threshold), "doc_id long, n long, shared long, digest binary, body binary").checkpoint()

    # one node a class; a document without equals in its set is a class of its own
    keyed = kept.where("body is not null").withColumn("key", F.coalesce("digest", F.col("doc_id").cast("string").cast("binary")))
    classes = keyed.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("body").alias("body")).checkpoint()
    member = keyed.select("doc_id", "key").distinct().join(classes.select("key", "node"), "key").select("doc_id", "node")

    posted = classes.select("node", "n", "body").mapInArrow(_post(threshold), "hash long, node long")
    met = posted.groupBy("hash").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    near = posted.join(met.select("hash", "least"), "hash").where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct()
    group = connected_components(near).withColumnRenamed("component", "grp")

    # cells: bands of set sizes, of which linked documents are in the same or the next, cut into blocks
    factor = max(log(100 / threshold), 1e-3) * (1 + 1e-9)
    sized = group.join(classes.select("node", "n"), "node").withColumn("band", F.floor(F.log("n") / factor).cast("int")).checkpoint()
    counted = sized.groupBy("grp", "band").agg(F.count("*").alias("docs"))
    bands = counted.groupBy("grp").agg(F.sum("docs").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("docs") / block).cast("int")))).alias("parts"))  # a few dozen bands
    cell = lambda band, part: band.cast("long") * 2**32 + part
    own = cell(F.col("band"), F.pmod(F.xxhash64("node"), F.col("parts")[F.col("band")]))
    met_in = lambda band: F.when(F.col("parts")[band].isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("parts")[band] - 1), lambda k: cell(band, k))).otherwise(F.array().cast("array<long>"))
    near_cells = F.filter(F.concat(*(met_in(F.col("band") + k) for k in (-1, 0, 1))), lambda x: x != F.col("own"))
    unit = (
        sized.join(bands, "grp").withColumn("own", F.when(F.col("all") <= block, F.lit(0).cast("long")).otherwise(own))
        .withColumn("other", F.explode(F.when((F.col("all") <= block) | (F.size(near_cells) == 0), F.array("own")).otherwise(near_cells)))
        .select("node", "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    found = (
        classes.select("node", "n", "body").join(unit, "node")
        .groupBy("grp", "i", "j").applyInPandas(_search(threshold), "src long, dst long")
    )
    # classes whose members share an id are linked too
    linked = connected_components(found.union(member.where("doc_id <> node").select("node", "doc_id")))
    least = linked.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    result = kept.select("doc_id", F.col("n").alias("n_shingles")).join(least, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if docs.schema[id_col].nullable:
        lost = unnamed.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_sizes(width), "n_shingles long")
        result = result.unionByName(lost.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return result


def _sizes(width: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.string_buffers(batch.column(1))
            for a, b in common.slices(offsets, SCAN_BYTES):
                sets = shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sets], pa.int64())], ["n_shingles"])

    return sizes
