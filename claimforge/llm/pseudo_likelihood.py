"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Words are counted over the whole corpus.  The most frequent ones are the vocabulary, which grows with
the number of counted words; each belongs to a class, and a word's probability is its class's times
its own within the class, both given its neighbours on both sides.  The network is embeddings of two
words on each side, a hidden layer, a softmax over classes and in each class a binary tree over its
words, whose decisions start at the shares in the whole corpus.  It is trained in numpy, by partition,
on every document: a hash deals the documents out to rounds, each task starts a round from the same
weights, and a round's results are averaged row by row.  A document's score is the sum of the conditional
log probabilities of all its words.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import common
from claimforge.session import ensure_checkpoint_dir

#: Words that are told apart at least, and for each root of the number of counted words; all others are one more class.
VOCABULARY, GROWTH = 8192, 4
#: Classes of the vocabulary, of about equal shares of its words in the text.
CLASSES = 63
#: Words on each side, size of embeddings and of the hidden layer.
SIDE, EMBEDDING, HIDDEN = 2, 16, 32
#: Documents of a round, about, below which every document is in several rounds.
SAMPLE_DOCS = 400
#: Bytes of text of a training task, and of the part that it shuffles words in.
TRAIN_BYTES, PART_BYTES = 16 << 20, 1 << 20
#: Rounds; words of a task's first batches; steps of dense weights.
EPOCHS, BATCH, RATE = 3, 512, 0.003
#: Steps of rows; a batch grows with the words that a task has seen, to so many times the first.
ROW_RATE, LARGEST = 0.1, 16
#: Entries of a tile in which gradients are summed up.
TILE = 16
#: Bytes of text whose words are counted before they are sent.
COUNT_BYTES = 32 << 20


def hashed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, A-Z as a-z, and each row's first."""
    starts, ends, first = common.words(raw, offsets)
    return common.plain_hashes(common.LOWER[raw], starts, ends), first


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word (its hash) occurs in all texts; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_freed_memory()
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for _, raw, offsets in common.scan_rows(batches, 0):
            held.append(hashed_words(raw, offsets)[0])
            size += len(raw)
            if size >= COUNT_BYTES:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_trees(kind: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman trees over the words of each class: where each word's decisions start, their nodes and branches, each node's log odds."""
    parent, branch = np.full(2 * len(n), -1), np.zeros(2 * len(n), np.int8)
    odds, nodes = [], 0
    for own in np.split(order := np.argsort(kind, kind="stable"), np.flatnonzero(np.diff(kind[order])) + 1) if len(n) else []:
        heap = [(float(n[w]), int(w)) for w in own]
        heapq.heapify(heap)
        while len(heap) > 1:
            (x, left), (y, right) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(n) + nodes
            parent[[left, right]], branch[right] = node, 1
            odds.append(np.log(y / x))
            heapq.heappush(heap, (x + y, node))
            nodes += 1
    word, at = np.arange(len(n)), np.arange(len(n))
    words, found, taken = [word[:0]], [word[:0]], [branch[:0]]
    while len(at):
        inner = parent[at] >= 0
        word, at = word[inner], at[inner]
        words.append(word)
        taken.append(branch[at])
        at = parent[at]
        found.append(at - len(n))
    words, found, taken = map(np.concatenate, (words, found, taken))
    order = np.argsort(words, kind="stable")
    return np.searchsorted(words[order], np.arange(len(n) + 1)), found[order].astype(np.int32), taken[order], np.array(odds, np.float32)


class WindowModel:
    """The vocabulary with classes and shares, and the network."""

    def __init__(self, words: np.ndarray, kind: np.ndarray, share: np.ndarray, rest: float):
        self.words, self.kind, self.share, self.rest = words, kind, share, rest  # words sorted by hash; ``rest`` is a word's share beyond them
        # where a word stands is looked up by its hash's first bits, and from there on
        bits = max(1, len(words).bit_length() + 2)
        self.shift, self.sorted = np.uint64(64 - bits), np.append(words, np.uint64(2**64 - 1))
        self.slots = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        rng = np.random.default_rng(8)
        ids = len(words) + 2  # 0: any other word; 1 to V: the vocabulary; V + 1: outside the text
        self.embedding = rng.normal(0, 0.1, (ids, EMBEDDING)).astype(np.float32)
        self.inner = rng.normal(0, 0.1, (2 * SIDE, EMBEDDING, HIDDEN)).astype(np.float32)
        self.inner_bias = np.zeros(HIDDEN, np.float32)
        self.outer = rng.normal(0, 0.1, (HIDDEN, CLASSES + 1)).astype(np.float32)
        self.outer_bias = np.zeros(CLASSES + 1, np.float32)
        begins, self.path, self.branch, odds = class_trees(kind, share)
        self.begins = np.concatenate([[0], begins])  # other words have no decisions
        self.depth = np.concatenate([[0], np.diff(begins)])
        self.most = self.depth.max()
        self.kinds = np.append(CLASSES, kind)
        self.nodes = np.zeros((len(odds), HIDDEN + 1), np.float32)  # the last is the bias
        self.nodes[:, HIDDEN] = odds

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = self.slots.take((hashes >> self.shift).astype(np.int64))
        found = self.sorted.take(at)
        behind = np.flatnonzero(found < hashes)
        while len(behind):
            at[behind] += 1
            found[behind] = self.sorted.take(at[behind])
            behind = behind[found[behind] < hashes[behind]]
        return np.where((found == hashes) & (at < len(self.words)), at + 1, 0)

    def windows(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of neighbours for each word, within its text."""
        outside = len(self.words) + 1
        counts = np.diff(first)
        place = np.arange(len(ids)) - np.repeat(first[:-1], counts)
        left = np.repeat(counts, counts) - place - 1
        out = np.full((len(ids), 2 * SIDE), outside, np.int32)
        for k in range(1, SIDE + 1):
            out[k:, k - 1] = np.where(place[k:] >= k, ids[:-k], outside)
            out[:-k, SIDE + k - 1] = np.where(left[:-k] >= k, ids[k:], outside)
        return out

    def outer_rows(self) -> np.ndarray:
        """The classes' weights, the last row being their biases."""
        return np.concatenate([self.outer, self.outer_bias[None]])

    def exponents(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the classes' logits, but for a factor of each row that keeps it from overflowing, and its logarithm."""
        p = hidden @ self.outer_rows()
        # the hidden layer is within -1 and 1, so this bounds all logits
        if (np.abs(self.outer).sum(0) + np.abs(self.outer_bias)).max() < 60:
            return np.exp(p, out=p), np.zeros(len(p), np.float32)
        top = p.max(1)
        p -= top[:, None]
        return np.exp(p, out=p), top

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings of rows of neighbours, side by side, and the hidden layer with a last unit of 1, whose weights are biases."""
        e = self.embedding.take(around.ravel(), 0).reshape(len(around), -1)
        x = e @ self.inner.reshape(-1, HIDDEN)
        x += self.inner_bias
        hidden = np.empty((len(x), HIDDEN + 1), np.float32)
        np.tanh(x, out=hidden[:, :HIDDEN])
        hidden[:, HIDDEN] = 1
        return e, hidden

    def deepest_first(self, ids: np.ndarray) -> np.ndarray:
        """The order of words by their number of decisions within the class, most first."""
        return np.argsort((self.most - self.depth.take(ids)).astype(np.uint16), kind="stable")

    def decisions(self, ids: np.ndarray, hidden: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes, branches, weights and log odds of the first decisions of words in the above order, then of the second ones, and so on.

        Words without further decisions are the last ones, and are left out.
        """
        depth, begins = self.depth.take(ids), self.begins.take(ids)
        for d, n in enumerate(len(ids) - np.cumsum(np.bincount(depth, minlength=1))[:-1]):
            at = begins[:n] + d
            node = self.path.take(at)
            weights = self.nodes.take(node, 0)
            yield node, self.branch.take(at), weights, np.einsum("nh,nh->n", hidden[:n], weights)

    def log_probabilities(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The conditional log probability of each word."""
        out = np.where(ids == 0, np.log(self.rest), 0.0)
        around, order = self.windows(ids, first), self.deepest_first(ids)
        outer, ones = np.ascontiguousarray(self.outer_rows().T), np.ones(CLASSES + 1, np.float32)
        for a in range(0, len(ids), 4096):
            at = order[a:a + 4096]
            own = ids[at]
            _, hidden = self.hidden(around.take(at, 0))
            p, top = self.exponents(hidden)
            kinds = self.kinds.take(own)
            found = np.einsum("nh,nh->n", hidden, outer.take(kinds, 0))
            found -= top
            found -= np.log(p @ ones)
            for _, branch, _, z in self.decisions(own, hidden):
                z *= 1 - 2 * branch
                found[:len(z)] -= np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
            out[at] += found
        return out


def row_sums(rows: np.ndarray, factors: np.ndarray | None, values: np.ndarray, of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` in order, and the sums of ``factors * values[of]`` of each; None stands for ones, and for values in turn.

    Entries are sorted by row and cut into tiles of TILE, in which sums are products of small matrices.  Only rows
    that reach into further tiles are added up then.
    """
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # by 16 bits at a time, which numpy sorts by their digits
    if rows.max() > 65535:
        order = order.take(np.argsort((rows >> 16).astype(np.uint16).take(order), kind="stable"))
    n, tiles = len(order), -(-len(order) // TILE)
    own = rows.take(order)
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]
    group = np.empty(tiles * TILE, np.int32)
    np.cumsum(new, out=group[:n])
    group[n:] = group[n - 1]
    begins = group[::TILE]
    place = (group.reshape(tiles, TILE) - begins[:, None]).ravel()  # within the tile, where sorted rows lie side by side
    spread = np.zeros((tiles, TILE, TILE), np.float32)
    at = np.arange(n)
    column = at & (TILE - 1)
    spread.reshape(-1)[((at - column + place[:n]) * TILE) + column] = 1 if factors is None else factors.take(order)
    taken = np.zeros(tiles * TILE, np.int64)
    taken[:n] = order if of is None else of.take(order)
    sums = (spread @ values.take(taken, 0).reshape(tiles, TILE, -1)).reshape(tiles * TILE, -1)
    at = np.flatnonzero(new)
    out = sums.take((at & -TILE) + place.take(at), 0)
    again = TILE + TILE * np.flatnonzero(~new[TILE::TILE])
    if len(again):
        more, g = row_sums(group.take(again) - 1, None, sums.take(again, 0), None)
        out[more] += g
    return own.take(at), out


def put_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``into[rows] = values``, each row copied as one block of bytes instead of number by number."""
    block = np.dtype((np.void, into.itemsize * into.shape[1]))
    into.view(block)[:, 0][rows] = np.ascontiguousarray(values, into.dtype).view(block)[:, 0]


DENSE = ("inner", "inner_bias", "outer", "outer_bias")


class Trainer:
    """Gradient descent on the cross-entropy of classes and of decisions within them.

    Dense weights take Adam's steps; embeddings and nodes that a batch meets take Adagrad's, by row.
    """

    def __init__(self, model: WindowModel, seed: list[int]):
        self.model, self.rng, self.step, self.seen = model, np.random.default_rng(seed), 0, 0
        self.moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in DENSE}
        self.squares = {k: np.zeros(len(getattr(model, k)), np.float32) for k in ("embedding", "nodes")}
        self.steps = {k: np.zeros(len(getattr(model, k)), np.int32) for k in ("embedding", "nodes")}

    def _rows(self, name: str, rows: np.ndarray, factors: np.ndarray | None, gradients: np.ndarray, of: np.ndarray | None) -> None:
        """One step for each distinct row, by the sum of its gradients (see ``row_sums``)."""
        distinct, g = row_sums(rows, factors, gradients, of)
        self.steps[name][distinct] += 1
        squares = self.squares[name].take(distinct)
        squares += np.einsum("nk,nk->n", g, g) / g.shape[1]
        self.squares[name][distinct] = squares
        g *= (ROW_RATE / (np.sqrt(squares) + 1e-8))[:, None]
        weights = getattr(self.model, name)
        put_rows(weights, distinct, np.subtract(weights.take(distinct, 0), g, out=g))

    def train(self, ids: np.ndarray, first: np.ndarray) -> None:
        own, around = self.model, self.model.windows(ids, first)
        order, a, ones = self.rng.permutation(len(ids)), 0, np.ones(CLASSES + 1, np.float32)
        while a < len(ids):
            at = order[a:a + min(BATCH * LARGEST, max(BATCH, self.seen // 32))]
            a, self.seen, self.step = a + len(at), self.seen + len(at), self.step + 1
            at = at[own.deepest_first(ids.take(at))]
            near, words = around.take(at, 0), ids.take(at)
            e, hidden = own.hidden(near)
            p, _ = own.exponents(hidden)
            p *= (1 / (p @ ones))[:, None]
            p[np.arange(len(at)), own.kinds.take(words)] -= 1
            back = p @ own.outer_rows().T
            nodes, errors = [], []
            for node, branch, weights, z in own.decisions(words, hidden):
                wrong = 0.5 + 0.5 * np.tanh(0.5 * z) - branch
                weights *= wrong[:, None]
                back[:len(z)] += weights
                nodes.append(node)
                errors.append(wrong)
            back *= 1 - hidden * hidden  # 0 for the last unit
            back = back[:, :HIDDEN]
            to_e, to_outer = back @ own.inner.reshape(-1, HIDDEN).T, hidden.T @ p
            dense = (e.T @ back).reshape(own.inner.shape), np.ones(len(at), np.float32) @ back, to_outer[:HIDDEN], to_outer[HIDDEN]
            for k, g in zip(DENSE, dense):
                g /= len(at)
                m, v = self.moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(own, k)[...] -= RATE * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            self._rows("embedding", near.ravel(), None, to_e.reshape(-1, EMBEDDING), None)
            if nodes:
                of = np.concatenate([np.arange(len(x)) for x in nodes])
                self._rows("nodes", np.concatenate(nodes), np.concatenate(errors), hidden, of)


_WEIGHTS = pa.schema([("name", pa.string()), ("block", pa.int32()), ("task", pa.int32()), ("rows", pa.binary()), ("weight", pa.binary()), ("vals", pa.binary())])


def _trained(sent, seed: int, block: int):
    """A task's documents to the weights that it trained, in blocks of rows, each row with the steps it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_freed_memory()
        task, trainer = TaskContext.get().partitionId(), None
        for _, raw, offsets in common.scan_rows(batches, 1, PART_BYTES):
            hashes, first = hashed_words(raw, offsets)
            if len(hashes):
                if trainer is None:
                    trainer = Trainer(copy.deepcopy(sent.value), [seed, task])  # a reused worker keeps the value
                trainer.train(trainer.model.ids(hashes), first)
        if trainer is None:
            return
        own = trainer.model
        dense = np.concatenate([getattr(own, k).ravel() for k in DENSE])[None]
        for name, values, steps in (("dense", dense, np.array([trainer.step])), *((k, getattr(own, k), trainer.steps[k]) for k in ("embedding", "nodes"))):
            rows = np.flatnonzero(steps)
            for part in np.split(rows, np.flatnonzero(np.diff(rows // block)) + 1):
                if len(part):
                    yield pa.RecordBatch.from_pydict({
                        "name": [name], "block": [int(part[0]) // block], "task": [task], "rows": [part.tobytes()],
                        "weight": [steps[part].astype(float).tobytes()], "vals": [values[part].tobytes()]}, schema=_WEIGHTS)

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """The tasks' weights of a block, averaged by steps."""
    parts = sorted(table.to_pylist(), key=lambda r: r["task"])
    rows = np.unique(np.concatenate([np.frombuffer(r["rows"], np.int64) for r in parts]))
    sums, weights = None, np.zeros(len(rows))
    for r in parts:
        at, weight = np.searchsorted(rows, np.frombuffer(r["rows"], np.int64)), np.frombuffer(r["weight"], float)
        values = np.frombuffer(r["vals"], np.float32).reshape(len(at), -1)
        sums = np.zeros((len(rows), values.shape[1])) if sums is None else sums
        sums[at] += values * weight[:, None]
        weights[at] += weight
    mean = (sums / weights[:, None]).astype(np.float32)
    return pa.table({"name": [parts[0]["name"]], "rows": pa.array([rows.tobytes()], pa.binary()), "vals": pa.array([mean.tobytes()], pa.binary())})


def train(model: WindowModel, sample: DataFrame, tasks: int) -> None:
    """EPOCHS rounds over ``key, begin, times, id, text``, each over the documents whose ``times`` rounds from ``begin`` on hold it.

    A round has at most ``tasks`` tasks, however Spark deals the keys, as each sends its weights.  All start from the
    same weights; averages are checkpointed and taken over.
    """
    block = max(16, 65536 // tasks)
    for seed in range(EPOCHS):
        sent = sample.sparkSession.sparkContext.broadcast(model)
        own = sample.where(F.pmod(F.lit(seed) - F.col("begin"), F.lit(EPOCHS)) < F.col("times")).select("key", "id", "text")
        own = own.repartition(tasks, "key").coalesce(tasks).sortWithinPartitions("key", "id", "text").select("id", "text")
        weights = own.mapInArrow(_trained(sent, seed, block), "name string, block int, task int, rows binary, weight binary, vals binary")
        found = weights.groupBy("name", "block").applyInArrow(_averaged, "name string, rows binary, vals binary").checkpoint().collect()
        for r in found:
            rows, values = np.frombuffer(r.rows, np.int64), np.frombuffer(r.vals, np.float32)
            if r.name != "dense":
                getattr(model, r.name)[rows] = values.reshape(len(rows), -1)
                continue
            for k in DENSE:
                own = getattr(model, k)
                own[...], values = values[:own.size].reshape(own.shape), values[own.size:]
        sent.unpersist()


def _most_frequent(counts: DataFrame, most: int = VOCABULARY) -> list:
    """About ``most`` of the most frequent words, most frequent first.

    A histogram of sixteenths of powers of two finds the frequency from which on words are taken; of the
    words at the boundary the share of least hashes.  So tasks send the driver what it keeps, and no more.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    above, cut, share = 0, 0, 1.0
    for cut, size in sizes:
        if above + size > most:
            share = (most - above) / size
            break
        above += size
    hashed = F.shiftrightunsigned(F.xxhash64("word"), 33) / F.lit(float(2**31))
    taken = counts.where((level > cut) | (level == cut) & (hashed < share)).limit(2 * most).collect()
    return sorted(taken, key=lambda r: (-r.n, r.word))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> WindowModel:
    """Shares from the counts of all words, and the network from all documents: each is in one round, in more if there are few."""
    ensure_checkpoint_dir(docs.sparkSession)
    counts = word_counts(docs, text_col).checkpoint()
    every = counts.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    top = _most_frequent(counts, max(VOCABULARY, GROWTH * isqrt(every.n or 0)))
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    n = np.array([r.n for r in top], float)
    kind = np.minimum((np.cumsum(n) - n) * CLASSES // max(1.0, n.sum()), CLASSES - 1).astype(np.int64)
    share = n / np.bincount(kind, n, CLASSES)[kind] if len(n) else n
    model = WindowModel(words[order := np.argsort(words)], kind[order], share[order], 1 / max(1, every.words - len(top) + 1))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    times = min(EPOCHS, ceil(EPOCHS * SAMPLE_DOCS / max(1, size.rows)))
    tasks = max(1, ceil((size.bytes or 0) * times / EPOCHS / TRAIN_BYTES))
    begin = F.floor(F.shiftrightunsigned("key", 33) * EPOCHS / F.lit(float(2**31)))
    keyed = rows.withColumn("key", F.xxhash64(F.lit(8), "id", "text"))
    train(model, keyed.withColumn("begin", begin).withColumn("times", F.lit(times)), tasks)
    return model


def score(docs: DataFrame, model: WindowModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every whole text.

    ``log_prob`` is the sum over all words, 0.0 without any; the mean is then 0.0, too.  One row per input row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # grows with the root of the number of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_freed_memory()
        own = sent.value
        for rows, raw, offsets in common.scan_rows(batches, 1):
            hashes, first = hashed_words(raw, offsets)
            n = np.diff(first)
            total = common.sum_by_row(own.log_probabilities(own.ids(hashes), first), first) if len(hashes) else np.zeros(len(n))
            total[n == 0] = 0.0
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(total), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_words long, log_prob double, mean_log_prob double")
