"""Toxicity by a linear-chain conditional random field over tokens.

Tokens have two tags, clean and toxic.  Features of a token are its word and its prefixes, of which the
field knows those that training texts tie to the label.  Tokens of the training texts are labelled
from the documents' labels: in a toxic document, those with a tied feature; in others none.  Weights are
fitted by gradient ascent on the likelihood of the tags, by forward-backward.  Forward-backward
marginals score tokens: spans of offending tokens with their offsets, and, through a logistic fit on
the labels, documents.

Tokens without any known feature have one and the same potential, so a run of them is a power of a
two-by-two matrix: whole texts are scored exactly in steps that count known tokens only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from claimforge.llm import common

#: Toxic documents that the field is fitted on, about.
SAMPLE_DOCS = 1500
#: Prefixes of a word that are features, in letters.
PREFIXES = (4, 5, 6)
#: A feature is known if so many toxic documents have it, its share of them is so many times that of the others, and
#: chance would bring no more than such a share of the known features (by a bound on the binomial tail).
MIN_DOCS, MIN_RATIO, CHANCE = 4, 20.0, 0.1
#: Clean documents in the sample for each toxic one: with more of them, fewer words seem tied to the label.
CLEAN = 2
#: Words of a training sequence; rounds of gradient ascent; pull of weights to zero.
SEQUENCE, ROUNDS, PULL = 64, 60, 1e-3
#: Bytes of text that ``annotate`` scores at once; its batches hold all columns.
ANNOTATE_BYTES = 1 << 20
#: A token is in a span from this marginal on.
SPAN = 0.5


def features(word: bytes) -> list[str]:
    """A word without case and outer marks, and its prefixes; none without letters."""
    plain = word.decode("utf-8", "replace").lower()
    a, b = 0, len(plain)
    while a < b and not plain[a].isalpha():
        a += 1
    while b > a and not plain[b - 1].isalpha():
        b -= 1
    plain = plain[a:b]
    return [plain, *(f"{plain[:n]}~" for n in PREFIXES if len(plain) > n)] if plain else []


class ToxicityModel:
    """Known features with weights, the chain's potentials, and the documents' logistic fit."""

    def __init__(self, weight: dict[str, float], bias: float, move: np.ndarray, document: np.ndarray):
        self.weight, self.bias, self.move, self.document = weight, bias, move, document
        self.chain: _Powers | None = None

    def words(self) -> common.WordTable:
        """For each word, its known features' weight and whether it has any."""

        def fill(words: list[bytes]) -> np.ndarray:
            known = [[self.weight[f] for f in features(w) if f in self.weight] for w in words]
            return np.array([[sum(x), float(bool(x))] for x in known]).reshape(-1, 2)

        return common.WordTable(2, fill, most=200_000)

    def marginals(self, emission: np.ndarray, at: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The toxic tag's marginals of known tokens.

        ``at``: their places in their texts, row k's being ``first[k]:first[k + 1]``; ``emission``: their log odds.
        """
        out = np.zeros(len(at))
        if not len(at):
            return out
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        if self.chain is None:
            self.chain = _Powers(self.move, self.bias)
        chain = self.chain
        steps = int(count.max())
        live = np.searchsorted(-count[order], -np.arange(1, steps + 1), side="right")  # rows with over k tokens come first
        alphas = []
        state, place = np.tile(chain.start, (len(order), 1)), np.full(len(order), -1)
        for k in range(steps):
            rows = order[:live[k]]
            token = first[rows] + k
            now = chain.through(state[:live[k]], at[token] - place[:live[k]])
            now = now * np.stack([np.ones(len(token)), np.exp(np.clip(emission[token], -40, 40))], 1)
            now /= now.sum(1, keepdims=True)
            state[:live[k]], place[:live[k]] = now, at[token]
            alphas.append((token, now))
        back, place = np.ones((len(order), 2)), lengths[order].astype(np.int64)
        for k in range(steps - 1, -1, -1):
            token, alpha = alphas[k]
            n = len(token)
            beta = chain.back(back[:n], place[:n] - at[token], place[:n] == lengths[order[:n]])
            both = alpha * beta
            out[token] = both[:, 1] / both.sum(1)
            beta = beta * np.stack([np.ones(n), np.exp(np.clip(emission[token], -40, 40))], 1)
            back[:n], place[:n] = beta / beta.sum(1, keepdims=True), at[token]
        return out

    def score(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each document's probability of the label."""
        x = document_features(marginal, first)
        return 1 / (1 + np.exp(-np.clip(x @ self.document[:-1] + self.document[-1], -40, 40)))


def document_features(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chance that some token is toxic, and the log of the number of toxic tokens that is expected."""
    missed = common.sum_by_row(np.log1p(-np.minimum(marginal, 1 - 1e-12)), first)
    expected = common.sum_by_row(marginal, first)
    return np.stack([1 - np.exp(missed), np.log1p(np.maximum(expected, 0))], 1)


class _Powers:
    """Powers of the chain's matrix over tokens without known features."""

    def __init__(self, move: np.ndarray, bias: float):
        self.move = np.exp(move)
        self.plain = self.move * np.array([1.0, np.exp(bias)])  # into a token of no known feature
        self.start = np.array([1.0, 0.0])
        self.tables = [self._table(self.plain)]

    @staticmethod
    def _table(base: np.ndarray) -> np.ndarray:
        """Powers 0 to 4095, each to a factor of its own."""
        powers = [np.eye(2)]
        while len(powers) < 4096:
            x = powers[-1] @ base
            powers.append(x / x.sum())
        return np.array(powers)

    def power(self, n: np.ndarray) -> np.ndarray:
        """``plain ** n``, to a factor: by the digits of n to the base 4096."""
        found, level = self.tables[0][n & 4095], 1
        while (n := n >> 12).any():
            if level == len(self.tables):
                x = self.tables[-1][-1] @ self.tables[-1][1]
                self.tables.append(self._table(x / x.sum()))
            found = found @ self.tables[level][n & 4095]
            level += 1
        return found

    def through(self, state: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """States before a token's own emission; ``gap - 1`` plain tokens lie between."""
        return np.einsum("ni,nij->nj", state, self.power(gap - 1)) @ self.move

    def back(self, state: np.ndarray, gap: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Messages from what follows: ``gap - 1`` plain tokens, then a known one or the end."""
        x = np.where(last[:, None], 1.0, state @ self.move.T)
        x = np.einsum("nij,nj->ni", self.power(gap - 1), x)
        return x / x.sum(1, keepdims=True)


def evidence(inside: np.ndarray, outside: np.ndarray, share: float) -> np.ndarray:
    """Minus the log of a bound on the chance that of ``inside + outside`` documents so many are toxic, if ``share`` are."""
    n = inside + outside
    q = inside / n
    with np.errstate(divide="ignore", invalid="ignore"):
        found = n * (q * np.log(q / share) + np.where(outside > 0, (1 - q) * np.log((1 - q) / (1 - share)), 0.0))
    return np.where(q > share, found, 0.0)


def known_features(inside: np.ndarray, outside: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Places of the features that are tied to the label.

    ``inside`` and ``outside`` count the documents with each feature among ``toxic`` and ``clean`` ones.  The longest
    list is taken of which chance would bring a share of CHANCE at most, counting as looked at those features only that
    are in MIN_DOCS documents: with few labels that asks for less than a bound for each feature of its own.
    """
    looked_at = int((inside + outside >= MIN_DOCS).sum())
    tied = np.flatnonzero((inside >= MIN_DOCS) & (inside * clean >= MIN_RATIO * outside * toxic))
    found = evidence(inside[tied], outside[tied], toxic / (toxic + clean))
    order = np.argsort(-found, kind="stable")
    enough = np.flatnonzero(found[order] >= np.log(looked_at / (CHANCE * np.arange(1, len(order) + 1)))) if len(order) else order
    return tied[order[:enough[-1] + 1]] if len(enough) else tied[:0]


def fit_field(known: list[list[int]], tags: list[np.ndarray], size: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of ``size`` features, the bias and the log transitions, from sequences of tokens.

    ``known`` has a list of features for every token of all sequences in turn; ``tags`` an array a sequence.
    """
    lanes, steps = len(tags), max(map(len, tags), default=1)
    truth, real = np.zeros((lanes, steps), np.int64), np.zeros((lanes, steps), bool)
    place = np.zeros(len(known), np.int64)
    done = 0
    for k, t in enumerate(tags):
        truth[k, :len(t)], real[k, :len(t)] = t, True
        place[done:done + len(t)] = k * steps + np.arange(len(t))
        done += len(t)
    token = np.repeat(place, [len(x) for x in known])
    feature = np.array([f for x in known for f in x], np.int64)
    weight, bias, move = np.zeros(size), -2.0, np.array([[0.0, -2.0], [0.0, -1.0]])
    memory = [np.zeros(size), 0.0, np.zeros((2, 2))]
    before = np.concatenate([np.zeros((lanes, 1), np.int64), truth[:, :-1]], 1)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (before[real], truth[real]), 1)
    total = max(1, int(real.sum()))
    for _ in range(ROUNDS):
        emission = (np.bincount(token, weight[feature], lanes * steps) if len(token) else np.zeros(lanes * steps)).reshape(lanes, steps) + bias
        local = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -40, 40))], 2)
        m = np.exp(move)
        alpha = np.zeros((steps, lanes, 2))
        state = np.tile([1.0, 0.0], (lanes, 1))
        for k in range(steps):
            state = np.where(real[:, k, None], (state @ m) * local[:, k], state)
            state /= state.sum(1, keepdims=True)
            alpha[k] = state
        beta = np.ones((lanes, 2))
        marginal, moves = np.zeros((lanes, steps)), np.zeros((2, 2))
        for k in range(steps - 1, -1, -1):
            both = alpha[k] * beta
            marginal[:, k] = both[:, 1] / both.sum(1)
            earlier = alpha[k - 1] if k else np.tile([1.0, 0.0], (lanes, 1))
            into = beta * local[:, k]
            pair = earlier[:, :, None] * m[None] * into[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moves += pair[real[:, k]].sum(0)
            beta = np.where(real[:, k, None], into @ m.T, beta)
            beta /= beta.sum(1, keepdims=True)
        error = np.where(real, truth - marginal, 0).ravel()
        gradients = [(np.bincount(feature, error[token], size) if len(token) else np.zeros(size)) - PULL * weight, error.sum(), seen_moves - moves]
        rates = (1.0, 0.3, 0.3)
        values = []
        for j, (value, g) in enumerate(zip((weight, bias, move), gradients)):
            memory[j] = memory[j] + g * g
            values.append(value + rates[j] * g / np.sqrt(memory[j] + 1e-9 * total))
        weight, bias, move = values
    return weight, float(bias), move


def fit_document(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights and intercept, by Newton steps with a weak pull to zero."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_each: int = SAMPLE_DOCS, odds: float | None = None) -> ToxicityModel:
    """Fitted on about ``docs_each`` documents of either label, of least id hash; rows without label or text don't count.

    ``odds`` are those of the label among all labelled rows, if these are a sample of their own.
    Without documents of both labels nothing is known, and every score is the share of the label (0.0 of none).
    """
    rows = labelled.where(f"{label_col} is not null and {text_col} is not null").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(label_col) > 0).alias("y"))
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    share = F.when(F.col("y"), min(1.0, docs_each / max(1, sizes.get(True, 0)))).otherwise(min(1.0, CLEAN * docs_each / max(1, sizes.get(False, 0))))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("id")), 33) / F.lit(float(2**31))
    sample = sorted(((r.id is None, r.id, r.text, r.y) for r in rows.where(hashed < share).limit(4 * docs_each).toLocalIterator()), key=lambda r: (r[0], r[1] or 0, r[2]))
    texts, y = [r[2].encode() for r in sample], np.array([r[3] for r in sample], float)
    move = np.array([[0.0, -2.0], [0.0, -1.0]])
    if len(set(y)) < 2:
        return ToxicityModel({}, -2.0, move, np.array([0.0, 0.0, 40.0 if y.sum() else -40.0]))

    # features are counted by their hashes, those of toxic texts only: the driver holds no vocabulary of all texts
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    hashes = [np.unique(np.fromiter((hash(f) for w in set(t.split()) for f in features(w)), np.int64)) for t, label in zip(texts, y) if label]
    looked_at, inside = np.unique(np.concatenate([*hashes, np.zeros(1, np.int64)]), return_counts=True)  # never empty
    outside = np.zeros(len(looked_at), np.int64)
    for t, label in zip(texts, y):
        if not label:
            own = np.unique(np.fromiter((hash(f) for w in set(t.split()) for f in features(w)), np.int64))
            place = np.minimum(np.searchsorted(looked_at, own), len(looked_at) - 1)
            outside[place[looked_at[place] == own]] += 1
    tied = dict(zip(looked_at[at := known_features(inside, outside, toxic, clean)].tolist(), at.tolist()))
    names = {f for t, label in zip(texts, y) if label for w in set(t.split()) for f in features(w) if hash(f) in tied}
    strength = evidence(inside, outside, toxic / (toxic + clean))
    known = sorted(names, key=lambda f: (-strength[tied[hash(f)]], f))
    del hashes, looked_at, inside, outside
    number = {f: k for k, f in enumerate(known)}

    lists, tags, none = [], [], []
    for t, label in zip(texts, y):
        own = [[number[f] for f in features(w) if f in number] or none for w in t.split()]
        for a in range(0, len(own), SEQUENCE):
            part = own[a:a + SEQUENCE]
            if any(part) or a == 0:  # the rest tells nothing but the bias, which the first parts do
                lists += part
                tags.append(np.array([int(label and bool(x)) for x in part]))
    weight, bias, move = fit_field(lists, tags, len(known))
    model = ToxicityModel({f: float(weight[k]) for f, k in number.items()}, bias, move, np.zeros(3))
    del lists, tags
    table, parts = model.words(), []
    for a in range(0, len(texts), 250):
        parts.append(document_features(*_known_marginals(model, table, *_joined(texts[a:a + 250]))[:2]))
    # the sample has labels in shares of its own: the intercept is moved to the shares of all labelled rows
    document = fit_document(np.concatenate(parts), y)
    document[-1] += np.log((odds or sizes[True] / sizes[False]) / (toxic / clean))
    model.document = document
    return model


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _known_marginals(model: ToxicityModel, table: common.WordTable, raw: np.ndarray, offsets: np.ndarray):
    """Marginals of known tokens, each row's first, and where the tokens start and end in bytes."""
    starts, ends, first = common.words(raw, offsets)
    number = table.numbers(raw, starts, ends)
    known = np.flatnonzero(table.values[number, 1] > 0)
    of_row = np.searchsorted(known, first)
    place = known - np.repeat(first[:-1], np.diff(of_row))
    emission = table.values[number[known], 0] + model.bias
    return model.marginals(emission, place, of_row, np.diff(first)), of_row, starts[known], ends[known]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; null counts as empty.  One row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.words()
        for rows, raw, offsets in common.scan_rows(batches, 1):
            marginal, first = _known_marginals(own, table, raw, offsets)[:2]
            found = own.score(marginal, first)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, score double, predicted int")


def annotate(docs: DataFrame, model: ToxicityModel, name: str = "toxic", text_col: str = "text") -> DataFrame:
    """``docs`` with ``predicted`` of ``score`` as a further column ``name``; rows and columns stay as they are."""
    sent, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)  # weights of features of the bounded sample
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.words()
        for rows, raw, offsets in common.scan_rows(batches, text, ANNOTATE_BYTES):
            marginal, first = _known_marginals(own, table, raw, offsets)[:2]
            found = pa.array((own.score(marginal, first) >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rows.columns, found], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, IntegerType())]))


def spans(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, stop, text, marginal``: offending tokens with their offsets in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.words()
        for rows, raw, offsets in common.scan_rows(batches, 1):
            marginal, first, starts, ends = _known_marginals(own, table, raw, offsets)
            before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before a byte
            keep = np.flatnonzero(marginal >= SPAN)
            row = np.searchsorted(first, keep, side="right") - 1
            base = before[offsets[row]]
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[keep], ends[keep])]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), pa.array(before[starts[keep]] - base), pa.array(before[ends[keep]] - base), pa.array(texts, pa.string()), pa.array(marginal[keep])],
                ["doc_id", "start", "stop", "text", "marginal"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, start long, stop long, text string, marginal double")


def train_on_labels(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> ToxicityModel:
    """Fitted on labelled documents whose crc32(doc_id) mod ``folds`` isn't ``held_out``.

    The labels are small next to texts; a document with several labels is toxic if one says so.
    """
    kept = labels.where((common.crc32_of_id() % folds != held_out) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the same draw as in train, before the join: only the sample's texts are shuffled
    sizes = {r.y: r["count"] for r in kept.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    share = F.when(F.col("toxic") > 0, min(1.0, SAMPLE_DOCS / max(1, sizes.get(True, 0)))).otherwise(min(1.0, CLEAN * SAMPLE_DOCS / max(1, sizes.get(False, 0))))
    drawn = kept.where(F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 33) / F.lit(float(2**31)) < share).limit(4 * SAMPLE_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # 4 * SAMPLE_DOCS rows at most
    return train(sample, docs_each=2**28, odds=sizes[True] / sizes[False] if len(sizes) == 2 else None)
