"""Language by segmentation-marginalised unigrams over a fixed public vocabulary of pieces.

A language gives every piece a probability.  The probability of a word is the sum, over all ways to cut
it into pieces, of the products of their probabilities; a forward pass over the word's positions
sums them without listing them.  Words are cut on their own, so a text's is the product of its words'.
The probabilities come from expectation maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import common

#: Documents of each language that the model is fitted on, about; languages at most, the most frequent ones.
SAMPLE_DOCS, MOST_LANGUAGES = 250, 256
#: Distinct words of each language's sample that are used, the most frequent ones.
SAMPLE_WORDS = 30_000
#: Rounds of expectation maximisation; weight of the mean of all languages in each one's probabilities.
ROUNDS, BACKOFF = 3, 0.02
#: Longest word of the array pass; longer ones take a pass of their own with rescaling.
LONG = 40
UNKNOWN = 1e-7


def load_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces, lower case only as texts are folded."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(x for x in found if x == x.lower())


class Pieces:
    """A trie of the pieces whose steps are looked up for many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        letters = sorted({c for x in pieces for c in x})
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        steps, of_node, self.depth = {}, [-1], max(map(len, pieces))
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = node * self.letters + int(self.letter[ord(c)])
                if key not in steps:
                    steps[key] = len(of_node)
                    of_node.append(-1)
                node = steps[key]
            of_node[node] = number
        self.piece = np.array(of_node, np.int64)
        keys = np.fromiter(steps, np.int64, len(steps))
        nodes = np.fromiter(steps.values(), np.int64, len(steps))
        # open addressing in a table that is a quarter full at most
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys)))))
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.nodes[slot[put]] = keys[put], nodes[put]
            left = left[~np.isin(left, put)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next nodes, -1 where there is none."""
        key = node * self.letters + letter
        slot = self._slot(key)
        held = self.keys[slot]
        found = np.where(held == key, self.nodes[slot], -1)
        left = np.flatnonzero((held != key) & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == key[left]
            found[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (held != -1)]
        return found

    def letters_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of letter numbers for each word, the word mark first, and lengths."""
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        grid = np.zeros((len(words), int(lengths.max()) if len(words) else 0), np.int64)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid[np.repeat(np.arange(len(words)), lengths), at] = self.letter[codes]
        return grid, lengths

    def edges(self, grid: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``start, length, words, pieces`` of all pieces in all words, by start; -1 for a letter that is no piece."""
        for s in range(grid.shape[1]):
            words = np.flatnonzero(lengths > s)
            node = np.zeros(len(words), np.int64)
            for k in range(min(self.depth, grid.shape[1] - s)):
                inside = lengths[words] > s + k
                words, node = words[inside], node[inside]
                if not len(words):
                    break
                node = self.step(node, grid[words, s + k])
                alive = node >= 0
                piece = np.where(alive, self.piece[node], -1)
                named = np.ones(len(words), bool) if k == 0 else piece >= 0
                if named.any():
                    yield s, k + 1, words[named], piece[named]
                words, node = words[alive], node[alive]


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word under each language; ``table`` has a row a piece and a last one for unknown letters."""
    out = np.zeros((len(words), table.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    cut = int(np.searchsorted([len(words[k]) for k in order], LONG, side="right"))
    for a in range(0, cut, 20_000):
        part = order[a:min(a + 20_000, cut)]
        grid, lengths = pieces.letters_of([words[k] for k in part])
        alpha = np.zeros((grid.shape[1] + 1, len(part), table.shape[1]))
        alpha[0] = 1
        for s, k, at, piece in pieces.edges(grid, lengths):
            alpha[s + k, at] += alpha[s, at] * table[piece]
        out[part] = np.log(alpha[lengths, np.arange(len(part))])
    for k in order[cut:]:
        out[k] = _forward_long(pieces, table, words[k])
    return out


def _forward_long(pieces: Pieces, table: np.ndarray, word: str) -> np.ndarray:
    """The same for one long word: the window of live positions is rescaled as it moves."""
    grid, lengths = pieces.letters_of([word])
    row, n, depth = grid[0], int(lengths[0]), pieces.depth
    # all starts of the word walk the trie together
    steps, node, starts = [], np.zeros(n, np.int64), np.arange(n)
    for k in range(depth):
        inside = starts + k < n
        starts, node = starts[inside], node[inside]
        node = pieces.step(node, row[starts + k])
        alive = node >= 0
        own = np.full(n, -2, np.int64)
        own[starts[alive]] = np.where(pieces.piece[node[alive]] >= 0, pieces.piece[node[alive]], -2)
        steps.append(own)
        starts, node = starts[alive], node[alive]
        if not len(starts):
            break
    steps[0] = np.where(steps[0] == -2, -1, steps[0])
    window, scale = np.zeros((depth + 1, table.shape[1])), np.zeros(table.shape[1])
    window[0] = 1
    for s in range(n):
        here = window[0].copy()
        for k, own in enumerate(steps):
            if own[s] != -2:
                window[k + 1] += here * table[own[s]]
        window[:-1] = window[1:]
        window[-1] = 0
        top = window[0]
        scale += np.log(top)
        window /= top
    return scale


def fit(pieces: Pieces, counts: dict[str, Counter]) -> np.ndarray:
    """Probabilities by expectation maximisation: a row a piece, a column a language, a last row for unknown letters."""
    names = list(counts)
    words = sorted({w for c in counts.values() for w in c if len(w) <= LONG})
    weight = np.array([[counts[l][w] for l in names] for w in words], float).reshape(len(words), len(names))
    table = np.full((pieces.size + 1, len(names)), 1 / max(1, pieces.size))
    table[-1] = UNKNOWN
    blocks = []
    for a in range(0, len(words), 20_000):
        grid, lengths = pieces.letters_of(words[a:a + 20_000])
        blocks.append((a, lengths, list(pieces.edges(grid, lengths))))
    for _ in range(ROUNDS):
        expected = np.zeros_like(table)
        for a, lengths, edges in blocks:
            n, own = len(lengths), np.arange(len(lengths))
            alpha = np.zeros((int(lengths.max()) + 1, n, len(names)))
            beta = np.zeros_like(alpha)
            alpha[0], beta[lengths, own] = 1, 1
            for s, k, at, piece in edges:
                alpha[s + k, at] += alpha[s, at] * table[piece]
            for s, k, at, piece in reversed(edges):
                beta[s, at] += beta[s + k, at] * table[piece]
            share = weight[a:a + n] / np.maximum(alpha[lengths, own], 1e-300)
            for s, k, at, piece in edges:
                flow = alpha[s, at] * table[piece] * beta[s + k, at] * share[at]
                for l in range(len(names)):
                    expected[:, l] += np.bincount(piece % len(table), flow[:, l], len(table))
        expected[-1] = 0
        own = (expected + 0.01) / (expected + 0.01).sum(0)
        table = (1 - BACKOFF) * own + BACKOFF * own.mean(1, keepdims=True)
        table[-1] = UNKNOWN
    return table


def _plain(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace").lower() for w in words]


class LanguageModel:
    """Languages, the vocabulary, and its probabilities."""

    def __init__(self, names: list[str], vocabulary: list[str], table: np.ndarray, prior: np.ndarray):
        self.names, self.vocabulary, self.table, self.prior = names, vocabulary, table, prior

    def __getstate__(self):
        return self.names, self.vocabulary, self.table, self.prior

    def __setstate__(self, state):
        self.__init__(*state)

    def words(self) -> common.WordTable:
        pieces = Pieces(self.vocabulary)

        def fill(words: list[bytes]) -> np.ndarray:
            plain = _plain(words)
            letters = [[any(map(str.isalpha, w))] for w in plain]
            return np.hstack([forward(pieces, self.table, plain), np.array(letters, float)])

        return common.WordTable(len(self.names) + 1, fill)

    def score(self, sums: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its probability; evidence grows with the root of the words, as words aren't independent."""
        x = sums / np.sqrt(np.maximum(words, 1))[:, None] + self.prior
        x = np.exp(x - x.max(1, keepdims=True))
        x /= x.sum(1, keepdims=True)
        return x.argmax(1), x.max(1)


def train(labelled: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = SAMPLE_DOCS) -> LanguageModel:
    """Fitted on about ``docs_each`` documents of each language, those of the least id hash; counts cover all rows."""
    rows = labelled.where(f"{lang_col} is not null and {text_col} is not null")
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return LanguageModel([], vocabulary, np.zeros((len(vocabulary) + 1, 0)), np.zeros(0))
    sizes = sorted((r["lang"], r["count"]) for r in sizes)
    share = F.coalesce(*(F.when(F.col(lang_col) == l, F.lit(min(1.0, docs_each / n))) for l, n in sizes))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(4), F.col(id_col)), 33) / F.lit(float(2**31))
    sample = rows.where(hashed < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(2 * docs_each * len(sizes))
    counts = {l: Counter() for l, _ in sizes}
    for lang, text in sample.toLocalIterator():
        counts[lang].update(text.lower().split())
    counts = {l: Counter(dict(c.most_common(SAMPLE_WORDS))) for l, c in counts.items()}
    n = np.array([x for _, x in sizes], float)
    return LanguageModel(list(counts), vocabulary, fit(Pieces(vocabulary), counts), np.log(n / n.sum()))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    ``und`` with score 0.0 if the text is null or has no letter, or no language was learned.  One row per
    input row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary times MOST_LANGUAGES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        words = own.words() if own.names else None
        for rows, raw, offsets in common.scan_rows(batches, 1):
            best, score = np.full(len(rows), -1), np.zeros(len(rows))
            if words is not None:
                starts, ends, first = common.words(raw, offsets)
                number = words.numbers(raw, starts, ends)
                sums = common.sum_by_row(words.values[number], first)
                found = sums[:, -1] > 0.5
                best[found], score[found] = (x[found] for x in own.score(sums[:, :-1], np.diff(first)))
            names = np.array([*own.names, "und"], object)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")
