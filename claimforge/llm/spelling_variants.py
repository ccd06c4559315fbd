"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

One edit leaves one half of a word as it was: near words hold the first half of the other at their beginning or
its second half at their end.  Each half goes to the shard of its kind and outermost three letters, each word to
the two shards where a half of it can be; a shard's automaton holds its halves, all its words are scanned,
matches are kept by the place of the half and the length of the word, and then the rest of both is compared.
A shard with more halves than fit one automaton is split into parts by a hash, and its words go to each; if they are
too many for one task, they are split, too, and each part of the halves goes to each part of the words.

Nothing lists pairs: every scan sums up how many near words a word has and which one is the most frequent.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import common
from claimforge.session import ensure_checkpoint_dir

#: Fewest letters and occurrences of a word; how much more frequent a form is than its variant.
LETTERS, LEAST, TIMES = 6, 5, 5
#: Of the occurrences' hashes, one in so many loses a letter.
EDITED = 199
#: Letters by which halves are dealt to shards; a half has as many at least.
EDGE = LETTERS // 2
#: Halves of an automaton and words that one task scans with it, about; pairs compared at once.
PART, BLOCK, PAIRS = 20_000, 200_000, 1 << 20
#: Letters of the longest word that is scanned letter by letter.
LONG = 200
#: Letters of words that a counting task holds before it hands its counts on.
HELD = 8_000_000

#: Latin-1 bytes: letters with A-Z lowered, a space for every other byte.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lowered, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def count_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = LETTERS) -> DataFrame:
    """``word, n`` of all runs of ``fewest`` letters or more in all texts, one letter gone where the hash of id and run says so.

    A null text has no runs; a null id is written as nothing before the colon.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        held = 0

        def hand_on() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in found.items() if n and len(w) >= fewest]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                key = key.as_py()
                begun, own = crc(b":" if key is None else b"%d:" % key), Counter(runs(text))
                for word, n in [*own.items()]:
                    h = crc(word if word.isascii() else word.decode("latin-1").encode("utf-8"), begun)
                    if h % EDITED == 0:
                        at = h % len(word)
                        del own[word]
                        found[word[:at] + word[at + 1:]] += n
                before = len(found)
                found.update(own)
                held += (len(found) - before) * 12 if len(found) - before < 10_000 else sum(map(len, own))
                if held > HELD:
                    yield hand_on()
                    found.clear()
                    held = 0
        yield hand_on()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """``kind, edge, half, word, n``: a word's first half ('a') and second half ('z'); the second is the longer one."""
    size = F.length("word")
    cut = F.floor(size / 2).cast("int")
    a = F.struct(F.lit("a").alias("kind"), F.substring("word", 1, EDGE).alias("edge"), F.substring(F.col("word"), F.lit(1), cut).alias("half"))
    z = F.struct(F.lit("z").alias("kind"), F.expr(f"right(word, {EDGE})").alias("edge"), F.substring(F.col("word"), cut + 1, size).alias("half"))
    return words.select("word", "n", F.explode(F.array(a, z)).alias("x")).select("x.*", "word", "n")


def _edges(words: DataFrame) -> DataFrame:
    """``kind, edge, word``: where a word may hold the first ('a') or second ('z') half of another."""
    a = F.struct(F.lit("a").alias("kind"), F.substring("word", 1, EDGE).alias("edge"))
    z = F.struct(F.lit("z").alias("kind"), F.expr(f"right(word, {EDGE})").alias("edge"))
    return words.select("word", F.explode(F.array(a, z)).alias("x")).select("x.*", "word")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: for each word with near words, how many, and the most frequent (ties: least in code-point order).

    ``words`` is ``word, n``, each word once, of ``LETTERS`` letters at least, all below U+0100.
    """
    owned = halves(words)
    crowded = owned.groupBy("kind", "edge").count().where(F.col("count") > PART)
    split = common.broadcast_if_small(crowded.select("kind", "edge", *(F.ceil(F.col("count") / size).cast("int").alias(name) for name, size in (("parts", PART), ("blocks", BLOCK)))).checkpoint())
    parts, blocks = (F.coalesce(name, F.lit(1)) for name in ("parts", "blocks"))
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    own = lambda count: F.pmod(F.hash("word"), count)
    owned = owned.join(split, ["kind", "edge"], "left").select("kind", "edge", own(parts).alias("part"), every(blocks).alias("block"), F.lit(0).alias("role"), "half", "word", "n")
    scanned = _edges(words).join(split, ["kind", "edge"], "left").select(
        "kind", "edge", every(parts).alias("part"), own(blocks).alias("block"), F.lit(1).alias("role"), F.lit(None).cast("string").alias("half"), "word", F.lit(None).cast("long").alias("n"))
    shard = ["kind", "edge", "part", "block"]
    dealt = owned.unionByName(scanned).repartition(common.shuffle_partitions(words), *shard).sortWithinPartitions(*shard, "role")
    found = dealt.mapInArrow(_scan_shards, "word string, n_near long, n long, near string")
    strongest = F.min_by(F.struct(F.col("n").alias("n"), F.col("near").alias("word")), F.struct(-F.col("n"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), strongest.alias("best"))


def _scan_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, the halves before the words."""
    shard = None
    for batch in batches:
        halves_, words, n = (batch.column(k).to_pylist() for k in (5, 6, 7))
        role = batch.column(4).to_numpy()
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at] and role[end] == role[at]:
                end += 1
            if shard is None or shard.key != keys[at]:
                if shard is not None:
                    yield from shard.results(True)
                shard = _Shard(keys[at])
            if role[at] == 0:
                shard.add(halves_[at:end], words[at:end], n[at:end])
            else:
                shard.scan(words[at:end])
                yield from shard.results(False)
            at = end
    if shard is not None:
        yield from shard.results(True)


class _Shard:
    def __init__(self, key: tuple):
        self.key, self.first = key, key[0] == "a"
        self.own: dict[str, list[int]] = {}
        self.words: list[str] = []
        self.n: list[int] = []
        self.waiting: list[str] = []
        self.automaton = None
        self.out: list[tuple] = []

    def add(self, halves_: list[str], words: list[str], n: list[int]) -> None:
        for half, word in zip(halves_, words):
            self.own.setdefault(half, []).append(len(self.words))
            self.words.append(word)
        self.n += n

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for half, numbers in self.own.items():
            self.automaton.add_word(half, (len(half), np.array(numbers, np.int64)))
        if self.own:
            self.automaton.make_automaton()
        self.counts = np.array(self.n, np.int64)
        self.rests = _Rests([w[len(w) // 2:] if self.first else w[:len(w) // 2] for w in self.words], self.first)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        order = sorted(range(len(self.words)), key=lambda k: (-self.n[k], self.words[k]))
        self.place = np.empty(len(order), np.int64)  # the strongest word is first
        self.place[order] = np.arange(len(order))
        self.by_place = order

    def scan(self, words: list[str]) -> None:
        if self.automaton is None:
            self._build()
        if not self.own:
            return
        who, what, sizes, rests, size = [], [], [], [], 0
        for word in words:
            long = len(word)
            for stop, (of_half, numbers) in self.automaton.iter(word) if long <= LONG else self._ask(word):
                if stop - of_half + 1 != 0 if self.first else stop != long - 1:
                    continue  # the half isn't where it must be
                if abs(2 * of_half - long) > 2:
                    continue  # no word with such a half is as long as this one, give or take a letter
                who.append(word)
                rests.append(word[of_half:] if self.first else word[:long - of_half])
                what.append(numbers)
                sizes.append(long)
                size += len(numbers)
                if size >= PAIRS:
                    self._verify(who, rests, what, sizes)
                    who, what, sizes, rests, size = [], [], [], [], 0
        if who:
            self._verify(who, rests, what, sizes)

    def _ask(self, word: str) -> Iterator[tuple[int, tuple]]:
        """Matches of a very long word, whose half can have three lengths: a repeated letter's failure links make scans quadratic."""
        long = len(word)
        for size in sorted({(long + k) // 2 if self.first else long + k - (long + k) // 2 for k in (-1, 0, 1)}):
            half = word[:size] if self.first else word[long - size:]
            if (match := self.automaton.get(half, None)) is not None:
                yield size - 1 if self.first else long - 1, match

    def _verify(self, who: list[str], rests: list[str], what: list[np.ndarray], sizes: list[int]) -> None:
        counts = np.array([len(x) for x in what])
        mine, theirs = np.repeat(np.arange(len(who)), counts), np.concatenate(what)
        differ = np.array(sizes)[mine] - self.sizes[theirs]
        fits = np.abs(differ) <= 1
        mine, theirs, differ = mine[fits], theirs[fits], differ[fits]
        own = _Rests(rests, self.first)
        near = own.one_edit(mine, self.rests, theirs)
        mine, theirs, differ = mine[near], theirs[near], differ[near]
        if not self.first:  # where both halves fit, the shard of first halves has counted the pair
            again = np.fromiter((who[a].startswith(self.words[b][:len(self.words[b]) // 2]) for a, b in zip(mine.tolist(), theirs.tolist())), bool, len(mine))
            mine, theirs = mine[~again], theirs[~again]
        if not len(mine):
            return
        starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        totals, best = np.diff(np.append(starts, len(mine))), np.minimum.reduceat(self.place[theirs], starts)
        for a, total, place in zip(mine[starts].tolist(), totals.tolist(), best.tolist()):
            k = self.by_place[place]
            self.out.append((who[a], total, self.n[k], self.words[k]))

    def results(self, all_: bool) -> Iterator[pa.RecordBatch]:
        if self.out and (all_ or len(self.out) >= 10_000):
            word, total, n, near = zip(*self.out)
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(total, pa.int64()), pa.array(n, pa.int64()), pa.array(near, pa.string())], ["word", "n_near", "n", "near"])


class _Rests:
    """What is left of words beside a half, eight letters at a time as numbers, for comparing many pairs at once."""

    def __init__(self, rests: list[str], first: bool):
        self.text = rests
        self.size = np.array([len(x) for x in rests], np.int64)
        plain = [x.encode("latin-1") for x in rests]
        self.head = np.frombuffer(b"".join([x[:8].ljust(8, b"\0") for x in plain]), "<u8")
        self.tail = np.frombuffer(b"".join([x[:-9:-1].ljust(8, b"\0") for x in plain]), "<u8")

    def one_edit(self, mine: np.ndarray, other: _Rests, theirs: np.ndarray) -> np.ndarray:
        """Whether exactly one letter is inserted, deleted or replaced between each pair, whose lengths differ by one at most."""
        a, b = self.size[mine], other.size[theirs]
        shorter, longer = np.minimum(a, b), np.maximum(a, b)
        front = np.minimum(_same(self.head[mine], other.head[theirs]), shorter)
        back = np.minimum(_same(self.tail[mine], other.tail[theirs]), shorter)
        near = (front + back >= longer - 1) & ((a != b) | (front < shorter))
        for k in np.flatnonzero((longer > 8) & ((front == 8) | (back == 8))).tolist():  # what eight letters don't decide
            near[k] = one_edit(self.text[mine[k]], other.text[theirs[k]])
        return near


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes of two numbers are the same."""
    odd = x ^ y
    lowest = odd & (~odd + np.uint64(1))
    exponent = np.frexp(lowest.astype(np.float64))[1] - 1
    return np.where(odd == 0, 8, exponent >> 3)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root``: all words of all texts, with the frequent word that each is a spelling of.

    Words are runs of Latin letters (see ``count_runs``) of ``LETTERS`` letters and ``LEAST`` occurrences at least.  A form is the
    most frequent near word, if ``TIMES`` times as frequent as the word.  Repeated rows count again; an empty table or one of
    null texts has no words; other columns don't matter.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    words = count_runs(docs, id_col, text_col).where(F.col("n") >= LEAST).checkpoint()
    near = near_words(words)
    is_form = (F.col("best.n") >= TIMES * F.col("n"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")).checkpoint()
    roots = _roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(chain: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow each word; each round doubles how far a word looks ahead.

    A form is several times as frequent as its word, so chains end, after as many forms as the counts have digits.
    """
    at = chain.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")).checkpoint()
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
    return at.select("word", "root")
