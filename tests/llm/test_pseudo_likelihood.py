import math
import random
import time
from collections import Counter

import numpy as np

from claimforge.llm import pseudo_likelihood as pl


def texts():
    rng = random.Random(1)
    return [" ".join(rng.choice(["the cat sat", "a dog ran", "one two three"]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]


def test_counts_cover_every_word(spark):
    rows = [*texts(), "", None, "The\tTHE"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(4)
    got = sorted(r.n for r in pl.word_counts(docs).collect())
    assert got == sorted(Counter(w.lower() for t in rows for w in (t or "").split()).values())


def test_scores_are_sums_of_conditionals(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    model = pl.fit(docs)
    got = {r.doc_id: r for r in pl.score(docs, model).collect()}
    for k, t in enumerate(texts()[:20]):
        raw = np.frombuffer(t.encode(), np.uint8)
        hashes, first = pl.hashed_words(raw, np.array([0, len(raw)]))
        ids, total = model.ids(hashes), 0.0
        for i, own in enumerate(ids):
            hidden = model.inner_bias.astype(float)
            for side, j in enumerate([i - 1, i - 2, i + 1, i + 2]):
                near = ids[j] if 0 <= j < len(ids) else len(model.words) + 1
                hidden = hidden + model.embedding[near].astype(float) @ model.inner[side]
            logits = np.tanh(hidden) @ model.outer + model.outer_bias
            kind = np.append(pl.CLASSES, model.kind)[own]
            total += logits[kind] - math.log(np.exp(logits).sum()) + math.log(np.append(model.rest, model.share)[own])
        assert got[k].n_words == len(ids) and abs(got[k].log_prob - total) < 1e-3 * abs(total) + 1e-3
    order = spark.createDataFrame([(1, "the cat sat a dog ran one two three"), (2, "sat the three ran cat two one dog a"), (3, None), (None, " "), (5, "the " * 50000)], "doc_id long, text string")
    scored = {r.doc_id: r for r in pl.score(order, model).collect()}
    assert scored[1].log_prob > scored[2].log_prob
    assert (scored[3].n_words, scored[3].log_prob, scored[None].log_prob) == (0, 0.0, 0.0) and scored[5].n_words == 50000
    empty = pl.fit(docs.limit(0))
    assert pl.score(docs.limit(0), empty).count() == 0


def test_whole_corpus_counts(spark, monkeypatch):
    monkeypatch.setattr(pl, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(pl, "VOCABULARY", 4)
    monkeypatch.setattr(pl, "TRAIN_BYTES", 4000)
    rng = random.Random(3)
    sizes = []
    trained = pl.train
    monkeypatch.setattr(pl, "train", lambda model, sample, tasks: (sizes.append((sample.count(), len(model.words), tasks)), trained(model, sample, tasks)))
    rows = [(k, " ".join(rng.choice(["left one", "right two"]) for _ in range(30))) for k in range(1600)]
    model = pl.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    pl.fit(spark.createDataFrame([(k, f"{t} w{k % 40}") for k, t in rows * 4], "doc_id long, text string"))
    assert sizes[0][0] >= 60 and sizes[1][0] >= 3 * sizes[0][0] and sizes[1][1] > sizes[0][1]  # grow with the corpus
    assert sizes[0][2] > 1


def test_every_document_trains_the_network(spark, monkeypatch):
    monkeypatch.setattr(pl, "SAMPLE_DOCS", 20)
    rows = [(k, f"the cat w{k} sat") for k in range(1600)]
    model = pl.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    fresh = pl.WindowModel(model.words, model.kind, model.share, model.rest)
    raw = "".join(f" w{k}" for k, _ in rows).encode()
    own = model.ids(pl.hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
    assert (own > 0).all()
    assert (model.embedding[own] != fresh.embedding[own]).any(1).all()  # each of these words is in one document


def test_neighbours_tell_words_of_a_class_apart(monkeypatch):
    monkeypatch.setattr(pl, "CLASSES", 1)
    rng = np.random.default_rng(2)
    model = pl.WindowModel(np.arange(4, dtype=np.uint64), np.zeros(4, int), np.full(4, 0.25), 1.0)
    ids = np.array([[1, 2], [3, 4]])[rng.integers(0, 2, 20000)].ravel()
    first = np.arange(0, len(ids) + 1, 2)
    pl.Trainer(model, [1]).train(ids, first)
    right, wrong = (model.log_probabilities(np.array(x), np.array([0, 2])).sum() for x in ([1, 2], [1, 4]))
    assert right > wrong + 2


def test_trees_hold_the_shares():
    kind, share = np.array([0, 1, 1, 1, 1, 2, 2]), np.array([1.0, 0.5, 0.2, 0.2, 0.1, 0.9, 0.1])
    begins, path, branch, odds = pl.class_trees(kind, share)
    signed = np.where(branch == 1, -1, 1) * odds[path]
    got = [math.exp(-np.logaddexp(0, signed[a:b]).sum()) for a, b in zip(begins, begins[1:])]
    assert np.allclose(got, share, atol=1e-5) and begins[1] == begins[0]


def test_gradients_are_summed_by_row():
    rng = np.random.default_rng(4)
    for n, most in ((1, 5), (16, 1), (1000, 3), (5000, 200_000), (9000, 900)):
        rows = (most * rng.random(n) ** 3).astype(np.int32)
        values, of, factors = rng.normal(size=(300, 5)).astype(np.float32), rng.integers(0, 300, n), rng.normal(size=n).astype(np.float32)
        for f, v, o in ((factors, values, of), (None, values[of], None)):
            distinct, sums = pl.row_sums(rows, f, v, o)
            want = np.zeros((most, 5))
            np.add.at(want, rows, values[of] * (1 if f is None else f[:, None]))
            assert (distinct == np.unique(rows)).all() and np.allclose(sums, want[distinct], atol=1e-3)


def test_a_frequent_row_is_summed_as_exactly_as_a_rare_one():
    n = 400_000
    values = np.full((1, 5), 0.1, np.float32)
    distinct, sums = pl.row_sums(np.append(np.full(n, 3), 7).astype(np.int32), None, values, np.zeros(n + 1, np.int64))
    assert distinct.tolist() == [3, 7]
    assert np.allclose(sums, [[0.1 * n], [0.1]], rtol=1e-5, atol=0)


def test_rows_are_put_whole():
    rng = np.random.default_rng(7)
    for columns in (1, 16, 33):
        got = rng.normal(size=(500, columns)).astype(np.float32)
        want, rows, values = got.copy(), rng.permutation(500)[:200], rng.normal(size=(columns, 200))
        want[rows] = values.T
        pl.put_rows(got, rows, values.T)  # neither of its type nor side by side in memory
        assert (got == want).all()


def test_putting_rows_is_faster_than_by_numbers():
    into, values, rows = np.zeros((40000, 16), np.float32), np.ones((6000, 16), np.float32), np.arange(6000) * 6

    def seconds(put):
        def once():
            began = time.perf_counter()
            put()
            return time.perf_counter() - began

        return min(once() for _ in range(50))

    assert seconds(lambda: pl.put_rows(into, rows, values)) < 0.8 * seconds(lambda: into.__setitem__(rows, values))


def test_large_weights_do_not_overflow():
    model = pl.WindowModel(np.arange(4, dtype=np.uint64), np.array([0, 0, 1, 1]), np.full(4, 0.5), 1.0)
    ids, first = np.array([1, 2, 3, 4]), np.array([0, 4])
    model.outer_bias[:] = 10
    small = model.log_probabilities(ids, first)
    model.outer_bias[:] = 5000  # the same for all classes
    large = model.log_probabilities(ids, first)
    assert np.isfinite(large).all() and np.allclose(small, large, atol=1e-2)


def test_ids_are_found_by_hash():
    rng = np.random.default_rng(5)
    for words in (np.arange(40, dtype=np.uint64), np.unique(rng.integers(0, 2**64, 3000, np.uint64)), np.array([7, 2**64 - 1], np.uint64)):
        model = pl.WindowModel(words, np.zeros(len(words), int), np.full(len(words), 1 / len(words)), 1.0)
        hashes = np.concatenate([words, words + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
        number = {w: k + 1 for k, w in enumerate(words.tolist())}
        assert model.ids(hashes).tolist() == [number.get(h, 0) for h in hashes.tolist()]


def test_hashes_are_of_the_whole_word():
    rng = np.random.default_rng(6)
    words = [b"a", b"a\x00", b"\x00", b"x" * 5000, *(b"a" * k for k in range(2, 60)), *(bytes(rng.integers(97, 100, rng.integers(1, 50)).astype(np.uint8)) for _ in range(3000))]
    words += words[::3]
    raw, n = np.frombuffer(b" ".join(words), np.uint8), np.array([len(w) for w in words])
    starts = np.cumsum(n + 1) - n - 1
    hashes = pl.common.plain_hashes(raw, starts, starts + n).tolist()
    assert len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))
    assert len(pl.common.plain_hashes(raw[:0], starts[:0], starts[:0])) == 0
