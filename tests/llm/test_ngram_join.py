import random
import re

import pytest

from claimforge.llm.ngram_join import divide_skip, merge_skip, ngram_jaccard_components

import numpy as np


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and common and 100 * common >= 80 * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()) + str(rng.randrange(40))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for k in range(14):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = word()
            text = rng.choice([" ", "\n", "\t "]).join(own)
            rows.append(text.upper() if rng.random() < 0.2 else text)
        rows.append(passage + " " + " ".join(word() for _ in range(rng.randrange(2, 60))))
    rows += ["", None, " \n ", "one", "One", "één twee", "één twee"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4)])
def test_matches_brute_force(spark, seed, block):
    rows = corpus(seed)
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_odd_rows(spark):
    rows = [(None, "a b", 1), (1, "a b", 2), (1, "a b", 2), (2, None, 3), (3, "x " * 30000, 4), (4, "x " * 29000, 5)]
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None), (1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)], key=str)


def test_tasks_with_the_same_rows(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_jaccard_components(docs.union(docs)).collect()
    want = [(d, n, c) for d, (n, c) in brute(rows).items()]
    assert sorted(map(tuple, got)) == sorted(want * 2)


def test_empty_table(spark):
    assert ngram_jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lists = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(rng.integers(1, 30))]
        counts = np.bincount(np.concatenate(lists), minlength=60)
        for least in (1, 2, 5, 11):
            assert merge_skip([x.tolist() for x in lists], least) == {i: c for i, c in enumerate(counts) if c >= least}
            if least <= len(lists):
                found, short, long = divide_skip(lists, least, 60)
                assert set(np.flatnonzero(counts >= least)) <= set(found.tolist())


def test_bands_and_blocks_of_one_component(spark):
    """A component of many sizes and cells: a passage that documents of all lengths share, and near copies of each length."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for n in (0, 2, 5, 8, 12, 20, 40, 90, 200):
        base = passage + [f"x{n}y{k}" for k in range(n)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (3, 1024):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs, block=block).collect()} == brute(rows)
    assert {r.component_id for r in ngram_jaccard_components(docs, block=2, threshold=100).collect()} == {
        min(d for d, t in rows if shingles(t) == shingles(own)) for _, own in rows}


def test_owners_are_packed_either_way():
    from claimforge.llm.ngram_join import _owners, _packed

    for docs in (1, 3, 500):
        owner = np.sort(np.random.default_rng(docs).integers(0, docs, 40))
        assert (_owners(_packed(owner, docs)) == owner).all()
    assert len(_owners(_packed(np.zeros(0, np.int64), 9))) == 0


def test_little_memory_is_held_besides_a_run(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from claimforge.llm import ngram_join

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(ngram_join, "TaskContext", Context)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(7000)) for _ in range(100)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        sent = sum(x.num_rows for x in ngram_join._send(5, 16)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent == 17
    assert peak < 80 << 20
