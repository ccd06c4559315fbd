import itertools

import numpy as np
import pytest

from claimforge.llm import toxicity as tx


def test_marginals_by_enumeration():
    move, bias = np.array([[0.1, -1.2], [0.3, -0.4]]), -0.7
    model = tx.ToxicityModel({}, bias, move, np.zeros(3))
    rng = np.random.default_rng(1)
    rows = [(7, [1, 2, 5]), (4, [0]), (3, []), (6, [5]), (8, [0, 7])]
    emission = rng.normal(size=sum(len(a) for _, a in rows)) * 2
    at = np.array([p for _, a in rows for p in a])
    first = np.cumsum([0, *(len(a) for _, a in rows)])
    got = model.marginals(emission, at, first, np.array([n for n, _ in rows]))
    for k, (n, places) in enumerate(rows):
        own = dict(zip(places, emission[first[k]:first[k + 1]]))
        total, hit = 0.0, dict.fromkeys(places, 0.0)
        for tags in itertools.product((0, 1), repeat=n):
            x, before = 0.0, 0
            for p, t in enumerate(tags):
                x += move[before, t] + (own.get(p, bias) if t else 0)
                before = t
            total += np.exp(x)
            for p in places:
                hit[p] += np.exp(x) * tags[p]
        for j, p in enumerate(places):
            assert got[first[k] + j] == pytest.approx(hit[p] / total)


def test_held_out_accuracy_and_spans(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = tx.train_on_labels(docs, labels)
    rows = tx.score(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("toxic", "score", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in rows)
    assert right >= 0.97 * len(rows) and 0 < sum(r.toxic for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "you stupid Idiot! ok"), (4, "the " * 50000 + "moron")], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in tx.score(odd, model).collect()}
    assert got[1] == got[2] and got[1][1] == 0 and all(0 <= s <= 1 for s, _ in got.values())
    assert got[None][1] == 1
    found = {(r.doc_id, r.start, r.stop, r.text) for r in tx.spans(odd, model).collect()}
    assert found == {(None, 4, 10, "stupid"), (None, 11, 17, "Idiot!"), (4, 200000, 200005, "moron")}


def test_without_labels(spark):
    schema = "doc_id long, text string, toxic int"
    none = tx.train(spark.createDataFrame([], schema))
    one = tx.train(spark.createDataFrame([(1, "a", 0), (2, None, 1), (None, "b", None)], schema))
    docs = spark.createDataFrame([(1, "a", 1)], schema)
    for model in (none, one):
        assert [(round(r.score, 6), r.predicted) for r in tx.score(docs, model).collect()] == [(0.0, 0)]
    assert tx.score(docs.limit(0), none).count() == 0
