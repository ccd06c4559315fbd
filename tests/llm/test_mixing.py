import random
import re
from collections import defaultdict

import numpy as np
import pytest

from claimforge.llm.mixing import fit_budget, mix_documents, mix_plan


def water(sizes):
    """Targets by the rule as it is told: share, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * per > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * per for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def corpus(seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(600):
        source = rng.choice(["big"] * 12 + ["a", "b", "é", None, "tiny"] + (["z"] if k < 60 else []))
        text = rng.choice([" ", "\n"]).join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 2, 7, 40, 300]) if source != "tiny" else 1))
        out.append((k, text if k % 97 else None, source))
    return out


def test_matches_the_rule(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mix_plan(docs).collect()}
    assert len(got) == len(rows)
    sizes, taken, size = defaultdict(int), defaultdict(int), {}
    for d, t, s in rows:
        size[d] = len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        sizes[s] += size[d]
        taken[s] += size[d] * got[d].copies
        assert got[d].size == size[d] and 0 <= got[d].copies <= 3
    target = water(sizes)
    for d, _, s in rows:
        assert got[d].source_size == sizes[s] and got[d].target == pytest.approx(target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = {r.doc_id: r.copies for r in mix_plan(docs.repartition(3)).collect()}
    assert again == {d: r.copies for d, r in got.items()}
    mixed = mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {d: r.copies for d, r in got.items() if r.copies}


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string, size int"
    assert mix_plan(spark.createDataFrame([], schema)).count() == 0
    assert [r.copies for r in mix_plan(spark.createDataFrame([(1, None, None, 1)], schema)).collect()] == [0]
    rows = [(1, "a b", "s", 1), (1, "a b", "s", 1), (None, "a", "s", 2)]
    assert sorted(r.size * r.copies for r in mix_plan(spark.createDataFrame(rows, schema)).collect()) == [1, 2, 2]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "a b", "s", k, "x") for k in range(9)], "doc_id long, text string, source string, _id int, copies string")
    got = mix_documents(docs)
    assert got.columns == docs.columns and all(r._id == r.doc_id and r.copies == "x" for r in got.collect())


def test_fit_is_as_near_as_can_be():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 30, 6))
        counts = rng.integers(0, 4, len(lengths))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, 200))
        taken = fit_budget(lengths, counts, budget)
        assert (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(int(s) - budget) for s in sums)


def test_fit_of_large_budgets():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(1, 20000), rng.integers(0, 50, 19999)
    total = int((lengths * counts).sum())
    for budget in (total // 3, total - 7, 70000):
        taken = fit_budget(lengths, counts, budget)
        assert (taken <= counts).all() and int((taken * lengths).sum()) == budget
