"""Tiered search against brute force over all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from claimforge.llm import common
from claimforge.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 50 + (50 * c.total() * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, k, None if null else key, -score) for k, (score, null, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, score int, docs int").repartition(3),
            spark.createDataFrame([(a, b, 3) for a, b in items], "item_id long, text string, rank int"))


def searched(spark, docs, items, top=ls.TOP):
    return sorted(map(tuple, ls.rank_documents(*frames(spark, docs, items), top=top).collect()), key=str)


def corpus(seed, documents=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([3, 30, 120])))) for k in range(documents)]
    items = [(k, " ".join(rng.choices(words, weights, k=8))) for k in range(12)] + [(50, "w290 w0"), (51, "w0"), (52, "unheard of")]
    return docs, items


@pytest.mark.parametrize("docs_each, top", [(4096, 50), (16, 5), (1, 3)])
def test_against_brute_force(spark, monkeypatch, docs_each, top):
    monkeypatch.setattr(ls, "SEGMENT_DOCS", docs_each)
    docs, items = corpus(docs_each)
    assert searched(spark, docs, items, top) == brute(docs, items, top)


def test_items_without_proof_fall_through(spark, monkeypatch):
    docs, items = corpus(5)
    levels = []
    exact = ls._exact
    monkeypatch.setattr(ls, "_exact", lambda rows, known, floor, level, top: levels.extend(level) or exact(rows, known, floor, level, top))
    assert searched(spark, docs, items, 5) == brute(docs, items, 5)
    assert {0, ls.TIERS - 1} <= set(levels)  # some are proven by the first tier, some by none


def test_blocks_of_items_and_of_sums(spark, monkeypatch):
    monkeypatch.setattr(ls, "ITEMS", 4)
    monkeypatch.setattr(ls, "SUMS", 100)
    docs, items = corpus(6, 120)
    assert searched(spark, docs, items) == brute(docs, items, 50)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, "Äpfel äpfel straße ÄPFEL"), (5, "same text"), (5, "same text"), (None, "same text"), (6, "same text"), (7, "long " * 300_000),
            (8, "x" * 200_000), (9, "a1b2 C3-d4_e5")]
    items = [(1, "SAME text"), (1, "SAME text"), (2, None), (None, "long x"), (3, "ÄPFEL c3 e5"), (4, "x" * 200_000), (5, "-")]
    assert searched(spark, docs, items) == brute(docs, items, 50)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")]) == []


def test_terms_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(common, "mix", lambda x: x)
    monkeypatch.setattr(common, "word_hashes", lambda raw, starts, weights=None: np.zeros(len(starts), np.uint64))
    raw = np.frombuffer(b"b a b c a", np.uint8)
    batch = ls._segment(ls.pa.array([7]), raw, np.array([0, len(raw)]), 1, 5)
    segment = ls._Segment(batch, 0, ls._Block([(1, {b"a", b"c", b"zz"})]))
    assert sorted(segment.df[segment.own].tolist()) == [1, 1] and len(segment.df) == 3
    assert sorted(segment.postings(0)[3].tolist()) == sorted(ls.worth(np.array([2, 1]), np.array([5, 5]), 1, 5).tolist())


def test_registered_query_and_its_sql(spark):
    from claimforge.llm.queries import QUERIES, SQL

    at = "/root/testdata/sf0.001"
    df = QUERIES["op12_lexical_search"](spark, at)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = sorted(map(tuple, df.collect()))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    assert rows == sorted(db.execute(SQL["op12_lexical_search"]).fetchall())
    docs, items = ([tuple(r) for r in db.execute(f"SELECT {key}, text FROM {name}").fetchall()] for key, name in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert sorted(rows, key=str) == brute(docs, items, 50)
