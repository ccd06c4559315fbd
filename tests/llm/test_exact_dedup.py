import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from claimforge.llm import exact_dedup
from claimforge.llm.exact_dedup import exact_groups


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d))
    out = []
    for d, t in rows:
        plain = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[plain], key=lambda x: (x[0], x[1] is None, x[1]))[1]
        out.append((d, keep, len(groups[plain]), d == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    texts = ["a b", "ab", "a\x0bb", "a b", "", None, " \t", "é", "é", "x" * 90000]
    texts += [rng.choice(["one two", "one  two", "onetwo", "three"]) + rng.choice(["", "\n", "\r\n "]) for _ in range(150)]
    return [(k + 1, t) for k, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = corpus()
    for capacity in (1 << 15, 2):
        got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), capacity=capacity).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a"), (4, "a"), (4, "a"), (None, "b"), (9, "  c"), (8, "c")]
    got = exact_groups(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_directory_splits_only_overfull_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "DEPTH", 5)
    keys = [k << 60 for k in range(-8, 8)] + [(3 << 60) + k for k in range(40)]
    depth, directory = exact_dedup.build_directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity=20)
    slots = {r.slot: r.bucket for r in directory.collect()}
    assert depth == 5 and sorted(slots) == list(range(32))
    assert [slots[k] for k in (0, 4, 6, 7, 8, 16, 31)] == ["3:0", "4:2", "5:6", "5:7", "2:1", "2:2", "2:3"] and len(set(slots.values())) == 7


def test_every_document_finds_its_entry_through_the_directory(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = exact_dedup.build_directory

    def torn(entries, capacity):
        depth, directory = real(entries, capacity)
        return depth, directory.where("slot % 2 = 0")

    monkeypatch.setattr(exact_dedup, "build_directory", torn)
    assert 0 < exact_groups(docs, capacity=2).count() < len(rows)


def test_one_row_of_each_group_by_row_numbers(spark):
    rows = [(k, d, t) for k, (d, t) in enumerate([(None, "a")] * 3 + [(4, "a"), (4, "a"), (None, "b"), (None, "b "), (9, "  c"), (8, "c"), (9, "  c")])]
    got = exact_groups(spark.createDataFrame(rows, "n long, doc_id long, text string").repartition(3), row_col="n").collect()
    assert len(got) == len(rows) and {r.n for r in got if r.kept} == {3, 6, 7}


def test_texts_that_collide_are_told_apart(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    real = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, n: F.when(F.length(c) > -1, F.lit("same")) if isinstance(c, str) else real(c, n))
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(r[:4] for r in brute(rows))
