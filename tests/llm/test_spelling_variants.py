"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimforge.llm import spelling_variants as sv


def distance_is_one(a: str, b: str) -> bool:
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, rows[0] = rows[0], i
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
    return rows[-1] == 1


def brute(rows):
    n = Counter()
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    out = {}
    for w in words:
        near = [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and distance_is_one(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * words[w] else None
        out[w] = (form, words[w], len(near), None if form is None else words[form])
    rows = set()
    for w, (form, c, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, c, k, m))
    return rows


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def docs(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, root string")


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=3, max_size=14), st.text("abc", min_size=3, max_size=14))
def test_one_edit(a, b):
    assert sv.one_edit(a, b) == distance_is_one(a, b)
    if abs(len(a) - len(b)) <= 1:
        import numpy as np

        zero = np.zeros(1, np.int64)
        assert sv._Rests([a], True).one_edit(zero, sv._Rests([b], True), zero)[0] == distance_is_one(a, b)


@pytest.mark.parametrize("part, block", [(20_000, 200_000), (3, 2)])
def test_against_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(sv, "PART", part)
    monkeypatch.setattr(sv, "BLOCK", block)
    rng = random.Random(part)
    stems = ["".join(rng.choice("aeinsté×") for _ in range(rng.randint(5, 19))) for _ in range(60)]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([5, 30, 200])
        for _ in range(8):
            k, c = rng.randrange(len(stem)), rng.choice("aeinsté")
            changed = rng.choice([stem[:k] + c + stem[k:], stem[:k] + stem[k + 1:], stem[:k] + c + stem[k + 1:]])
            words += [changed] * rng.choice([1, 4, 5, 6, 40])
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 9:k * 9 + 9]).title() + rng.choice([".", "ā", "\n"])) for k in range(len(words) // 9 + 1)]
    expected = brute(rows)
    assert any(r[1] for r in expected)
    assert found(sv.variants(docs(spark, rows).repartition(3))) == expected


def test_chains_ties_nulls_and_repeats(spark):
    chain = [("abcdefgh", 5), ("abcdefgx", 25), ("abcdefyx", 125), ("abcdezyx", 700), ("zzzzzzab", 5), ("zzzzzzac", 25), ("zzzzzzad", 25)]
    rows = [(1, "abcdef " * 5), (1, "abcdef " * 5), (None, "nothing nothing nothing nothing nothing"), (5, None), (6, ""), (7, "q" * 300_000), (8, "ÉcoleÀ " * 6)]
    rows += [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain, 20)]
    rows += [(k, " ".join(["q" * 300_000] * 2)) for k in (40, 41)]
    rows += [(k, " ".join([x + "ab" * 200 + y] * n)) for k, x, y, n in ((50, "c", "", 5), (51, "", "", 30), (52, "", "d", 6), (53, "a", "", 7))]
    expected = brute(rows)
    got = found(sv.variants(docs(spark, rows)))
    assert got == expected
    roots = {r[0]: r[2] for r in got}
    assert roots["abcdefgh"] == roots["abcdefyx"] == "abcdezyx" and roots["zzzzzzab"] == "zzzzzzac"


def test_empty_table(spark):
    assert found(sv.variants(docs(spark, []))) == set()


def test_registered_query(spark):
    from claimforge.llm.queries import QUERIES

    df = QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(df) == brute(rows)
