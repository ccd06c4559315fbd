import hashlib
import random
import re
import unicodedata

import xxhash

from claimforge.llm.fingerprints import fingerprints, with_next


def canon(text):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"[\s\u0085   -     　]+", " ", n(n(text).casefold())).strip(" ")


def digest(text):
    data = canon(text).encode()
    return "".join(f"{xxhash.xxh64_intdigest(x, seed=42):016x}" for x in (data, b"\x01" + data))


def brute(rows):
    rows = sorted((d, t or "") for d, t in rows)
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited),
                    float(digest(t) == digest(edited)), float(digest(t) == digest(after))))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = ["Straße  ÀÉ", "strasse àé", "ﬁ ①", "FI 1", "", None, "a\n\tb", " A b ", "\U0001f600" * 9, "z" * 70000]
    rows = [(7 * k, t) for k, t in enumerate(texts)]
    rows += [(1000 + k, "".join(rng.choice("abÉ é\nß") for _ in range(rng.randrange(12)))) for k in range(120)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(spark):
    one = fingerprints(spark.createDataFrame([(1, "abcd", 3)], "doc_id long, text string, fingerprint int")).collect()
    assert tuple(one[0]) == brute([(1, "abcd")])[0][:3] + (digest("abcd"), digest("abca"), 0.0, 1.0)
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "n"), (1, "a"), (1, "a"), (2, "b")]
    got = with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.next) for r in got) == [("a", "a"), ("a", "b"), ("b", "n"), ("n", "a")]


def test_ids_that_fill_many_ranges(spark):
    rows = [(None, f"n{k}") for k in range(300)] + [(5, f"five {k}") for k in range(200)] + [(k, f"t{k}") for k in range(6, 100)] + [(-3, "low")]
    got = {r.text: r.next for r in with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    at, seen = "low", []
    for _ in rows:
        seen.append(at)
        at = got[at]
    assert at == "low" and len(set(seen)) == len(rows)
    assert seen[201:295] == [f"t{k}" for k in range(6, 100)] and {x[:4] for x in seen[1:201]} == {"five"}
