"""The pipeline, stage by stage, against brute-force versions on the smallest tables."""

from collections import defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from claimforge.llm import bpe
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_mixing import water
from tests.llm.test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = before, docs.collect()

    before, after = seen["toxicity"]
    kept = {r.doc_id for r in after}
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean) and len(kept) < len(before)

    before, after = seen["exact dedup"]
    assert {r.doc_id for r in after} == {r[0] for r in exact_brute([(d, r.text) for d, r in before.items()]) if r[3]}

    before, after = seen["n-gram Jaccard join"]
    assert {r.doc_id for r in after} == {d for d, (_, c) in near_brute([(d, r.text) for d, r in before.items()]).items() if c == d}

    before, after = seen["mixing sources"]
    words = {d: len((r.text or "").split()) for d, r in before.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, r in before.items():
        sizes[r.source] += words[d]
    for r in after:
        taken[r.source] += words[r.doc_id]
    target = water(sizes)
    longest = {s: max(words[d] for d, r in before.items() if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)

    before, after = seen["byte-level BPE"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.parse(bpe.load_ranks(path)).ranks, special_tokens={})
    assert after and all(list(r.ids) == library.encode_ordinary(before[r.doc_id].text or "") for r in after)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "no id", None, "s", 5), (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "A b c d e f", "en", "t", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            kept = {r.doc_id for r in docs.collect()}
            assert kept == ({None, 1, 2, 3, 4}, {None, 1, 3, 4}, {None, 1, 3})[k]
    assert {r.doc_id for r in docs.collect()} <= {None, 3}


def test_rows_are_decided_one_by_one(spark, tmp_path):
    text, near = "one two three four five six", " ".join(f"w{k}" for k in range(60))
    rows = [(None, text)] * 3 + [(7, text), (7, text), (5, near), (5, near + " more"), (6, near), (6, "another clean text"), (None, near), (8, "last one"), (8, "last  one!")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:3]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got.append(sorted((r.doc_id or 0, r.text) for r in docs.collect()))
    rest = [(6, "another clean text"), (7, text), (8, "last  one!"), (8, "last one")]
    assert got[0] == sorted([(5, near), (5, near + " more"), *rest])
    assert len(got[1]) == 5 and got[1][1:] == rest and got[1][0][0] == 5
    seen = corpus_pipeline.numbered(spark.createDataFrame([(9, "rejected", "en", "s", 1), (9, text, "en", "s", 1)], docs.schema))
    left = corpus_pipeline.without(seen, seen.where(seen.text == "rejected").select("_row")).collect()
    assert [(r.doc_id, r.text) for r in left] == [(9, text)]  # a row of a rejected one's id stays
