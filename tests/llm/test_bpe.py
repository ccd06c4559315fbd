import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from claimforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN = bpe.Vocabulary.parse(bpe.load_ranks(PATH))
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)


def rows(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def cut(texts):
    raw, offsets = rows(texts)
    starts, first = bpe.pieces(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    return [[raw[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("'' \n\t srvltmdexZé9²٣!-.漢 　\U0001f600"), max_size=40), max_size=5))
def test_boundaries_are_the_patterns(texts):
    assert cut(texts) == [PATTERN.findall(t) for t in texts]


@pytest.mark.parametrize("size", [511, 512, 513, 1024, 1025])
def test_blocks_join(size):
    rng = random.Random(size)
    for _ in range(30):
        text = "".join(rng.choice("'' rvlstex9!\n") for _ in range(size))
        assert cut([text, "'r", text[::-1]]) == [PATTERN.findall(t) for t in (text, "'r", text[::-1])]


def test_ids_are_tiktokens():
    rng = random.Random(7)
    texts = ["", "it's we're I'LL 'tis  \n\n  x", "<|endoftext|>", "a" * 3000, "é" * 400, " " * 999 + "x"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(300))) for _ in range(200)]
    raw, offsets = rows(texts)
    got = list(OWN.encode_rows(raw, offsets))
    assert got == [THEIRS.encode_ordinary(t) for t in texts]
    assert [OWN.decode(x).decode() for x in got] == texts


def test_long_and_short_merges_agree():
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("thereandingé") for _ in range(rng.randrange(1, 60))).encode()
        assert OWN._merge(piece) == OWN._merge_long(piece)


def test_frames(spark):
    texts = [(1, "Hello world's", "x"), (2, None, "x"), (2, "", None), (None, " two  ", "x"), (5, "z " * 50000, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in bpe.encode(docs, PATH).where("doc_id <> 2 or doc_id is null").collect()}
    assert found[1].ids == THEIRS.encode_ordinary(texts[0][1]) and found[1].starts[0] == 0 and len(found[1].starts) == len(found[1].ids)
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()) == sorted((d or 0, t or "") for d, t, _ in texts)
    got = bpe.digests(docs, PATH).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
        (d or 0, len(ids := THEIRS.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for d, t, _ in texts)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
