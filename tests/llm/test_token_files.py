import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from claimforge.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.integers(0, 40, n), np.zeros(n), np.tile(rng.integers(0, 49408, 700), 20)[:n], (rng.pareto(1, n) * 50).astype(int) % 49408):
        data = token_files.encode_ids(ids)
        assert (token_files.decode_ids(data) == ids).all()


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(1).integers(0, 49408, 200), 50)
    assert len(token_files.encode_ids(ids)) < 0.5 * 2 * len(ids)


def test_damage_is_found():
    data = bytearray(token_files.encode_ids(np.random.default_rng(2).integers(0, 49408, 5000)))
    data[-900] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_ids(bytes(data))
    with pytest.raises(ValueError):
        token_files.decode_ids(b"x" * 60)


def brute(rows):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_are_the_librarys_ids(spark, tmp_path):
    rng = random.Random(1)
    texts = ["", None, "Hello WORLD's it's", "<|endoftext|> x", "é é İstanbul ΣΑΣ ſ", "a b c　d\x1ce", "w " * 40000, "'s 't 12 3!?", "a\x00b \x1cx\x7f y", "x=\u0338 e\u0301, \"'s\" ''s 're' rock'n'roll a'b.c'd 3'd 3.5's '12' “q's” ½x","Ab3,c-d'E's'f..'"]
    texts += [" ".join("".join(rng.choice("abtheré'3!ÀǅΩ\"s.\u0301") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = [(5 * k + 2, t) for k, t in enumerate(texts)] + [(None, "no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3)
    token_files.write(docs, PATH, str(tmp_path / "a"))
    got = sorted(map(tuple, token_files.read(spark, str(tmp_path / "a")).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute(rows)
    token_files.write(docs.limit(0), PATH, str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (0, "b c")], "doc_id long, text string")
    token_files.write(twice, PATH, str(tmp_path / "c"))
    assert sorted(map(tuple, token_files.read(spark, str(tmp_path / "c")).collect())) == sorted(brute([(1, "a"), (1, "a"), (0, "b c")]))


def test_large_ids():
    rng = np.random.default_rng(6)
    for ids in (rng.integers(0, 2**32, 5000), np.repeat(rng.integers(0, 300_000, 200_000), 2), np.array([2**32 - 1]), np.arange(5000)):
        assert (token_files.decode_ids(token_files.encode_ids(ids)) == ids).all()
    for wrong in (-1, 2**32):
        with pytest.raises(ValueError):
            token_files.encode_ids(np.array([wrong]))


def test_smaller_than_order_0_and_zlib():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"].to_pylist()
    library = Tokenizer.from_file(PATH)
    ids = np.concatenate([[*x.ids, 2] for x in library.encode_batch_fast([t or "" for t in docs], add_special_tokens=False)])
    counts = np.unique(ids, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / len(ids))).sum() / 8
    size = len(token_files.encode_ids(ids))
    assert size < entropy and size < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    own = token_files.Tokenizer(open(PATH).read(), 2)
    texts = [b"one two three one", b"four two", b"", b"three four ones"]
    monkeypatch.setattr(token_files.common, "word_hashes", lambda raw, starts: np.zeros(len(starts), np.uint64))
    ids, lengths = own.encode_rows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    library = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*library.encode(t.decode()).ids, 2] for t in texts]


def test_files_that_cut_texts_in_another_way():
    data = json.loads(open(PATH).read())
    data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    own, library = token_files.Tokenizer(json.dumps(data), 2), Tokenizer.from_str(json.dumps(data))
    texts = ["don't 12,5 Äpfel", "", "a-b c"]
    raw = [t.encode() for t in texts]
    ids, lengths = own.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*library.encode(t).ids, 2] for t in texts]


def test_words_of_one_slot_are_told_apart(monkeypatch):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(7)
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "x" * 16, "x" * 17, "x" * 30, "x" * 29 + "y", "a\x00", "\x00", "\x00\x00", "été", "1", ",", ",,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for hashes in (token_files.common.plain_hashes, lambda raw, starts, ends: np.zeros(len(starts), np.uint64)):
        monkeypatch.setattr(token_files.common, "plain_hashes", hashes)
        own = token_files.Tokenizer(open(PATH).read(), 2)
        for most in (3, 10**6):  # the words known so far are forgotten in between
            monkeypatch.setattr(token_files, "CACHE_WORDS", most)
            for _ in range(2):
                ids, lengths = own.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
                assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_a_word_that_is_known_is_not_looked_up_by_its_bytes():
    own = token_files.Tokenizer(open(PATH).read(), 2)
    raw, offsets = np.frombuffer(b"one two, three one", np.uint8), np.array([0, 18])
    ids, _ = own.encode_rows(raw, offsets)
    own.known = None
    assert (own.encode_rows(raw, offsets)[0] == ids).all()
