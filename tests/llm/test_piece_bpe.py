"""Piece encoding against the sentencepiece library, text by text and table by table."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from claimforge.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN, LIBRARY = piece_bpe.Model(piece_bpe.load_model(PATH)), SentencePieceProcessor(model_file=PATH)

ODD = ["", " ", "  ", "a", " a", "a ", "  a  b  ", "\n", "a\nb", "\t\t", "▁", "▁▁a", "<s>", "</s><unk>", "<0x0A>", "café über",
       "\U0001f600\U0001f601", "é", "\x00", "a\x00b", "﻿x", "あい 漢字", "aaaaaaaaaaaaaaaa", "1234567890" * 9, "the the  the", "‍", "�"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeinorst  \n▁éü.,'"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300), st.just(29871)), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_a_chunk_without_cuts_of_any_length():
    rng = random.Random(3)
    text = "".join(rng.choice("aeinrst") for _ in range(60_000))
    assert OWN.encode(text) == LIBRARY.encode(text)


def test_tables(spark):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(100, None), (None, "no id"), (7, "twice"), (7, "twice"), (101, "word " * 50_000)]
    docs = spark.createDataFrame([(a, b, "x", -1) for a, b in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    assert piece_bpe.differences(docs, PATH).count() == 0
    digests = sorted(map(tuple, piece_bpe.digests(docs, PATH).collect()), key=str)
    expected = []
    for key, text in rows:
        ids = LIBRARY.encode(text or "")
        expected.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert digests == sorted(expected, key=str)
    back = piece_bpe.decode(piece_bpe.encode(docs, PATH), PATH)
    assert {(r.doc_id, r.text) for r in back.collect()} >= {(7, "twice"), (None, "no id"), (100, "")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert piece_bpe.digests(docs, PATH).count() == piece_bpe.encode(docs, PATH).count() == 0


def test_registered_query(spark):
    from claimforge.llm.queries import QUERIES

    found = QUERIES["op11_piece_bpe"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in found.collect():
        ids = LIBRARY.encode(docs.pop(row.doc_id))
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert not docs


def test_unfit_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Model(b"")
