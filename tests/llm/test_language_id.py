import math
import random

import numpy as np
import public_tokenizers

from claimforge.llm import language_id as li


def brute(table, pieces, word):
    """All segmentations, listed."""
    index = {p: k for k, p in enumerate(pieces)}

    def total(rest):
        if not rest:
            return 1.0
        found = sum(table[index[rest[:k]], 0] * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in index)
        return found + (table[-1, 0] * total(rest[1:]) if rest[0] not in index else 0)

    return math.log(total("▁" + word))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = sorted({"▁", "a", "b", "ab", "ba", "▁a", "aba", "bb", "▁ab"})
    own = li.Pieces(pieces)
    table = np.vstack([rng.random((len(pieces), 2)) / 9, [[1e-3, 1e-3]]])
    words = ["", "a", "ab", "abba", "abcab", "c", "bbbab", "é"]
    got = li.forward(own, table, words)
    for k, w in enumerate(words):
        assert math.isclose(got[k, 0], brute(table, pieces, w), rel_tol=1e-9)
    long = "".join(random.Random(2).choice("abc") for _ in range(39))
    assert np.allclose(li._forward_long(own, table, long), li.forward(own, table, [long])[0])
    assert np.isfinite(li.forward(own, table, ["ab" * 4000])).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    vocabulary = li.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = li.train(docs.where("doc_id % 4 <> 2"), vocabulary, docs_each=60)
    assert model.names == ["de", "en", "es", "fr"]
    rows = li.predict(docs, model).join(docs, "doc_id").where("doc_id % 4 = 2").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 !? "), (3, "der die und nicht " * 9000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(odd, model).collect()}
    assert got[None] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "de" and got[3][1] <= 1
    none = li.train(docs.limit(0), vocabulary)
    assert {r.lang_pred for r in li.predict(odd, none).collect()} == {"und"}
