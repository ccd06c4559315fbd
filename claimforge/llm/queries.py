"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from claimforge.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


SQL["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
), g AS (
  SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.mixing import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from claimforge.llm import token_files
    from claimforge.llm.common import shared_path

    docs = table(spark, sf_dir, "documents")
    to = shared_path(docs, "tokens")
    token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), to, end_id=2)
    return token_files.read(spark, to)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from claimforge.llm import language_id
    from claimforge.llm.common import crc32_of_id

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))  # a row without id has no remainder
    vocabulary = language_id.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.train(docs.where(~held_out).select("doc_id", "text", "lang"), vocabulary)
    return language_id.predict(docs, model).withColumn("held_out", held_out)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm import toxicity
    from claimforge.llm.common import crc32_of_id

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(crc32_of_id() % 5 == 0, F.lit(False)))


@query
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm import pseudo_likelihood

    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs))


@query
def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from claimforge.llm import piece_bpe

    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.spelling_variants import variants

    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimforge.llm.lexical_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), size AS (
  SELECT count(*) AS docs, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS terms FROM d WHERE len(terms) > 0
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), size
), i AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT item, item_id, unnest(terms) AS term FROM (
      SELECT row_number() OVER () AS item, item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM benchmark))
), s AS (
  SELECT item, item_id, r, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * size.docs) // size.terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), size GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
