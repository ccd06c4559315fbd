"""The corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, texts become token ids.

Every stage takes a table with the columns of ``documents``, and further ones of any name, which stay; a column of
``documents`` that isn't there is an error.  The last stage returns token ids.  Rows are decided one by one, whatever
their ids: a row without id, or that repeats another's, is a row of its own.  A table without rows gives one without rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from claimforge.llm.common import broadcast_if_small, numbered, shared_path
from claimforge.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Numbered ``docs`` but the rows in ``dropped``, without their numbers; few numbers are broadcast, many shuffled."""
    row = docs.columns[-1]
    return docs.join(broadcast_if_small(dropped.select(row).checkpoint()), row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field doesn't call toxic; null and empty texts stay.

    Learned from the labels of all folds but the held-out one.
    """
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    toxic = f"toxic_{uuid.uuid4().hex}"
    return toxicity.annotate(docs, model, toxic).where(F.col(toxic) == 0).drop(toxic)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: of the longest original, then the smallest id, none last. Null texts equal empty ones."""
    docs = numbered(docs)
    return without(docs, exact_dedup.exact_groups(docs, row_col=docs.columns[-1]).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect one row: of the smallest id, none last. Texts without words link with nothing."""
    docs = numbered(docs)
    row = docs.columns[-1]
    linked = ngram_join.ngram_jaccard_components(docs, row).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id").checkpoint()
    several = linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    linked = linked.join(several, "component_id").checkpoint()
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row")
    kept = linked.join(ids, "row").groupBy("component_id").agg(first).select("row")
    return without(docs, linked.join(kept, "row", "left_anti").withColumnRenamed("row", row))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row may come up to three times. Texts without words don't come."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, starts`` of every document of the mix."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        to = shared_path(docs, "stage")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
