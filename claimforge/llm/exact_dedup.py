"""Exact dedup through an extendible-hash index on shared files.  DataFrame functions only.

Texts are equal when identical without white space.  The index lives in the folder that the cluster
shares, as three tables.  The *segment* has a row a document: 64-bit key, digest, size.  The *directory*
has ``2 ** depth`` slots, one for each prefix of a key, which name buckets; it doubles as long as a bucket
has more entries than its capacity: an overfull bucket splits by one more bit of the key, of the others both
halves stay one bucket.  The *entries* are written bucket by bucket, each by the task that owns it: of equal
keys and digests one entry is left, combined before the shuffle, so a group of copies of any size is
one, and the owner numbers the entries that chain up under one key.  Documents find their entry through the
directory.  Texts that share an entry are compared byte by byte; should some differ, that entry alone is
chained again by its texts.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import broadcast_if_small, shared_path
from claimforge.session import ensure_checkpoint_dir

#: Entries of a bucket before it splits.
CAPACITY = 1 << 15
#: The directory has at most ``2 ** DEPTH`` slots; buckets of that depth just grow.
DEPTH = 24


def without_space(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09-0x0D; null gives the empty text."""
    text = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def _written(df: DataFrame, name: str) -> DataFrame:
    to = shared_path(df, name)
    df.write.parquet(to)
    return df.sparkSession.read.parquet(to)


def build_directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """The directory's depth, and ``slot, bucket`` for each of its slots; a bucket's name is ``depth:prefix``.

    It begins at the depth that the number of entries suggests.  Only whether some bucket is overfull comes to
    the driver.
    """
    spark = entries.sparkSession
    ensure_checkpoint_dir(spark)
    total = entries.count()
    depth = min(DEPTH, max(0, ceil(log2(max(1, total / capacity)))))

    def named(depth: int, slot: Column) -> Column:
        return F.concat(F.lit(f"{depth}:"), slot.cast("string"))

    directory = spark.range(2**depth).select(F.col("id").alias("slot"), named(depth, F.col("id")).alias("bucket"))
    while depth < DEPTH:
        over = entries.groupBy(_prefix(depth).alias("slot")).count().where(F.col("count") > capacity)
        # a bucket of less depth than the directory fits already; only those of full depth can split
        over = over.join(directory, "slot").where(F.col("bucket") == named(depth, F.col("slot"))).select("slot", F.lit(True).alias("over")).checkpoint()
        if not over.limit(1).count():
            break
        depth += 1
        halves = directory.join(broadcast_if_small(over), "slot", "left").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
        slot = F.col("slot") * 2 + F.col("half")
        directory = halves.select(slot.alias("slot"), F.when(F.col("over"), named(depth, slot)).otherwise(F.col("bucket")).alias("bucket")).checkpoint()
    return depth, directory


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, row_col: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the row with the most code points stays, then the smallest id; a null id comes
    last and is kept only in a group without any other.  Null texts equal empty ones.  Rows that repeat an id within a
    group are kept or dropped together, unless ``row_col`` names a column of row numbers: it comes with the result, and
    of each group just one row is kept, of rows alike the one of the smallest number.  Other columns are not read.
    """
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = base.withColumn("plain", without_space(F.col("text")))
    key, sha, chars = F.xxhash64("plain").alias("key"), F.sha2("plain", 256).alias("sha"), F.length("text").cast("long").alias("chars")
    segment = _written(plain.select("doc_id", "row", key, sha, chars), "segment")
    id_or_last = F.coalesce("doc_id", F.lit(2**63 - 1))
    best = F.max(F.struct("chars", F.negative(id_or_last).alias("id"), F.negative("row").alias("row"))).alias("best")
    entries = segment.groupBy("key", "sha").agg(F.count("*").alias("members"), best).checkpoint()

    depth, directory = build_directory(entries, capacity)
    found = broadcast_if_small(_written(directory, "directory"))
    owned = entries.withColumn("slot", _prefix(depth)).join(found, "slot").drop("slot")
    # dealt by bucket: each has one owner, which numbers the chain under a key and writes it in order
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    index = _written(owned.repartition("bucket").withColumn("ordinal", chain), "index")

    # bytes of texts under one entry: equal if the least and the greatest are
    several = index.where("members > 1").select("key", "sha")
    ids = segment.join(several, ["key", "sha"], "left_semi").where("doc_id is not null").select("doc_id").distinct().checkpoint()
    named = base.join(broadcast_if_small(ids), "doc_id", "left_semi").unionByName(base.where("doc_id is null").select("doc_id", "row", "text"))
    compared = named.withColumn("plain", without_space(F.col("text"))).select(key, sha, F.col("plain").cast("binary").alias("plain"))
    split = compared.groupBy("key", "sha").agg(F.min("plain").alias("a"), F.max("plain").alias("b")).where("a <> b").select("key", "sha").checkpoint()

    looked_up = segment.withColumn("slot", _prefix(depth)).join(found, "slot")
    if not split.limit(1).count():
        return _decided(looked_up.join(index.select("bucket", "key", "sha", "members", "best"), ["bucket", "key", "sha"]), row_col)
    alone = index.join(split, ["key", "sha"], "left_anti").select("bucket", "key", "sha", "members", "best")
    rows = plain.select("doc_id", "row", F.col("plain").cast("binary").alias("plain"), key, sha, chars).join(split, ["key", "sha"], "left_semi")
    chained = rows.groupBy("key", "sha", "plain").agg(F.count("*").alias("members"), best)
    return _decided(looked_up.join(alone, ["bucket", "key", "sha"]), row_col).unionByName(_decided(rows.join(chained, ["key", "sha", "plain"]), row_col))


def _decided(rows: DataFrame, row_col: str | None) -> DataFrame:
    """The result's columns of rows that have met their entry."""
    best = F.negative(F.col("best.id"))
    keep = F.when(best < 2**63 - 1, best)
    kept = F.col("doc_id").eqNullSafe(keep)
    if row_col:
        kept = F.col("row") == F.negative(F.col("best.row"))
    own = [F.col("row").alias(row_col)] if row_col else []
    return rows.select("doc_id", *own, keep.alias("keep_id"), F.col("members").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
