"""Canonical exact digests of texts.  DataFrame functions only.

A text is folded (NFKC, case, white space) and hashed to 128 bits by two xxhash64.  Documents of
equal hashes are compared byte by byte on their folded texts, so a collision can't pass for equality:
should one turn up, the ordinal of the text in its bucket becomes part of the fingerprint.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import broadcast_if_small, shuffle_partitions
from claimforge.session import ensure_checkpoint_dir

#: Key ranges into which documents are dealt to meet their successors; their bounds come to the driver.
RANGES = 8192


def canonical(text: Column) -> Column:
    """NFKC, default case folding, NFKC again, white space to one space, trimmed; null gives the empty text.

    ICU does the first three, as a method that Spark calls in the JVM.
    """
    icu = F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose")
    folded = F.reflect(*icu, F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), folded, F.lit(True))
    folded = F.reflect(*icu, folded, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\u0085\p{Z}]+", " "))


def wide_hash(text: Column) -> Column:
    """32 hexadecimal digits: xxhash64 (seed 42) of the UTF-8 text, and of the text after a byte 0x01."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(x)), 16, "0") for x in (text, F.concat(F.lit("\x01"), text)))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, next``: every row with the text of the next one by id, the last with the first's.

    Rows are dealt into ranges of ids; each range gets a copy of the row that begins the next range.
    A null id comes first; rows of equal id follow each other by a hash of their text.  An id that fills more than
    one range, the null one among them, is a range of its own, which is cut again by the hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = min(RANGES, 4 * shuffle_partitions(docs))
    # a null id is one less than the least long that data can hold for sure: its own lowest range
    ranked = rows.withColumn("rank", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    points = ",".join(str(k / ranges) for k in range(1, ranges))
    found = Counter(ranked.select(F.expr(f"percentile_approx(rank, array({points}), {20 * ranges})").alias("p")).first().p or [])
    hot = {x: n.bit_length() for x, n in found.items() if n > 1}
    bounds = sorted({*found, *(x - 1 for x in hot if x > -(2**63))})
    # position of the rank among the sorted bounds, by bisection written out as nested comparisons
    part = _bisect(bounds, 0, len(bounds)).cast("long") * 2**16
    if hot:
        bits = F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("rank"))
        ranked = ranked.withColumn("bits", bits)
        part = part + F.coalesce(F.expr("shiftright(h, 63 - bits)"), F.lit(0))
    ranked = ranked.withColumn("part", part).select("doc_id", "text", "rank", "h", "part")
    firsts = sorted((r.part, r.f.rank, r.f.h) for r in ranked.groupBy("part").agg(F.min(F.struct("rank", "h")).alias("f")).collect())
    if not firsts:
        return rows.withColumn("next", F.col("text"))
    follow = [(firsts[k - 1][0], rank, h) for k, (_, rank, h) in enumerate(firsts)]
    spark = docs.sparkSession
    copies = ranked.drop("part").join(F.broadcast(spark.createDataFrame(follow, "part long, rank long, h long")), ["rank", "h"])  # a row a range
    copies = copies.groupBy("part", "rank", "h").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("part", "rank", "h", "r.doc_id", "r.text", F.lit(1).alias("copy"))
    every = ranked.withColumn("copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("part").orderBy("copy", "rank", "h")
    return every.withColumn("next", F.lead("text").over(order)).where("copy = 0").select("doc_id", "text", "next")


def _bisect(bounds: list[int], a: int, b: int) -> Column:
    """How many bounds are below ``rank``."""
    if a == b:
        return F.lit(a)
    if b - a <= 16:
        found = F.lit(a)
        for k in range(a, b):
            found = found + (F.col("rank") > bounds[k]).cast("int")
        return found
    middle = (a + b) // 2
    return F.when(F.col("rank") <= bounds[middle], _bisect(bounds, a, middle)).otherwise(_bisect(bounds, middle + 1, b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    An exact digest is like another entirely or not at all: likenesses are 1.0 or 0.0.  Null texts count
    as empty; rows that repeat an id are rows of their own; extra columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    chars = F.length("text")
    cut = F.floor(chars / 4).cast("int")
    rows = (
        with_next(docs, id_col, text_col)
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (chars - cut)), F.substring("next", F.lit(1), cut)))
        .select("doc_id", chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                canonical(F.col("text")).alias("own"), canonical(F.col("edited")).alias("other"), canonical(F.substring("next", 1, 2**31 - 1)).alias("after"))
        .select("doc_id", "n_chars", "edited_sha256", wide_hash(F.col("own")).alias("fingerprint"), wide_hash(F.col("other")).alias("edited_fingerprint"),
                (F.col("own") == F.col("other")).cast("double").alias("near_edited"), (F.col("own") == F.col("after")).cast("double").alias("near_next"))
        .checkpoint()
    )
    several = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    suspect = rows.join(several, "fingerprint", "left_semi").where("doc_id is not null").select("doc_id").distinct().checkpoint()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(broadcast_if_small(suspect), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    folded = texts.select("doc_id", canonical(F.col("text")).alias("own")).select("doc_id", wide_hash(F.col("own")).alias("fingerprint"), F.col("own").cast("binary").alias("own"))
    split = folded.groupBy("fingerprint").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("fingerprint").checkpoint()
    if not split.limit(1).count():
        return rows
    bucket = folded.join(split, "fingerprint", "left_semi").select("doc_id", "fingerprint", "own").distinct()
    ordinal = bucket.groupBy("fingerprint").agg(F.array_sort(F.collect_set("own")).alias("texts"))  # distinct texts of one 128-bit hash
    named = bucket.join(ordinal, "fingerprint").select("doc_id", "fingerprint", F.expr("array_position(texts, own)").alias("ordinal"))
    return rows.join(named, ["doc_id", "fingerprint"], "left").withColumn(
        "fingerprint", F.concat("fingerprint", F.when(F.col("ordinal") > 1, F.concat(F.lit("-"), F.col("ordinal").cast("string"))).otherwise(""))).drop("ordinal")
