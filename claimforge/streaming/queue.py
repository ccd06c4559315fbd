"""The work queue of addresses: what was found, what came of reading it, and a table of it that survives restarts.

An address enters as ``discovered`` and gets an outcome each time it is read.  One that the queue knows is never queued again, so finding
it anew changes nothing.  ``QueueSink`` keeps the queue from a stream: each micro-batch writes only the addresses that it changed, under
its own number, so a batch that is run again after a crash overwrites what it wrote and counts nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# States of an address; the first is the entry, the others are outcomes.
STATUSES = ("discovered", "ok", "fetch_error", "parse_error", "llm_error", "no_project", "thin_content", "skipped")
PENDING = STATUSES[0]

#: A row of the input: an address as a feed lists it, or the outcome of reading it; ``attempts`` null counts as one.
FOUND = "url string, status string, at timestamp, run_id string, http_status int, attempts long, error string, title string, feed string, published_at timestamp"
#: A row of the queue.
STATE = "url string, status string, run_id string, http_status int, attempts long, error string, title string, feed string, published_at timestamp, first_seen_at timestamp, last_tried_at timestamp"
_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def valid(rows: DataFrame) -> DataFrame:
    """Rows with an address, a time and a known status, ``ok`` true; the others are rejects."""
    return rows.withColumn("ok", F.col("url").isNotNull() & F.col("at").isNotNull() & F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def advance(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the queue that ``rows`` change, as they are afterwards; those of ``state`` that it leaves alone are not in it.

    The last outcome decides, attempts add up, the first row names title and feed if it was a finding, and a date of publication is
    filled but never replaced.  An outcome that arrives after a later one counts as attempts alone.  Rows without address, time or
    known status are passed over; equal rows of one batch are one.
    """
    found = F.col("status") == PENDING
    order = F.struct("at", ~found, "status", *[c for c in ("run_id", "http_status", "error", "title", "feed", "published_at")])
    first, last = F.struct("status", "run_id", "title", "feed", "published_at"), F.struct("at", "status", "run_id", "http_status", "error")
    batch = valid(rows).where("ok").select(*[c.split()[0] for c in FOUND.split(", ")]).distinct().groupBy("url").agg(
        F.min("at").alias("seen"), F.min_by(first, order).alias("first"), F.max_by(F.when(~found, last), F.when(~found, order)).alias("last"),
        F.sum(F.when(~found, F.coalesce("attempts", F.lit(1))).otherwise(0)).alias("tries"), F.min_by(F.when(~found, F.col("published_at")), F.when(~found & F.col("published_at").isNotNull(), order)).alias("dated"))
    known = state.select("url", F.struct(*_COLUMNS[1:]).alias("old"))
    both = batch.join(known, "url", "left").where("old is null or last is not null")
    takes = F.col("last").isNotNull() & (F.col("old").isNull() | (F.col("old.status") == PENDING) | (F.col("old.last_tried_at") <= F.col("last.at")))
    fresh = F.col("first.status") == PENDING

    def kept(name: str, new):
        return F.when(F.col("old").isNull(), new).otherwise(F.col(f"old.{name}"))

    return both.select(
        "url", F.when(takes, F.col("last.status")).otherwise(kept("status", F.lit(PENDING))).alias("status"),
        F.when(takes, F.col("last.run_id")).otherwise(kept("run_id", F.col("first.run_id"))).alias("run_id"),
        F.when(takes, F.col("last.http_status")).otherwise(F.col("old.http_status")).alias("http_status"),
        (F.coalesce("old.attempts", F.lit(0)) + F.col("tries")).alias("attempts"),
        F.when(takes, F.substring("last.error", 1, 1000)).otherwise(F.col("old.error")).alias("error"),
        kept("title", F.when(fresh, F.substring("first.title", 1, 300))).alias("title"), kept("feed", F.when(fresh, F.col("first.feed"))).alias("feed"),
        F.coalesce(F.col("old.published_at"), F.when(F.col("old").isNull(), F.col("first.published_at")), F.col("dated")).alias("published_at"),
        kept("first_seen_at", F.col("seen")).alias("first_seen_at"),
        F.when(takes, F.col("last.at")).otherwise(kept("last_tried_at", F.col("seen"))).alias("last_tried_at"))


def applied(state: DataFrame, changed: DataFrame) -> DataFrame:
    """``state`` with the rows of ``changed`` in place of its own."""
    return state.join(changed.select("url"), "url", "left_anti").select(*_COLUMNS).unionByName(changed)


@dataclass
class QueueSink:
    """For ``writeStream.foreachBatch``: ``folder`` is one that driver and executors share.

    ``log/batch=n`` holds what batch ``n`` changed, ``rejects/batch=n`` its rows without address, time or known status, and
    ``folded/upto=n`` the whole queue after batch ``n``, written every ``fold_every`` batches.  A batch sees the batches before it
    alone, so running it again gives the same.  Once a fold is complete, batches up to the fold before it are removed.
    """

    folder: str
    fold_every: int = 50

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            advance(queue_table(spark, self.folder, batch - 1), rows).write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
            valid(rows).where("not ok").drop("ok").write.mode("overwrite").parquet(f"{self.folder}/rejects/batch={batch}")
        finally:
            rows.unpersist()
        if batch % self.fold_every == self.fold_every - 1:
            before = _complete(spark, f"{self.folder}/folded", "upto", batch - 1)
            _table(spark, self.folder, batch, batch - 1).write.mode("overwrite").parquet(f"{self.folder}/folded/upto={batch}")
            if before:
                for name, folder, last in (("batch", "log", before[-1]), ("upto", "folded", before[-1] - 1)):
                    for n in _complete(spark, f"{self.folder}/{folder}", name, last):
                        _remove(spark, f"{self.folder}/{folder}/{name}={n}")


def queue_table(spark: SparkSession, folder: str, through: int | None = None) -> DataFrame:
    """The queue after batch ``through``, the last complete one if none is given: the last fold and the batches since."""
    return _table(spark, folder, through, through)


def _table(spark: SparkSession, folder: str, through: int | None, fold_through: int | None) -> DataFrame:
    """The queue after batch ``through`` on the last fold up to ``fold_through``: a fold that is written again can't be read from."""
    folds = _complete(spark, f"{folder}/folded", "upto", fold_through)
    since = folds[-1] if folds else -1
    paths = [f"{folder}/log/batch={n}" for n in _complete(spark, f"{folder}/log", "batch", through) if n > since]
    base = spark.read.schema(STATE).parquet(f"{folder}/folded/upto={since}") if folds else spark.createDataFrame([], STATE)
    if not paths:
        return base
    log = spark.read.schema(STATE).option("basePath", f"{folder}/log").parquet(*paths)
    rows = base.withColumn("batch", F.lit(since)).unionByName(log.withColumn("batch", F.col("batch").cast("int")))
    return rows.groupBy("url").agg(F.max_by(F.struct(*_COLUMNS[1:]), "batch").alias("r")).select("url", "r.*")


def rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all batches that were no entries."""
    paths = [f"{folder}/rejects/batch={n}" for n in _complete(spark, f"{folder}/rejects", "batch", None)]
    return spark.read.schema(FOUND).parquet(*paths) if paths else spark.createDataFrame([], FOUND)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, folder: str, name: str, through: int | None) -> list[int]:
    """Numbers of the folders ``name=number`` whose job was committed, up to ``through``."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    found = (f.getPath() for f in files.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith(f"{name}="))
    numbers = [int(p.getName()[len(name) + 1:]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(n for n in numbers if through is None or n <= through)


def _remove(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)
