"""Incremental ingestion: first-seen queues, digests by windows, idempotent upserts, slippage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_urls(candidates: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that no earlier run has seen, each once: the first by ``seen_at``, then by all columns."""
    fresh = candidates.join(known.select(key).distinct(), key, "left_anti")
    order = F.struct("seen_at", *sorted(c for c in fresh.columns if c not in (key, "seen_at")))
    best = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in fresh.columns if c != key]), order).alias("r"))
    return best.select(key, "r.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``current`` and ``incoming`` merged, with ``action``: insert, update, unchanged or kept.

    An incoming null fills nothing.  Running it again on its own result changes nothing.
    """
    values = [c for c in current.columns if c != key]
    a, b = current.alias("a"), incoming.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    merged = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in values]
    same = F.lit(True)
    for c in values:
        same = same & F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).eqNullSafe(F.col(f"a.{c}"))
    action = F.when(F.col(f"a.{key}").isNull(), "insert").when(F.col(f"b.{key}").isNull(), "kept").when(same, "unchanged").otherwise("update")
    return both.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *merged, action.alias("action"))


def daily_digest(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Signals by day of learning and kind; works on streams and tables alike.

    The time is cast to a timestamp with zone, as watermarks need one.
    """
    rows = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("_t", delay)
    return rows.groupBy(F.window("_t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(
        F.to_date("w.start").alias("day"), "event_type", "n", "cents")


def first_seen(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "2 days") -> DataFrame:
    """The first row of each key by time; of rows of one time any, but always the same. On streams within the watermark."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        return rows.withWatermark("_t", delay).dropDuplicatesWithinWatermark(keys).drop("_t")
    order = F.struct("_t", F.xxhash64(*stream.columns))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*stream.columns), order).alias("_first")).select("_first.*")


def sessions(stream: DataFrame, gap: str = "1 day", time: str = "ts") -> DataFrame:
    """Sessions of a user: runs of events with no gap as long as ``gap``."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("_t", gap)
    return rows.groupBy(F.session_window("_t", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def slippage(stream: DataFrame) -> DataFrame:
    """Rises of a user's value from one event to the next, by keyed state: ``user_id, before, after``."""

    def track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        before = state.get[0] if state.exists else None
        out = []
        for value in rows["value"]:
            if before is not None and value > before:
                out.append((key[0], before, value))
            before = value
        state.update((float(before),))
        yield pd.DataFrame(out, columns=["user_id", "before", "after"])

    return stream.groupBy("user_id").applyInPandasWithState(track, "user_id long, before double, after double", "value double", "append", "NoTimeout")
