"""Expected dates that move later, in the order in which they were learned, by keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A move: ``delay_days`` only from one year to a later one, as a move within a year may be the same date said more precisely.
MOVES = ["project_id", "learned", "previous", "event_date", "delay_days", "description"]
_RAW = "project_id long, at long, before int, after int"


class _Moves(StatefulProcessor):
    """Statements wait until the watermark passes them, then apply in order; a project is forgotten after a time without any.

    One timer a project: at the earliest statement that waits, or where none does at the time of forgetting.
    """

    def __init__(self, forget_us: int):
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "day int")
        self.current = handle.getValueState("current", "at long, day int")
        self.wake = handle.getValueState("wake", "ms long")

    def _set_timer(self, at_us: int) -> None:
        ms = -(-at_us // 1000)
        if self.wake.exists():
            if self.wake.get()[0] == ms:
                return
            self.handle.deleteTimer(self.wake.get()[0])
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            for at, day in batch.groupby("at")["day"].max().items():
                at, day = int(at), int(day)
                known = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
                self.waiting.updateValue((at,), (day if known is None else max(day, known[0]),))
                earliest = at if earliest is None else min(at, earliest)
        # A timer of forgetting is always earlier than a statement that comes after it, so it must give way.
        forgetting = self.current.exists() and self.wake.exists() and self.wake.get()[0] == -(-(self.current.get()[0] + self.forget_us) // 1000)
        if earliest is not None and (not self.wake.exists() or forgetting or -(-earliest // 1000) < self.wake.get()[0]):
            self._set_timer(earliest)
        yield pd.DataFrame({"project_id": [], "at": [], "before": [], "after": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        due = [w for w in waiting if w[0] <= now]
        before, out = (tuple(self.current.get()) if self.current.exists() else None), []
        for at, day in due:
            if before is not None and at - before[0] <= self.forget_us and day > before[1]:
                out.append((key[0], at, before[1], day))
            before = (at, day)
            self.waiting.removeKey((at,))
        if len(waiting) > len(due):
            self._set_timer(waiting[len(due)][0])
        elif before is not None and before[0] + self.forget_us > now:
            self._set_timer(before[0] + self.forget_us)
        else:
            before = None
        if before is None:
            self.current.clear()
        else:
            self.current.update(before)
        yield pd.DataFrame(out, columns=["project_id", "at", "before", "after"])

    def close(self) -> None:
        pass


def date_moves(statements: DataFrame, delay: str = "7 days", forget_days: int = 730) -> DataFrame:
    """Moves of a project's expected date to a later one: ``MOVES``, for streams and tables alike.

    ``statements`` has ``project_id long, learned timestamp, expected date``; rows with a null are passed over, of statements of one
    moment the latest date counts.  A statement made over ``forget_days`` after the one before it begins afresh.  On a stream a move is
    given out once the watermark, ``delay`` behind the last statement, has passed it; what comes later than that is dropped there (it is in a
    run over the table), and the session needs the RocksDB state store.
    """
    rows = statements.where("project_id is not null and learned is not null and expected is not null").select(
        F.col("project_id").cast("long").alias("project_id"), F.col("learned").cast("timestamp").alias("learned"), "expected")
    forget_us = forget_days * 86_400_000_000
    if rows.isStreaming:
        keyed = rows.withWatermark("learned", delay).select("project_id", "learned", F.unix_micros("learned").alias("at"), F.unix_date("expected").alias("day"))
        moves = keyed.groupBy("project_id").transformWithStateInPandas(_Moves(forget_us), _RAW, "Append", "EventTime")
    else:
        said = rows.groupBy("project_id", F.unix_micros("learned").alias("at")).agg(F.unix_date(F.max("expected")).alias("after"))
        order = Window.partitionBy("project_id").orderBy("at")
        said = said.withColumn("before", F.lag("after").over(order)).withColumn("was", F.lag("at").over(order))
        moves = said.where(F.col("after") > F.col("before")).where(F.col("at") - F.col("was") <= forget_us).select("project_id", "at", "before", "after")
    dated = moves.select("project_id", F.timestamp_micros("at").alias("learned"), F.date_from_unix_date("before").alias("previous"), F.date_from_unix_date("after").alias("event_date"))
    days, across = F.datediff("event_date", "previous"), F.year("event_date") > F.year("previous")
    move = F.concat(F.lit("expected_online moved from "), F.col("previous").cast("string"), F.lit(" to "), F.col("event_date").cast("string"))
    text = F.when(across, F.concat(move, F.lit(" (+"), days.cast("string"), F.lit(" days)"))).otherwise(
        F.concat(move, F.lit(" within "), F.year("previous").cast("string"), F.lit("; this may be a more precise restatement rather than a delay")))
    return dated.select(*MOVES[:4], F.when(across, days).alias("delay_days"), text.alias("description"))


def delay_events(moves: DataFrame) -> DataFrame:
    """One event a project and new date, as the last move to that date has it."""
    keys = ["project_id", "event_date"]
    rest = [c for c in MOVES if c not in keys]
    return moves.groupBy(*keys).agg(F.max_by(F.struct(*rest), "learned").alias("r")).select(*keys, "r.*")
