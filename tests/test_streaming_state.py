"""Keyed state with timers, and the queue's table over crashes and restarts."""

import datetime as dt

import pytest

from claimforge.streaming import queue, timers


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


SAID = "project_id long, learned timestamp, expected date"
FIRST = [(1, day(0), dt.date(2026, 1, 1)), (1, day(4), dt.date(2026, 10, 1)), (2, day(1), dt.date(2027, 1, 1)), (None, day(1), dt.date(2027, 1, 1)), (3, day(1), None)]
# Out of order, but within the delay: day 2 comes between 0 and 4. Ties at day 5: the later date counts.
SECOND = [(1, day(2), dt.date(2026, 6, 1)), (2, day(5), dt.date(2028, 3, 1)), (2, day(5), dt.date(2027, 6, 1)), (9, day(20), dt.date(2026, 1, 1))]
# Project 2 was silent for over 30 days, so its later date begins afresh; project 1 moves across years; 9 closes the watermark.
THIRD = [(1, day(21), dt.date(2027, 1, 5)), (2, day(60), dt.date(2029, 1, 1)), (2, day(61), dt.date(2029, 2, 1)), (9, day(90), dt.date(2025, 1, 1))]
LATE = [(1, day(3), dt.date(2031, 1, 1)), (9, day(120), dt.date(2025, 1, 1))]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_moves_by_timers_give_what_the_table_gives(rocks, tmp_path):
    spark, source, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame(rows, SAID).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SAID).parquet(source)
        q = timers.date_moves(stream, "7 days", 30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        assert q.awaitTermination(240)

    for rows in (FIRST, SECOND, THIRD):  # each a start from the checkpoint
        add(rows)
    got = lambda df: sorted(tuple(r) for r in df.select(*timers.MOVES).collect())
    want = timers.date_moves(spark.createDataFrame(FIRST + SECOND + THIRD, SAID), "7 days", 30)
    rows = got(want)
    assert [(r[0], r[3], r[4]) for r in rows] == [(1, dt.date(2026, 6, 1), None), (1, dt.date(2026, 10, 1), None), (1, dt.date(2027, 1, 5), 96), (2, dt.date(2028, 3, 1), 425), (2, dt.date(2029, 2, 1), None)]
    assert rows[2][5] == "expected_online moved from 2026-10-01 to 2027-01-05 (+96 days)"
    assert rows[0][5].endswith("within 2026; this may be a more precise restatement rather than a delay")
    assert got(spark.read.parquet(out)) == rows
    add(LATE)  # later than the watermark: dropped, and nothing is given out twice
    assert got(spark.read.parquet(out)) == rows


def test_events_are_one_a_date(spark):
    said = [(1, day(n), dt.date(2026, m, 1)) for n, m in ((0, 1), (1, 5), (2, 2), (3, 5))]
    events = timers.delay_events(timers.date_moves(spark.createDataFrame(said, SAID))).collect()
    assert [(r.event_date, r.previous) for r in events] == [(dt.date(2026, 5, 1), dt.date(2026, 2, 1))]
    assert timers.date_moves(spark.createDataFrame([], SAID)).count() == 0


def found(url, n, title=None, published=None, status="discovered", attempts=None, error=None, run="r"):
    return (url, status, None if n is None else day(n), run, None, attempts, error, title, "feed" if status == "discovered" else None, published)


BATCHES = [
    [found("a", 0, "A"), found("a", 0, "A"), found("b", 1, "B"), found("c", 1, status="fetch_error", error="x" * 2000), found(None, 1), found("d", None), found("e", 1, status="lost")],
    [found("a", 2, "again"), found("b", 3, status="ok", published=day(-5)), found("c", 4, status="ok", attempts=2)],
    [found("c", 3, status="thin_content"), found("b", 5, "B2", published=day(-9)), found("b", 6, status="no_project", published=day(-1)), found("f", 6, "F", published=day(-2))],
    [],
    [found("f", 7, status="skipped"), found("a", 8, status="llm_error")],
]
STATES = {"a": ("llm_error", 1, "A", None, day(0), day(8)), "b": ("no_project", 2, "B", day(-5), day(1), day(6)), "c": ("ok", 4, None, None, day(1), day(4)),
          "f": ("skipped", 1, "F", day(-2), day(6), day(7))}


def states(df):
    return {r.url: (r.status, r.attempts, r.title, r.published_at, r.first_seen_at, r.last_tried_at) for r in df.collect()}


def test_fold_of_batches(spark):
    state = spark.createDataFrame([], queue.STATE)
    for rows in BATCHES:
        after = queue.applied(state, queue.advance(state, spark.createDataFrame(rows, queue.FOUND)))
        state = spark.createDataFrame(after.collect(), queue.STATE)
    assert states(state) == STATES
    again = spark.createDataFrame([found("a", 9, "new title"), found("b", 9, "x")], queue.FOUND)
    assert queue.advance(state, again).count() == 0
    assert state.where("url = 'c'").first().error is None


def test_queue_survives_a_crash_between_write_and_commit(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "queue")
    sink, crash = queue.QueueSink(folder, fold_every=2), set()

    def write(rows, batch):
        sink(rows, batch)
        if batch in crash:  # written, not committed
            crash.clear()
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema(queue.FOUND).parquet(source)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    batches = [b for b in BATCHES if b]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, queue.FOUND).coalesce(1).write.mode("append").parquet(source)
        crash.update({n} if n in (1, 3) else ())
        if crash:
            with pytest.raises(Exception, match="lost"):
                run()
        run()
    assert states(queue.queue_table(spark, folder)) == STATES
    assert set(states(queue.queue_table(spark, folder, 2))) == set(STATES)
    assert sorted((r.url or "") + (r.status or "") for r in queue.rejects(spark, folder).collect()) == ["ddiscovered", "discovered", "elost"]
    run()  # nothing new: nothing changes
    assert states(queue.queue_table(spark, folder)) == STATES
