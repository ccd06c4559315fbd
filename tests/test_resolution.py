"""Resolution on literal rows, and metamorphic tests."""

import datetime as dt
import json
import random

import pytest

from claimforge.operators import claims as C
from claimforge.sources import sinks
from claimforge.streaming import incremental

SCHEMA = "k int, value_num double, value_str string, confirmed boolean, decided_against boolean, weight int, fetched_at date, url string"


def claim(k, num, text, confirmed=True, against=False, weight=1, day=1, url="u"):
    return (k, num, text, confirmed, against, weight, dt.date(2024, 1, day), url)


ROWS = [
    claim(1, 10.0, "construction", weight=3), claim(1, 99.0, "operational", confirmed=False, weight=3, day=9), claim(1, 20.0, "permitting", weight=3, day=2),
    claim(2, 5.0, "announced", confirmed=False), claim(2, 7.0, "permitting", confirmed=False, day=2),
    claim(3, 8.0, "announced", against=True),
    claim(4, 1.0, "operational", weight=3), claim(4, 2.0, "cancelled", weight=1), claim(4, 3.0, "paused", weight=2),
    claim(5, 1.0, "a", url="a"), claim(5, 2.0, "b", url="b"),
    claim(6, 4.0, "announced", confirmed=False), claim(6, None, "permitting"),
]


@pytest.mark.parametrize("policy,want", [
    ("prefer_weight", {1: 20.0, 2: 7.0, 4: 1.0, 5: 2.0, 6: None}), ("max", {1: 20.0, 2: 7.0, 4: 3.0, 5: 2.0, 6: None}),
    ("min", {1: "construction", 2: "announced", 4: "cancelled", 5: "a", 6: "permitting"}), ("ladder", {1: "construction", 2: "permitting", 4: "paused", 5: None, 6: "permitting"}),
])
def test_policies(spark, policy, want):
    for seed in (1, 2):
        rows = list(ROWS)
        random.Random(seed).shuffle(rows)
        got = {r.k: r.value for r in C.resolve(spark.createDataFrame(rows, SCHEMA), policy, "k").collect()}
        assert got == want


def test_existing_values(spark):
    rows = spark.createDataFrame([(1, 50.0), (3, 60.0), (9, 70.0)], "k int, existing double")
    found = C.resolve(spark.createDataFrame(ROWS, SCHEMA), "prefer_weight", "k")
    assert {r.k: r.value for r in C.with_existing(rows, found, "k", "existing").collect()} == {1: 20.0, 3: 60.0, 9: 70.0}
    assert {r.k: r.value for r in C.with_existing(rows, found, "k", "existing", fill_only=True).collect()} == {1: 50.0, 3: 60.0, 9: 70.0}


def test_claims_json(spark):
    rows = spark.createDataFrame([(1, '{"mw": 5, "x": 1, "phase": null}'), (2, "broken"), (3, None), (4, '{"phase": "paused"}')], "id int, claims string")
    got = sorted((r.id, r.field, r.value_str, r.value_num) for r in C.explode_claims(rows, ["mw", "phase"]).collect())
    assert got == [(1, "mw", "5", 5.0), (4, "phase", "paused", None)]


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6), (1, None, 1)], "k int, v string, w int")
    once = incremental.upsert(now, new, "k")
    assert {r.k: (r.v, r.w, r.action) for r in once.collect()} == {1: ("a", 1, "unchanged"), 2: ("c", 5, "update"), 3: ("d", 6, "insert")}
    assert {r.action for r in incremental.upsert(once.drop("action"), new, "k").collect()} == {"unchanged"}


def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(incremental.daily_digest(stream), "digest", "complete") == sorted(map(tuple, incremental.daily_digest(events).collect()))
    assert len(run(incremental.first_seen(stream, ["event_id"]), "seen", "append")) == events.count()
    before, rises = {}, []
    for r in events.orderBy("user_id", "ts").collect():
        if r.user_id in before and r.value > before[r.user_id]:
            rises.append((r.user_id, before[r.user_id], r.value))
        before[r.user_id] = r.value
    assert run(incremental.slippage(stream), "slips", "append") == sorted(rises)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c"), (1, None)], "id long, name string")
    assert sinks.markdown(rows.orderBy("id"), "T").splitlines()[2:] == ["| id | name |", "| --- | --- |", "| 1 |  |", "| 2 | b\\|c |"]
    sinks.append_ledger(rows, str(tmp_path / "log"))
    with open(tmp_path / "log" / "part-x.json", "w") as f:
        f.write("{broken\n")
    assert sinks.read_ledger(spark, str(tmp_path / "log"), "id long, name string").count() == 2
    children = spark.createDataFrame([(1, "x"), (1, "w")], "project_id long, what string")
    got = {r.id: json.loads(r.document) for r in sinks.nested(rows, {"parts": children}).collect()}
    assert got == {1: {"id": 1, "parts": [{"what": "w"}, {"what": "x"}]}, 2: {"id": 2, "name": "b|c"}}
