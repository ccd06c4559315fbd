"""Re-derivation of what changed equals a derivation of everything."""

import datetime as dt
import random

from claimforge.operators import derivation as D

CLAIM = "key string, url string, field string, value_num double, value_date date, precision string, confirmed boolean, weight int, fetched_at date, decided_against boolean"
DAY = dt.date(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_change_equals_a_full_run_and_touches_only_its_keys(spark):
    rng = random.Random(4)

    def claim(key):
        number = rng.random() < 0.5
        return (key, f"u{rng.randrange(4)}", "mw" if number else "online", float(rng.randrange(1, 500)) if number else None, None if number else DAY + dt.timedelta(rng.randrange(5)),
                None if number else rng.choice([None, "day", "quarter"]), rng.random() < 0.5, rng.randrange(3), DAY + dt.timedelta(rng.randrange(9)), rng.random() < 0.2)

    old = [claim(f"k{k % 20}") for k in range(150)]
    new = [x for x in old if x[0] not in ("k1", "k2")] + [claim("k1"), claim("k30")] + [x for x in old if x[0] == "k3"][:1]
    before, after = spark.createDataFrame(old, CLAIM), spark.createDataFrame(rng.sample(new, len(new)), CLAIM)
    assert {r.key for r in D.dirty_keys(before, after).collect()} == {"k1", "k2", "k3", "k30"}
    table, moved = D.rederive(D.derive(before), before, after)
    assert rows(table) == rows(D.derive(after).select("key", *D.DERIVED))
    assert {r.key for r in moved.collect()} <= {"k1", "k2", "k3", "k30"} and {"k2", "k30"} <= {r.key for r in moved.collect()}


def test_nothing_changed_and_nothing_there(spark):
    claims = spark.createDataFrame([("a", "u", "mw", 100.0, None, None, True, 1, DAY, False), ("b", "u", "mw", 5.0, None, None, True, 1, DAY, True)], CLAIM)
    table, moved = D.rederive(D.derive(claims), claims, claims)
    assert moved.count() == 0 and rows(table) == [("a", 100.0, 77000, None, None, 1), ("b", None, None, None, None, 0)]
    none = spark.createDataFrame([], CLAIM)
    assert D.derive(none).count() == 0
    table, moved = D.rederive(D.derive(claims), claims, none)
    assert table.count() == 0 and {(r.key, r.field) for r in moved.collect()} == {("a", "mw"), ("a", "h200"), ("a", "sources"), ("b", "sources")}


def test_the_precision_is_that_of_the_chosen_date(spark):
    claims = [("a", "u1", "online", None, DAY, "day", True, 1, DAY, False), ("a", "u2", "online", None, DAY + dt.timedelta(90), None, True, 3, DAY, False), ("a", "u3", "online", None, DAY + dt.timedelta(90), "quarter", False, 1, DAY, False)]
    (row,) = D.derive(spark.createDataFrame(claims, CLAIM)).collect()
    assert (row.online, row.online_precision) == (DAY + dt.timedelta(90), "quarter")


def test_only_dirty_keys_are_read_again(spark):
    claims = spark.createDataFrame([("a", "u", "mw", 1.0, None, None, True, 1, DAY, False)], CLAIM)
    table, _ = D.rederive(D.derive(claims), claims, claims)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
