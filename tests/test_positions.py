"""Hedges before figures, sentences around quotes, parts that sentences name."""

import pytest
from pyspark.sql import functions as F

from claimforge.operators import positions as P

HEDGES = [
    ("it will use up to 300 MW", 300.0, "at_most"), ("more than $50 billion, up from the roughly $27 billion plan", 5e10, "at_least"), ("more than $50 billion, up from the roughly $27 billion plan", 2.7e10, "approximate"),
    ("more than approximately 350 MW", 350.0, "at_least"), ("a 1.2 GW campus", 1200.0, "exact"), ("about 1.2 GW", 1200.0, "approximate"), ("about 1,200 MW", 1200.0, "approximate"), ("About 62.5 MW", 62.5, "approximate"),
    ("at least two towns; much later the plant of some people who came there thirty years ago has 300 MW", 300.0, "exact"), ("up to 300 MW", 400.0, "exact"), ("at most or over 9 MW", 9.0, "at_least"), (None, 300.0, "exact"), ("", 1.0, "exact"), ("over 5", None, "exact"), ("over 0", 0.0, "exact")]


def test_bounds(spark):
    df = spark.createDataFrame(HEDGES, "quote string, value double, want string").select("quote", "value", "want", P.bound(F.col("quote"), F.col("value")).alias("got"))
    assert [(r.quote, r.value, r.got) for r in df.collect()] == [(q, v, w) for q, v, w in HEDGES]


def test_hedges_overlap_themselves_and_end_at_most_a_window_before(spark):
    cases = [("maximaximum 9 MW", 9.0, "at_most"), ("over 111", 11.0, "at_least"), ("over " + "x" * 32 + "9", 9.0, "at_least"), ("over " + "x" * 33 + "9", 9.0, "exact"), ("\U0001d7d9 over é 9", 9.0, "at_least")]
    df = spark.createDataFrame(cases, "quote string, value double, want string").select("want", P.bound(F.col("quote"), F.col("value")).alias("got"))
    assert [r.got for r in df.collect()] == [w for *_, w in cases]


def test_a_quote_is_read_once(spark):
    """It used to be worked out again for every letter, hedge and figure."""
    plan = spark.createDataFrame([], "quote string, value double").select(P.bound(F.col("quote"), F.col("value")))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("quote#") == plan.split("\n")[0].count("value#") == 1


def test_sentences_around_quotes(spark):
    article = "Iron Co is building AZP-2 in\nPhoenix, up to 48  megawatts of “IT” capacity. Next year it ends.\n\nA third one, no stop"
    for quote, want in [("UP TO 48 megawatts of \"it\"", "Iron Co is building AZP-2 in\nPhoenix, up to 48  megawatts of “IT” capacity."), ("next year", "Next year it ends."), ("one, no", "A third one, no stop"),
                        ("never said", "never said"), ("", ""), (None, None)]:
        assert P.sentence_of(quote, article) == want
    rows = spark.createDataFrame([("next year", article), (None, article), ("x", None)], "q string, a string")
    assert [r.s for r in rows.select(P.sentence_around("q", "a").alias("s")).collect()] == ["Next year it ends.", None, "x"]


@pytest.mark.parametrize("label, parent, sentence, named", [
    ("AZP-2", None, "Iron Co is building AZP-2 in Phoenix.", True), ("AZP-2", None, "AZP-3 costs more.", False), ("Phase 1", None, "The first phase has 8 megawatts.", True), ("Phase 1", None, "Phase two has 8.", False),
    ("Phase 1", "Abilene", "Abilene has 8 megawatts.", True), ("Hall North", None, "the north hall", True), (None, None, "anything", False), ("Phase 1", None, None, False), ("Building 3", None, "the 3rd building", True)])
def test_parts_that_sentences_name(label, parent, sentence, named):
    assert P.names_part(label, parent, sentence) is named
