"""Contradictions, implausible figures, provenance, codes: small literal records."""

import datetime as dt

from pyspark.sql import functions as F

from claimforge.functions import codes
from claimforge.operators import rules

D = dt.date


def test_contradictions(spark):
    projects = spark.createDataFrame([
        (1, "operational", 100.0, None, D(2020, 1, 1), D(2021, 1, 1), "Ashburn", "Acme"), (2, "construction", 100.0, 120.0, D(2020, 1, 1), D(2019, 1, 1), "Loudoun County", "TBD"),
        (3, "cancelled", None, None, None, None, None, None), (4, "announced", 50.0, None, D(2020, 1, 1), D(2030, 1, 1), "Here", "")],
        "id long, phase string, mw_planned double, mw_built double, announced date, online date, city string, tenant string")
    claims = spark.createDataFrame([(1, 60.0, "sixty"), (1, None, None), (4, 49.0, "x")], "project_id long, value_num double, quote string")
    blocks = spark.createDataFrame([(1, "phase-1", 10.0, "live", False, D(2020, 6, 1), True), (1, "phase-1.hall-a", 10.0, "pending", True, D(2020, 6, 1), False)],
                                   "project_id long, block_key string, mw double, state string, confirmed boolean, online date, placed boolean")
    events = spark.createDataFrame([(3, "equipment_install", D(2020, 1, 1)), (4, "energized", D(2020, 1, 1)), (4, "groundbreaking", D(2029, 1, 1))], "project_id long, event_type string, event_date date")
    risks = spark.createDataFrame([(4, "grid_capacity", "open"), (4, "financing", "open"), (3, "water", "resolved")], "project_id long, category string, status string")
    got = {(r.id, r.code) for r in rules.contradictions(projects, claims, blocks, events, risks, "2025-01-01").collect()}
    assert got == {
        (1, "value_above_its_evidence"), (1, "live_block_without_cited_capacity"), (1, "block_past_its_own_date"), (1, "block_label_ambiguous"), (1, "blocks_may_double_count"), (1, "placeholder_quote"),
        (2, "value_without_evidence"), (2, "built_exceeds_planned"), (2, "online_before_announced"), (2, "past_its_own_date"), (2, "placeholder_value"), (2, "city_holds_a_county_name"),
        (3, "cancelled_but_building"), (4, "energized_but_not_operational"), (4, "milestone_in_the_future"), (4, "obstacle_on_a_finished_track")}
    assert rules.contradictions(projects.limit(0), claims, blocks, events, risks, "2025-01-01").count() == 0


def test_nested_blocks(spark):
    keys = [(1, "phase-1"), (1, "phase-1.hall-a"), (1, "hall-a"), (1, "phase-1"), (2, "phase-1.hall-a"), (2, "phase-10"), (3, None)]
    got = {tuple(r) for r in rules.nested_blocks(spark.createDataFrame(keys, "project_id long, block_key string")).collect()}
    assert got == {(1, "phase-1.hall-a", "phase-1"), (1, "phase-1.hall-a", "hall-a")}


def test_implausible_figures(spark):
    rows = [(1, 9000.0, 10**9, 10**6, 1), (2, 100.0, 10**9, 76923, 3), (3, 1000.0, None, None, 3), (4, None, 5, 5, 1), (5, 0.0, 1, 1, 1)]
    blocks = spark.createDataFrame([(2, 400.0), (3, 1.0), (1, 5000.0)], "project_id long, mw double")
    got = {tuple(r) for r in rules.implausible(spark.createDataFrame(rows, "id long, mw double, usd long, chips long, confidence int"), blocks).collect()}
    assert got == {(1, "campus_exceeds_worlds_largest"), (1, "giant_capacity_unconfirmed"), (1, "usd_per_mw_out_of_band"), (1, "investment_below_build_cost"), (1, "h200_disagrees_with_capacity"),
                   (2, "block_out_of_scale"), (3, "same_figure_two_units")}


def test_provenance(spark):
    rows = [(1, True, False, 3, 1, "a", 5.0, True), (2, True, False, 1, 1, "a", 5.0, True), (3, False, False, 3, 1, "a", 5.0, True), (4, False, False, 3, 1, "a", 5.0, False), (5, True, True, 3, 1, "a", 5.0, True), (6, True, False, 3, 1, "a", None, True)]
    df = spark.createDataFrame(rows, "project_id long, confirmed boolean, decided_against boolean, weight int, fetched_at int, url string, value_num double, quoted boolean")
    assert {r.project_id: r.tier for r in rules.provenance(df).collect()} == {1: "reported", 2: "derived", 3: "unconfirmed", 4: "inferred", 5: "defaulted", 6: "defaulted"}


def test_codes(spark):
    def values(f, raws):
        rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
        return [r.v for r in rows.select("k", f(F.col("raw")).alias("v")).orderBy("k").collect()]

    assert values(codes.norm_state, ["Texas", " va", "D.C.", "Washington D.C.", "n/a", None, "Ontario"]) == ["TX", "VA", None, None, None, None, None]
    assert values(codes.norm_country, ["USA", "de", "Mexico", "Narnia", ""]) == ["US", "DE", "MX", None, None]
    assert values(codes.norm_url, ["https://a.b/c", "http://x", "ftp://a.b", "https://.a", "a.b", "http://a b", None]) == ["https://a.b/c", None, None, None, None, None, None]
    assert values(lambda c: codes.source_type(c, ["op.com"]), ["https://www.op.com/x", "news.op.com", "http://shop.op.com", "https://a.sec.gov", "http://x.gov", "http://x.state.va.us/1", "https://www.utilitydive.com", "http://utilitydive.org", None]) == [
        "company_filing", "company_filing", "general_media", "company_filing", "government_doc", "government_doc", "trade_press", "general_media", "general_media"]
    assert values(codes.demojibake, ["cafÃ©", "café", "plain", None, "â€œquotedâ€\u009d"])[:4] == ["café", "café", "plain", None]
    assert values(codes.label_megawatts, ["Hall A (1,200 MW)", "1.5GW", "MW", None]) == [1200.0, 1500.0, None, None]
    assert values(codes.dollars, [])== []
    assert [list(x) for x in values(codes.names_in, ["a, b,,a ", "", None])] == [["a", "b"], [], []]


def test_axes_fall_back_to_their_defaults(spark):
    from claimforge.operators.gates import axes, records_the_past, supports_risk

    rows = [
        ("region", "at_least", "achieved", "2020-01-01", "More  than 5 jobs in the State; it has begun"), ("region", "at_least", "achieved", "2030-01-01", "nothing"),
        ("block:Hall A", "exact", "speculated", "x", "It could  be"), ("block:hall z", "odd", "contracted", None, None), ("block:", "at_most", "targeted", "", "up to 5 is the goal of it"),
    ]
    df = spark.createDataFrame(rows, "scope string, bound string, modality string, as_of string, quote string")
    c = F.col
    got = df.select(axes(c("scope"), c("bound"), c("modality"), c("as_of"), c("quote"), F.lit("2025-01-01").cast("date"), F.array(F.lit("hall a"))).alias("x"), records_the_past(c("quote")).alias("past"),
                    supports_risk(F.lit("labour"), c("quote"), {"labour": ["jobs"]}).alias("risk")).collect()
    assert [tuple(r.x) for r in got] == [
        ("region", "at_least", "achieved", D(2020, 1, 1)), ("unnamed", "exact", "targeted", D(2030, 1, 1)), ("block:Hall A", "exact", "speculated", None), ("unnamed", "exact", "planned", None), ("unnamed", "at_most", "targeted", None)]
    assert [r.past for r in got] == [True, True, False, True, True] and [r.risk for r in got] == [True, False, False, False, False]
