"""Replies to typed records: what is kept, what is refused, and which reasons values carry."""

import json

import pytest

from claimforge.operators import extraction as X

ARTICLE = """ABILENE, Texas - Nimbus Corp said it will build a 400 megawatt campus named Heron in Abilene, Texas.
The company plans to spend $6.5 billion. Crews broke ground in March 2025, and the first hall is “due online” in the third quarter of 2027.

Hall North will hold 150 MW of capacity. Neighbours filed a lawsuit over noise. The utility warned of a transformer backlog."""


def project(**more):
    found = {"name": "Heron", "company": "Nimbus Corp", "city": "Abilene", "state": "Texas", "mw_planned": 400, "investment_usd": "$6.5 billion", "phase": "construction",
             "evidence": [{"field": "mw_planned", "quote": "a 400 megawatt campus"}, {"field": "investment_usd", "quote": "plans to spend $6.5 billion"}, {"field": "phase", "quote": "crews BROKE ground"}]}
    return found | more


def reply(*projects):
    return "Sure:\n```json\n" + json.dumps({"projects": list(projects)}) + "\n```"


RISKS = [
    {"category": "Community Opposition", "summary": "Neighbours sue.", "quote": "Neighbours filed a lawsuit over noise", "severity": "blocking", "first_seen": "March 2025", "delay_days": 30},
    {"category": "community_opposition", "summary": "Again.", "quote": None, "first_seen": "2025-03-01"}, {"category": "water", "summary": "Dry.", "quote": "Neighbours filed a lawsuit over noise"},
    {"category": "financing", "summary": "Broke.", "quote": "They ran out of money", "severity": "?", "delay_days": -1}, {"category": "weather", "summary": "Rain."}, {"category": "permitting", "summary": " "},
    {"category": "equipment_supply", "summary": "Waits.", "quote": "a transformer backlog", "severity": "material", "delay_days": "soon"}, "odd"]
BLOCKS = [
    {"label": "Hall North", "mw": "150 MW", "status": "serving", "evidence": [{"field": "mw", "quote": "Hall North will hold 150 MW"}]},
    {"label": "Hall South", "mw": 150, "status": "dreaming", "evidence": [{"field": "mw", "quote": "Hall North will hold 150 MW"}]},
    {"label": "Hall East", "mw": 400}, {"label": "hall  north", "mw": 1}, {"label": ""}, 3]
REPLIES = {
    "plain": reply(project()),
    "reasons": reply(project(mw_built=12, customer="Acme", expected_online="Q3 2028", evidence=[
        {"field": "mw_planned", "quote": "plans to spend $6.5 billion"}, {"field": "investment_usd", "quote": "a budget of $6.5 billion was named"}, {"field": "customer", "quote": "  "}, "odd", 7])),
    "invented": reply(project(evidence=[{"field": "mw_planned", "quote": "nobody ever wrote this"}])),
    "edited": reply(project(evidence=[{"field": "mw_planned", "quote": "Nimbus said it will build a 400 megawatt campus named Heron in Abilene"}])),
    "programme": reply(project(mw_planned=100)), "county": reply(project(city="Taylor County", name=None)),
    "several": reply(project(company=None), project(state="Atlantis"), project(city="", county=None), project(), [], project(), project()),
    "obstacles": reply(project(risks=RISKS)), "many": reply(project(risks=[{"category": "water", "summary": str(k), "first_seen": f"20{k + 20}-01-01"} for k in range(9)])), "tranches": reply(project(blocks=BLOCKS)),
}
NOTHING = [None, "", "no json", "{}", '{"projects": 5}', '{"projects": {"a": 1}}', "[1, 2]", '{"projects": [1, "x", null]}']


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, text, ARTICLE) for name, text in REPLIES.items()] + [(f"nothing {k}", text, article) for k, text in enumerate(NOTHING) for article in (ARTICLE, None)]
    read = X.parsed(spark.createDataFrame(rows, "url string, reply string, article string")).cache()
    by = lambda df: {k: [r for r in rows if r.url == k] for rows in [df.collect()] for k in {r.url for r in rows}}
    hindrances = X.obstacles(read).cache()
    return {"records": by(X.records(read)), "refused": by(X.refused(read)), "obstacles": by(hindrances), "worst": by(X.worst_obstacle(hindrances)), "tranches": by(X.tranches(read))}


def test_quoted_values_are_confirmed(found):
    (r,) = found["records"]["plain"]
    assert (r.company, r.city, r.state, r.country, r.mw_planned, r.investment_usd, r.phase) == ("Nimbus Corp", "Abilene", "TX", "US", 400.0, 6_500_000_000, "construction")
    assert r.reasons == {} and r.quotes["mw_planned"] == "a 400 megawatt campus" and r.notes == []


def test_reasons_of_values_that_no_quote_states(found):
    (r,) = found["records"]["reasons"]
    # the quote on the budget was never written, but the one filed with the capacity states the money
    assert r.reasons == {"mw_planned": "quote_off_target", "mw_built": "no_quote", "customer": "no_quote", "expected_online": "no_quote", "phase": "no_quote"}
    assert r.quotes == {"investment_usd": "plans to spend $6.5 billion"}
    assert (r.mw_built, r.customer, str(r.expected_online)) == (12.0, "Acme", "2028-07-01") and r.notes == ["expected_online: to the quarter"]
    assert found["records"]["invented"][0].reasons["mw_planned"] == "quote_unverified"


def test_an_edited_quote_is_replaced_by_the_articles_words(found):
    (r,) = found["records"]["edited"]
    assert "mw_planned" not in r.reasons and r.quotes["mw_planned"] in " ".join(ARTICLE.split())


def test_money_of_a_programme(found):
    (r,) = found["records"]["programme"]
    assert r.reasons["investment_usd"] == "out_of_scale" and r.investment_usd == 6_500_000_000 and "investment_usd: $65M per MW" in r.notes


def test_a_county_in_the_place_of_a_city_and_no_identity(found):
    (r,) = found["records"]["county"]
    assert (r.city, r.county, r.name) == (None, "Taylor County", "Nimbus Corp Taylor County")
    assert [r.place for r in found["records"]["several"]] == [3]  # of the first five, those that are objects
    assert {r.place for r in found["refused"]["several"]} == {0, 1, 2} and set(found["refused"]) == {"several"}


def test_replies_without_projects(found):
    assert not any(name.startswith("nothing") for rows in found.values() for name in rows)


def test_obstacles(found):
    rows = {r.category: (r.severity, r.quote, r.unconfirmed, r.delay_days) for r in found["obstacles"]["obstacles"]}
    assert rows == {
        "community_opposition": ("blocking", "Neighbours filed a lawsuit over noise", None, 30), "water": ("watch", None, "quote_off_target", None),
        "financing": ("watch", None, "quote_unverified", None), "equipment_supply": ("material", "a transformer backlog", None, None)}
    assert [(r.blocker, r.reason) for r in found["worst"]["obstacles"]] == [("Neighbours sue.", None)]
    assert len(found["obstacles"]["many"]) == X.RISKS


def test_tranches_are_vouched_for_by_their_own_quotes(found):
    rows = {r.label: (r.status, r.mw, r.unconfirmed) for r in found["tranches"]["tranches"]}
    assert rows == {"Hall North": ("serving", 150.0, {}), "Hall South": ("planned", 150.0, {"mw": "quote_off_target"}), "Hall East": ("planned", 400.0, {"mw": "no_quote"})}
