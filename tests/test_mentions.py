"""Names in texts, and addresses of projects."""

import random

from claimforge.operators import mentions as M


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "nova", "cloud", "ray", "west", "oak", "Élan"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randrange(6))).title() + rng.choice(["", "!"])) for k in range(60)] + [(90, None), (91, ""), (1, "twice the oak"), (1, "twice the oak")]
    names = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 3])))) for k in range(20)] + [(30, None), (31, "!?"), (32, "never said"), (33, "oak")]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower().replace("é", "e")).split())
    expected = {(a, b) for a, t in texts for b, n in names if plain(n) and f" {plain(n)} " in f" {plain(t)} "}
    found = M.mentions(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_addresses(spark):
    projects = [(1, "Heron", "Nimbus Corp", "Abilene", None), (2, "Data Center", "Nimbus", None, "Taylor County"), (3, "Egret", "Nimbus, Inc.", " ", None), (4, "Heron", "Acme", "Abilene", None), (5, None, None, None, None)]
    urls = [("https://a.example/nimbus-plans-abilene-campus.html", None), ("https://a.example/2025/x", "Nimbus and its Egret site"), ("https://nimbus.example/abilene", "nothing"), ("https://a.example/nimbus", "in Taylor County"),
            ("https://a.example/nimbus-results", ""), ("https://a.example/nimbus-plans-abilene-campus.html", None)]
    found = M.address_matches(spark.createDataFrame(urls, "url string, title string"), spark.createDataFrame(projects, "id long, name string, company string, city string, county string"))
    assert sorted((r.url.rsplit("/", 1)[1], r.id, r.evidence) for r in found.collect()) == [("nimbus", 2, "locality"), ("nimbus-plans-abilene-campus.html", 1, "locality"), ("x", 3, "name")]
    assert M.mentions(spark.createDataFrame([], "text_id long, text string"), spark.createDataFrame([], "name_id long, name string")).count() == 0


def test_watched_pairs_come_once_by_their_least_way(spark):
    from claimforge.operators.mentions import watched

    watch = spark.createDataFrame([("a", "x", 1), ("a", "s", 2), ("a", "x", 2), ("b", "s", 2), (None, "s", 2), ("c", None, 1), ("d", "s", 2), ("d", "s", 1)], "entry string, key string, prio int")
    records = spark.createDataFrame([(1, ["x", "s"]), (2, ["y", "s"]), (3, ["x", "y"]), (3, ["y", None]), (4, [None, "x"]), (5, ["z", None])], "id long, keys array<string>")
    found = watched(watch, records)
    assert sorted([(r.entry or "", r.id, r.prio) for r in found.collect()]) == [("", 1, 2), ("", 2, 2), ("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("a", 4, 1), ("b", 1, 2), ("b", 2, 2), ("d", 1, 1), ("d", 2, 1)]


def test_no_pair_of_watch_match_is_shuffled(spark):
    from claimforge.plans import registry

    plan = registry.queries()["watch_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate" in line or "Exchange" in line or "Repartition" in line for line in plan[:next(k for k, line in enumerate(plan) if "Join" in line)])
