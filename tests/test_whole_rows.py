"""Queries that give all rows, against brute force over the whole smallest tables; their SQL still cuts (REPLY_r01.md)."""

import re
from collections import defaultdict

from claimforge.plans import registry
from claimforge.session import table
from claimforge.sources.adapters import claims, projects

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_claim_ranking_ranks_every_project(spark):
    found, want = defaultdict(list), set()
    for r in claims(spark, SF).collect():
        found[r.project_id].append(r)
    for project, own in found.items():
        own.sort(key=lambda r: (not r.decided_against, r.confirmed, r.weight, r.fetched_at, r.url), reverse=True)
        want |= {(project, r.url, k + 1) for k, r in enumerate(own)}
    got = rows(spark, "claim_ranking")
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.project_id % 5 for r in got)


def test_watch_match_takes_every_customer_and_project(spark):
    customers, seen, want = table(spark, SF, "customer").collect(), projects(spark, SF).collect(), {}
    for c in customers:
        keys = [(c.c_name, "operator")] * (c.c_custkey % 20 == 0) + [(c.c_mktsegment, "tenant")] * (c.c_custkey % 40 == 0)
        for key, via in keys:
            for p in seen:
                if key in (p.company, p.segment):
                    want.setdefault((c.c_name, p.id), via)
    got = rows(spark, "watch_match")
    assert {(r.entry, r.id): r.via for r in got} == want and len(got) == len(want)
    assert any(r.via == "tenant" and r.id % 50 for r in got)


def test_keys_of_every_nation(spark):
    nations = {r.n_nationkey: r.n_name for r in table(spark, SF, "nation").collect()}
    fold = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    got = rows(spark, "place_keys")
    assert {r.n_nationkey: r.key for r in got} == {k: fold(n) for k, n in nations.items()} and len(got) == len(nations)
    want = {}
    for c in table(spark, SF, "customer").collect():
        nation = nations[c.c_nationkey]
        place = "county:" + fold(nation) if c.c_custkey % 4 == 0 else "city:" + fold(nation)
        want[c.c_custkey] = f"{fold(c.c_name)}|{place}|{nation[:2].upper()}"
    got = rows(spark, "dedup_keys")
    assert {r.c_custkey: r.dedup_key for r in got} == want and len(got) == len(want)


def test_texts_of_every_language(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.cut for r in rows(spark, "truncate_head_tail")} == {k: t if len(t) <= 500 else t[:345] + "\n[...]\n" + t[-148:] for k, t in docs.items()}
    assert {r.doc_id: r.prose for r in rows(spark, "prose_length")} == {k: sum(n for x in t.split("\n") if (n := len(x.strip(" "))) >= 60) for k, t in docs.items()}

    def score(t):
        hits = ((w, len(re.findall(rf"\b{term}\b", t.lower()))) for term, w in (("the", 1.0), ("ered", 4.0), ("onhe", 2.5)))
        return sum(w * (1 + 0.3 * (n - 1)) for w, n in hits if n) / max(1.0, len(t) / 800)

    got = {r.doc_id: r.score for r in rows(spark, "paragraph_score")}
    assert got.keys() == docs.keys() and all(abs(got[k] - score(t)) < 1e-4 for k, t in docs.items())


def test_reports_hold_every_row(spark):
    want = sorted((r.project_id, r.url) for r in claims(spark, SF).collect() if not r.decided_against and not r.confirmed and r.weight == 1)
    assert [tuple(r) for r in rows(spark, "silent_defects")] == want and len(want) > 500
    groups = defaultdict(list)
    for p in projects(spark, SF).collect():
        groups[p.state, p.segment].append(p)
    want = sorted(((s, g, len(x), ";".join(sorted({p.phase for p in x})), max(p.mw for p in x)) for (s, g), x in groups.items()), key=lambda r: (-r[2], r[0], r[1]))
    assert [tuple(r) for r in rows(spark, "csv_row_shape")] == want and len(want) > 40
