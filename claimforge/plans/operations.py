"""Feeds, publishers, rosters, worklists, audit and contradiction rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.operators.reports import top_by
from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources.adapters import CLAIM, PAGE, PROJECT, RISK, claims, pages, projects, risks

_FUNNEL = f"""{PAGE}, cited AS (SELECT coalesce(feed, '(no feed)') AS feed, count(*) AS cited FROM page JOIN documents ON doc_id = page_id WHERE status = 'ok' AND source <> 'src0' GROUP BY 1),
f AS (SELECT coalesce(feed, '(no feed)') AS feed, count(*) AS total, count(*) FILTER (status IN ('ok','no_project')) AS read, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'thin') AS thin FROM page GROUP BY 1),
funnel AS (SELECT f.*, coalesce(cited, 0) AS cited FROM f LEFT JOIN cited USING (feed))"""


def feed_table(spark, d) -> DataFrame:
    """A row a feed: what was fetched, read, and cited."""
    page = pages(spark, d).withColumn("feed", F.coalesce("feed", F.lit("(no feed)")))
    count = lambda name, *s: F.count_if(F.col("status").isin(*s)).alias(name)
    f = page.groupBy("feed").agg(F.count("*").alias("total"), count("read", "ok", "no_project"), count("ok", "ok"), count("failed", "failed"), count("pending", "pending"), count("thin", "thin"))
    docs = table(spark, d, "documents").where("source <> 'src0'").select("doc_id")
    cited = page.where("status = 'ok'").join(docs, F.col("doc_id") == F.col("page_id")).groupBy("feed").agg(F.count("*").alias("cited"))
    return f.join(cited, "feed", "left").na.fill(0, ["cited"])


def verdict(read: Column, failed: Column, cited: Column, least: int = 10) -> Column:
    """What to do about a feed."""
    return (
        F.when((read == 0) & (failed > 0), "cannot read").when(read == 0, "not read yet").when(read < least, "too few to judge")
        .when(cited == 0, "retire").when(F.try_divide(cited, read) < 0.15, "low yield").otherwise("keep")
    )


@register(f"WITH {_FUNNEL} SELECT * FROM funnel")
def feed_funnel(spark, d):
    return feed_table(spark, d)


@register(f"""WITH {_FUNNEL} SELECT feed, CASE WHEN read = 0 AND failed > 0 THEN 'cannot read' WHEN read = 0 THEN 'not read yet' WHEN read < 10 THEN 'too few to judge' WHEN cited = 0 THEN 'retire'
 WHEN CAST(cited AS DOUBLE) / read < 0.15 THEN 'low yield' ELSE 'keep' END AS verdict FROM funnel WHERE feed <> '(no feed)'""")
def feed_verdicts(spark, d):
    return feed_table(spark, d).where("feed <> '(no feed)'").select("feed", verdict(F.col("read"), F.col("failed"), F.col("cited")).alias("verdict"))


@register(f"WITH {PAGE} SELECT host, count(*) AS failures FROM page WHERE status = 'failed' GROUP BY host ORDER BY failures DESC, host LIMIT 20")
def failure_summary(spark, d):
    return pages(spark, d).where("status = 'failed'").groupBy("host").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "host").limit(20)


_SURVEY = f"""{PAGE}, s AS (SELECT host, page_id, status, (size % 4 = 0) AS decisive, (size % 5 = 0) AS contested FROM page),
survey AS (SELECT host, count(*) AS cited, count(*) FILTER (decisive) AS decisive, count(*) FILTER (contested AND NOT decisive) AS contested,
 count(*) FILTER (NOT decisive AND NOT contested) AS inert FROM s GROUP BY host)"""


def survey(spark, d) -> DataFrame:
    s = pages(spark, d).select("host", "status", (F.col("size") % 4 == 0).alias("decisive"), (F.col("size") % 5 == 0).alias("contested"))
    return s.groupBy("host").agg(F.count("*").alias("cited"), F.count_if(F.col("decisive")).alias("decisive"),
                                 F.count_if(F.col("contested") & ~F.col("decisive")).alias("contested"), F.count_if(~F.col("decisive") & ~F.col("contested")).alias("inert"))


@register(f"WITH {_SURVEY} SELECT *, round(decisive / cited, 4) AS yield FROM survey")
def publisher_survey(spark, d):
    return survey(spark, d).withColumn("yield", F.round(F.try_divide("decisive", "cited"), 4))


@register(f"WITH {_SURVEY} SELECT host, cited, decisive FROM survey WHERE cited >= 2 ORDER BY decisive DESC, cited DESC, host LIMIT 10")
def publisher_ranked(spark, d):
    return survey(spark, d).where("cited >= 2").orderBy(F.desc("decisive"), F.desc("cited"), "host").limit(10).select("host", "cited", "decisive")


@register(f"""WITH {_SURVEY}, par AS (SELECT CAST(sum(decisive) AS DOUBLE) / sum(cited) AS par FROM survey)
SELECT host, CASE WHEN decisive = 0 AND cited >= 3 THEN 'ignore' WHEN CAST(decisive AS DOUBLE) / cited > 2 * par THEN 'priority' ELSE 'no change' END AS proposal FROM survey, par""")
def publisher_policy(spark, d):
    """Proposals against the database's own par, a single row that is met on a constant key."""
    s = survey(spark, d)
    par = s.agg((F.sum("decisive").cast("double") / F.sum("cited")).alias("par")).withColumn("one", F.lit(1))
    joined = s.withColumn("one", F.lit(1)).join(F.broadcast(par), "one")
    rate = F.col("decisive").cast("double") / F.col("cited")
    return joined.select("host", F.when((F.col("decisive") == 0) & (F.col("cited") >= 3), "ignore").when(rate > 2 * F.col("par"), "priority").otherwise("no change").alias("proposal"))


@register(f"""WITH {PAGE}, rule AS (SELECT * FROM (VALUES ('example.com', 1), ('th.example.org', 2), ('example.net', 3)) t(domain, r))
SELECT page_id, domain FROM page JOIN rule ON host = domain OR ends_with(host, '.' || domain) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY r) = 1""")
def host_policy(spark, d):
    """The first rule whose domain is the host or a parent of it: hosts are exploded into their suffixes, so the join is by equality."""
    rules = spark.createDataFrame([("example.com", 1), ("th.example.org", 2), ("example.net", 3)], "domain string, r int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    hits = pages(spark, d).select("page_id", F.explode(suffixes).alias("domain")).join(F.broadcast(rules), "domain")
    return hits.groupBy("page_id").agg(F.min_by("domain", "r").alias("domain"))


@register("""WITH c AS (SELECT n_name, count(c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name)
SELECT n_name, customers, segments, CASE WHEN customers = 0 THEN 'absent' WHEN customers < 3 THEN 'thin' ELSE 'covered' END AS status FROM c""")
def roster_coverage(spark, d):
    """Expected names against what is there."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer").where("c_acctbal > 9000")
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"))
    x = n.join(counts, n["n_nationkey"] == counts["c_nationkey"], "left").na.fill(0, ["customers", "segments"])
    status = F.when(F.col("customers") == 0, "absent").when(F.col("customers") < 3, "thin").otherwise("covered")
    return x.select("n_name", "customers", "segments", status.alias("status"))


@register("""WITH c AS (SELECT s_suppkey, s_name, count(l_orderkey) AS found FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity >= 49 AND l_discount < 0.005 GROUP BY ALL)
SELECT s_name, CASE WHEN found = 0 THEN 'absent' ELSE 'thin' END AS status, s_suppkey AS roster_place FROM c WHERE found < 3 ORDER BY found > 0, s_suppkey""")
def hunt_order(spark, d):
    """Expected names to look for: absent ones first, then thinly covered ones, each in the roster's order."""
    roster, lines = table(spark, d, "supplier"), table(spark, d, "lineitem").where("l_quantity >= 49 and l_discount < 0.005D")
    counts = lines.groupBy("l_suppkey").agg(F.count("*").alias("found"))
    x = roster.join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").na.fill(0, ["found"]).where("found < 3")
    status = F.when(F.col("found") == 0, "absent").otherwise("thin")
    return x.orderBy(F.col("found") > 0, "s_suppkey").select("s_name", status.alias("status"), F.col("s_suppkey").alias("roster_place"))


@register("""SELECT s_suppkey, n_name FROM supplier JOIN nation ON contains(lower(s_name || ' of ' || n_name), lower(n_name)) AND s_nationkey = n_nationkey
WHERE len(list_filter(string_split(lower(n_name), ' '), lambda w: NOT list_contains(string_split(lower(s_name || ' of ' || n_name), ' '), w))) = 0""")
def roster_token_match(spark, d):
    """Names all of whose words a record has."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    x = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    have = F.split(F.lower(F.concat("s_name", F.lit(" of "), "n_name")), " ")
    return x.where(F.size(F.array_except(F.split(F.lower("n_name"), " "), have)) == 0).select("s_suppkey", "n_name")


@register(f"""WITH {CLAIM}, v AS (SELECT 'weight' AS axis, CAST(weight AS VARCHAR) AS value FROM claim UNION ALL SELECT 'confirmed', CASE WHEN confirmed THEN 'true' ELSE 'false' END FROM claim UNION ALL SELECT 'phase', value_phase FROM claim),
c AS (SELECT axis, value, count(*) AS n FROM v GROUP BY ALL), m AS (SELECT axis, value, n, sum(n) OVER (PARTITION BY axis) AS total FROM c)
SELECT axis, value AS modal, n, CAST(total AS BIGINT) AS total, CAST(n AS DOUBLE) / total > 0.95 AS collapsed FROM m QUALIFY row_number() OVER (PARTITION BY axis ORDER BY n DESC, value DESC) = 1""")
def axis_census(spark, d):
    pairs = F.create_map(F.lit("weight"), F.col("weight").cast("string"), F.lit("confirmed"), F.col("confirmed").cast("string"), F.lit("phase"), F.col("value_phase"))
    counts = claims(spark, d).select(F.explode(pairs).alias("axis", "value")).groupBy("axis", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("axis").agg(F.max_by("value", F.struct("n", "value")).alias("modal"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.withColumn("collapsed", F.col("n") / F.col("total") > 0.95)


_CARD = f"""{PROJECT}, {CLAIM}, {RISK}, c AS (SELECT project_id, count(*) AS n, bool_or(confirmed) AS sure, count(DISTINCT value_num) AS v FROM claim GROUP BY project_id),
r AS (SELECT project_id, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'open' AND NOT quoted) AS unquoted FROM risk GROUP BY project_id),
card AS (SELECT id, coalesce(n, 0) > 0 AS sourced, coalesce(sure, false) AS sound, coalesce(v, 0) > 1 AS complete, coalesce(unquoted, 0) = 0 AS settled FROM project LEFT JOIN c ON id = c.project_id LEFT JOIN r ON id = r.project_id)"""


def _cards(spark, d) -> DataFrame:
    c = claims(spark, d).groupBy("project_id").agg(F.count("*").alias("n"), F.bool_or("confirmed").alias("sure"), F.count_distinct("value_num").alias("v"))
    r = risks(spark, d).groupBy("project_id").agg(F.count_if((F.col("status") == "open") & ~F.col("quoted")).alias("unquoted"))
    p = projects(spark, d).select("id")
    x = p.join(c, p["id"] == c["project_id"], "left").drop("project_id")
    x = x.join(r, x["id"] == r["project_id"], "left")
    return x.selectExpr("id", "coalesce(n, 0) > 0 AS sourced", "coalesce(sure, false) AS sound", "coalesce(v, 0) > 1 AS complete", "coalesce(unquoted, 0) = 0 AS settled")


@register(f"""WITH {_CARD} SELECT CASE WHEN NOT sourced THEN 0 WHEN NOT sound THEN 1 WHEN NOT complete THEN 2 WHEN NOT settled THEN 3 ELSE 4 END AS tier, count(*) AS projects,
 count(*) FILTER (NOT settled) AS unsettled FROM card GROUP BY 1""")
def clean_tiers(spark, d):
    """The highest tier all of whose lower conditions hold."""
    tier = F.expr("CASE WHEN NOT sourced THEN 0 WHEN NOT sound THEN 1 WHEN NOT complete THEN 2 WHEN NOT settled THEN 3 ELSE 4 END")
    return _cards(spark, d).groupBy(tier.alias("tier")).agg(F.count("*").alias("projects"), F.count_if(~F.col("settled")).alias("unsettled"))


@register(f"""WITH {_CARD}, x AS (SELECT id, CAST(sourced AS INT) + CAST(sound AS INT) + CAST(complete AS INT) + CAST(settled AS INT) AS met FROM card)
SELECT id, 4 - met AS failed FROM x ORDER BY failed DESC, id LIMIT 30""")
def attention(spark, d):
    failed = F.expr("4 - int(sourced) - int(sound) - int(complete) - int(settled)")
    return _cards(spark, d).select("id", failed.alias("failed")).orderBy(F.desc("failed"), "id").limit(30)


@register(f"""WITH {PROJECT}, x AS (SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + 1 AS filled, mw FROM project)
SELECT id, filled FROM x WHERE filled < 4 ORDER BY filled DESC, mw DESC, id LIMIT 25""")
def select_closest(spark, d):
    filled = F.expr("int(id % 3 = 0) + int(id % 5 = 0) + int(id % 7 = 0) + 1")
    return projects(spark, d).select("id", "mw", filled.alias("filled")).where("filled < 4").orderBy(F.desc("filled"), F.desc("mw"), "id").limit(25).select("id", "filled")


_QUERY = ["large", "brushed", "steel", "small"]


@register("""WITH x AS (SELECT p_partkey, len(list_intersect(list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')), ['large','brushed','steel','small'])) / 4.0 AS overlap FROM part)
SELECT p_partkey, CAST(overlap AS DOUBLE) + CASE WHEN p_partkey % 9 = 0 THEN 0.25 ELSE 0 END AS score FROM x WHERE overlap > 0 ORDER BY score DESC, p_partkey LIMIT 12""")
def shortlist_overlap(spark, d):
    words = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    x = table(spark, d, "part").withColumn("overlap", F.size(F.array_intersect(words, F.array(*map(F.lit, _QUERY)))) / F.lit(4.0)).where("overlap > 0")
    return x.select("p_partkey", (F.col("overlap") + F.when(F.col("p_partkey") % 9 == 0, 0.25).otherwise(0.0)).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(12)


def findings(rows: DataFrame, rules: dict[str, Column], *keep: str) -> DataFrame:
    """``keep, code`` for every rule that holds: the rules are one array expression, so all run in one scan."""
    return rows.select(*keep, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("code"))


_AUDIT = {
    "campus_exceeds_worlds_largest": "mw > 8000 * 50", "giant_capacity_unconfirmed": "mw >= 200000 AND phase = 'announced'",
    "usd_per_mw_out_of_band": "usd / mw NOT BETWEEN 0.3 AND 60 AND mw >= 5", "investment_below_build_cost": "usd / mw < 3 AND mw >= 150000",
    "same_figure_two_units": "abs(usd / mw - 1) <= 0.15", "h200_disagrees_with_capacity": "chips / mw NOT BETWEEN 0.5 AND 2", "block_out_of_scale": "largest > 3 * mw",
}
_AUDIT_ROWS = "SELECT id, mw, phase, mw * (1 + id % 70) / 10 AS usd, mw * (1 + id % 5) / 2 AS chips, mw * (id % 9) / 2 AS largest FROM project"


@register(f"WITH {PROJECT}, x AS ({_AUDIT_ROWS}) " + " UNION ALL ".join(f"SELECT id, '{k}' AS code FROM x WHERE {c}" for k, c in _AUDIT.items()))
def audit_rules(spark, d):
    x = projects(spark, d).selectExpr("id", "mw", "phase", "mw * (1 + id % 70) / 10 AS usd", "mw * (1 + id % 5) / 2 AS chips", "mw * (id % 9) / 2 AS largest")
    return findings(x, {k: F.expr(c) for k, c in _AUDIT.items()}, "id")


#: The contradiction rules; E is an error, W a warning.
LOGIC = {
    "value_without_evidence": "mw IS NOT NULL AND claims = 0", "value_above_its_evidence": "mw > best * 1.2 AND claims > 0",
    "phase_without_construction": "phase IN ('construction','operational') AND events > 0 AND NOT energized AND built IS NULL AND NOT started",
    "milestone_in_the_future": "last_event > as_of", "live_block_without_cited_capacity": "phase = 'operational' AND built IS NULL AND live_blocks > 0",
    "operational_without_built_capacity": "phase = 'operational' AND built IS NULL AND live_blocks = 0",
    "built_capacity_uncited_in_blocks": "phase = 'operational' AND built IS NOT NULL AND live_confirmed = 0",
    "no_block_for_energisation": "energized AND phase NOT IN ('operational','paused','cancelled') AND blocks > 0 AND live_blocks = 0",
    "energized_but_not_operational": "energized AND phase NOT IN ('operational','paused','cancelled') AND blocks = 0", "built_exceeds_planned": "built > mw",
    "online_before_announced": "online < announced", "block_past_its_own_date": "late_blocks > 0",
    "past_its_own_date": "late_blocks = 0 AND online < as_of AND phase NOT IN ('operational','paused','cancelled')",
    "block_label_ambiguous": "unplaceable > 0", "blocks_may_double_count": "nested", "cancelled_but_building": "phase IN ('paused','cancelled') AND started",
    "obstacle_on_a_finished_track": "open_risks > 0 AND energized", "placeholder_value": "note IN ('', 'tbd', 'n/a', 'unknown')",
    "placeholder_quote": "quote IN ('', 'tbd', 'n/a')", "city_holds_a_county_name": "regexp_like(city, ' (county|parish|borough)$')",
}
_LOGIC_ROWS = """id, phase, mw, announced, CAST(id % 4 AS BIGINT) AS claims, mw * 0.7 AS best, CAST(id % 3 AS BIGINT) AS events, id % 11 = 0 AS energized, CASE WHEN id % 2 = 0 THEN mw * 1.1 END AS built,
 id % 5 = 0 AS started, announced AS last_event, DATE '1999-01-01' AS as_of, CAST(id % 2 AS BIGINT) AS live_blocks, CAST(id % 3 AS BIGINT) AS live_confirmed, CAST(id % 6 AS BIGINT) AS blocks,
 CASE WHEN id % 8 = 0 THEN DATE '1994-01-01' ELSE DATE '1998-06-01' END AS online, CAST(id % 7 AS BIGINT) AS late_blocks, CAST(id % 13 AS BIGINT) AS unplaceable, id % 17 = 0 AS nested, CAST(id % 2 AS BIGINT) AS open_risks,
 CASE WHEN id % 19 = 0 THEN 'tbd' ELSE 'x' END AS note, CASE WHEN id % 23 = 0 THEN '' ELSE 'q' END AS quote, CASE WHEN id % 29 = 0 THEN 'loudoun county' ELSE 'ashburn' END AS city"""


@register(f"WITH {PROJECT}, x AS (SELECT {_LOGIC_ROWS} FROM project) " + " UNION ALL ".join(
    f"SELECT id, '{k}' AS code FROM x WHERE {c.replace('regexp_like', 'regexp_matches')}" for k, c in LOGIC.items()))
def logic_rules(spark, d):
    projects(spark, d).createOrReplaceTempView("_logic_projects")
    x = spark.sql(f"SELECT {_LOGIC_ROWS} FROM _logic_projects")
    return findings(x, {k: F.expr(c) for k, c in LOGIC.items()}, "id")


@register(f"""WITH {PROJECT} SELECT id, '[audit] ' || phase AS code FROM project WHERE id % 4 = 0""")
def settled_codes(spark, d):
    """Decisions that notes record, one row each."""
    note = F.when(F.col("id") % 4 == 0, F.concat(F.lit("seen\n[audit] "), "phase", F.lit("; kept"))).otherwise("nothing")
    found = F.regexp_extract_all(note, F.lit(r"(\[audit\] [a-z]+)"), F.lit(1))
    return projects(spark, d).select("id", F.explode(found).alias("code"))


@register(f"""WITH {PROJECT}, {RISK} SELECT id, category FROM risk JOIN project ON id = project_id WHERE status = 'open' AND NOT quoted ORDER BY severity_rank DESC, mw DESC, id, risk_id LIMIT 40""")
def unconfirmed_risks(spark, d):
    joined = risks(spark, d).where("status = 'open' and not quoted").join(projects(spark, d).select("id", "mw"), F.col("id") == F.col("project_id"))
    return joined.orderBy(F.desc("severity_rank"), F.desc("mw"), "id", "risk_id").limit(40).select("id", "category")


@register(f"""WITH {PAGE} SELECT status, count(*) AS n, count(*) FILTER (feed IS NULL) AS no_feed, max(size) AS largest FROM page GROUP BY status""")
def queue_stats(spark, d):
    return pages(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("feed").isNull()).alias("no_feed"), F.max("size").alias("largest"))


@register("""SELECT o_orderkey AS id, 'price' AS field FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderkey % 4 = 0""")
def derive_changes(spark, d):
    """Fields that a derivation changed: old and new rows meet, one row per change."""
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = old.select("id", F.when(F.col("id") % 3 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(F.col("id") % 4 == 0, "X").otherwise(F.col("status")).alias("status"))
    both = old.alias("o").join(new.alias("n"), "id", "full_outer")
    return findings(both.select("id", *[(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(c) for c in ("price", "status")]), {c: F.col(c) for c in ("price", "status")}, "id").withColumnRenamed("code", "field")


@register("""SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) AS r FROM supplier JOIN part ON s_suppkey % 25 = p_size % 25) WHERE r <= 2""")
def required_first_match(spark, d):
    from claimforge.operators.reports import top_by as first

    x = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).alias("k"))
    y = first(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).cast("long").alias("k")), ["k"], [F.col("p_partkey")], 2)
    return x.join(y, "k").select("s_suppkey", "p_partkey")


@register("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def contested(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).where("n > 1").select("o_custkey")


__all__ = ["findings", "top_by", "verdict"]
