"""Tranches, identity and progress: accounting, duplicates, standings, digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimforge.functions.identity import company_key, cross_granularity, dedup_key
from claimforge.operators.components import connected_components
from claimforge.operators.mentions import watched
from claimforge.operators.reports import top_by
from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources.adapters import PROJECT, projects

# tranches: order lines as blocks of their order
_BLOCK = """block AS (SELECT l_orderkey AS project_id, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '-' || strftime(l_shipdate, '%Y%m%d') AS block_key,
  CAST(round(l_quantity * 100) AS BIGINT) AS mw, CAST(l_linenumber % 6 AS INT) AS status_rank, l_returnflag = 'R' AS generation, l_linestatus = 'F' AS confirmed, l_partkey % 10 = 0 AS unplaceable, l_quantity > 45 AS huge, l_suppkey AS tenant FROM lineitem)"""
_STATUSES = ("planned", "permitting", "under_construction", "shell_complete", "energized", "serving")


def _blocks(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.expr("concat(lpad(l_linenumber, 2, '0'), '-', lpad(l_partkey, 8, '0'), '-', lpad(l_suppkey, 8, '0'), '-', date_format(l_shipdate, 'yyyyMMdd'))").alias("block_key"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("mw"), F.expr("int(l_linenumber % 6)").alias("status_rank"), (F.col("l_returnflag") == "R").alias("generation"),
        (F.col("l_linestatus") == "F").alias("confirmed"), (F.col("l_partkey") % 10 == 0).alias("unplaceable"), (F.col("l_quantity") > 45).alias("huge"), F.col("l_suppkey").alias("tenant"))


_REASON = "CASE WHEN generation THEN 'generation' WHEN unplaceable THEN 'unplaceable' WHEN huge THEN 'out_of_scale' WHEN NOT confirmed THEN 'unconfirmed' ELSE 'counted' END"


@register(f"""WITH {_BLOCK}, r AS (SELECT *, {_REASON} AS reason FROM block), s AS (SELECT project_id,
 CAST(sum(CASE WHEN reason = 'generation' THEN mw ELSE 0 END) AS BIGINT) AS generation, CAST(sum(CASE WHEN reason = 'unplaceable' THEN mw ELSE 0 END) AS BIGINT) AS unplaceable,
 CAST(sum(CASE WHEN reason = 'out_of_scale' THEN mw ELSE 0 END) AS BIGINT) AS out_of_scale, CAST(sum(CASE WHEN reason = 'unconfirmed' THEN mw ELSE 0 END) AS BIGINT) AS unconfirmed,
 CAST(sum(CASE WHEN reason = 'counted' THEN mw ELSE 0 END) AS BIGINT) AS counted FROM r GROUP BY project_id)
SELECT *, greatest(0, 15000 - counted - unconfirmed - unplaceable - out_of_scale) AS unitemised, greatest(0, counted + unconfirmed + unplaceable + out_of_scale - 15000) AS overlap FROM s""")
def block_accounting_pivot(spark, d):
    """A project's capacity by reason; what is left of 150 MW is unitemised, what is over overlaps."""
    reasons = ["generation", "unplaceable", "out_of_scale", "unconfirmed", "counted"]
    pivot = _blocks(spark, d).withColumn("reason", F.expr(_REASON)).groupBy("project_id").pivot("reason", reasons).sum("mw").na.fill(0, reasons)
    known = F.col("counted") + F.col("unconfirmed") + F.col("unplaceable") + F.col("out_of_scale")
    return pivot.withColumn("unitemised", F.greatest(F.lit(0), 15000 - known)).withColumn("overlap", F.greatest(F.lit(0), known - 15000))


@register(f"""WITH {_BLOCK}, g AS (SELECT project_id, tenant, sum(mw) AS mw FROM block GROUP BY project_id, tenant), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY mw DESC, tenant DESC) = 1)
SELECT b.project_id, CAST(sum(CASE WHEN confirmed THEN b.mw ELSE 0 END) AS BIGINT) AS planned, CAST(sum(CASE WHEN confirmed AND status_rank >= 4 THEN b.mw ELSE 0 END) AS BIGINT) AS built, max(status_rank) AS furthest, max(t.tenant) AS tenant
FROM block b JOIN t USING (project_id) GROUP BY b.project_id""")
def block_rollup(spark, d):
    b = _blocks(spark, d)
    sums = b.groupBy("project_id", "tenant").agg(
        F.sum("mw").alias("mw"), F.sum(F.when(F.col("confirmed"), F.col("mw")).otherwise(0)).alias("planned"),
        F.sum(F.when(F.col("confirmed") & (F.col("status_rank") >= 4), F.col("mw")).otherwise(0)).alias("built"), F.max("status_rank").alias("furthest"))
    return sums.groupBy("project_id").agg(F.sum("planned").alias("planned"), F.sum("built").alias("built"), F.max("furthest").alias("furthest"), F.max_by("tenant", F.struct("mw", "tenant")).alias("tenant"))


@register(f"WITH {_BLOCK} SELECT project_id, (['planned','permitting','under_construction','shell_complete','energized','serving'])[max(status_rank) + 1] AS status FROM block GROUP BY project_id")
def furthest_status(spark, d):
    names = F.array(*map(F.lit, _STATUSES))
    return _blocks(spark, d).groupBy("project_id").agg(F.max("status_rank").alias("r")).select("project_id", F.element_at(names, F.col("r") + 1).alias("status"))


@register(f"WITH {_BLOCK} SELECT project_id, CASE WHEN count(*) = 1 THEN 'single_block' WHEN bool_and(confirmed) THEN 'itemised' WHEN bool_or(confirmed) THEN 'unread' ELSE 'no_article' END AS state FROM block GROUP BY project_id")
def itemisation(spark, d):
    state = F.when(F.count("*") == 1, "single_block").when(F.bool_and("confirmed"), "itemised").when(F.bool_or("confirmed"), "unread").otherwise("no_article")
    return _blocks(spark, d).groupBy("project_id").agg(state.alias("state"))


@register(f"WITH {_BLOCK} SELECT project_id, status_rank, block_key FROM block QUALIFY row_number() OVER (PARTITION BY project_id, status_rank ORDER BY confirmed DESC, mw DESC, length(block_key), block_key) = 1")
def section_canonical(spark, d):
    order = [F.desc("confirmed"), F.desc("mw"), F.length("block_key"), F.col("block_key")]
    return top_by(_blocks(spark, d), ["project_id", "status_rank"], order).select("project_id", "status_rank", "block_key")


@register(f"""WITH {_BLOCK}, s AS (SELECT project_id, tenant, CAST(sum(mw) AS BIGINT) AS planned, CAST(sum(CASE WHEN status_rank >= 4 THEN mw ELSE 0 END) AS BIGINT) AS built FROM block GROUP BY ALL),
c AS (SELECT project_id, sum(planned) AS claimed FROM s GROUP BY 1)
SELECT o_orderkey AS project_id, CAST(greatest(0, 20000 - coalesce(claimed, 0)) AS BIGINT) AS residual FROM orders LEFT JOIN c ON o_orderkey = project_id""")
def block_shares_residual(spark, d):
    """What tenants' tranches leave of a project's 200 MW."""
    claimed = _blocks(spark, d).groupBy("project_id").agg(F.sum("mw").alias("claimed"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"))
    return o.join(claimed, "project_id", "left").select("project_id", F.greatest(F.lit(0), 20000 - F.coalesce("claimed", F.lit(0))).cast("long").alias("residual"))


# identity
_SLUG = "trim(regexp_replace(lower(replace(n, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


@register(r"""WITH x AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ', Inc.' WHEN s_suppkey % 3 = 1 THEN ' Holdings Group' ELSE '' END AS n FROM supplier),
s AS (SELECT s_suppkey, """ + _SLUG + r""" AS k FROM x)
SELECT s_suppkey, regexp_replace(regexp_replace(k, ' (inc|group)$', ''), ' holdings$', '') AS company_key FROM s""")
def company_keys(spark, d):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, ", Inc.").when(F.col("s_suppkey") % 3 == 1, " Holdings Group").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", company_key(name, folded=True).alias("company_key"))


@register("""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || '|' ||
 CASE WHEN c_custkey % 4 = 0 THEN 'county:' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) ELSE 'city:' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) END || '|' || upper(substr(n_name, 1, 2)) AS dedup_key
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def dedup_keys(spark, d):
    x = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.col("c_custkey") % 4 == 0, F.concat("n_name", F.lit(" County"))).otherwise(F.col("n_name"))
    return x.select("c_custkey", dedup_key(F.col("c_name"), city, F.lit(None).cast("string"), F.substring("n_name", 1, 2)).alias("dedup_key"))


# parts as sites: a brand is a locality, words of the type are names
@register("""WITH p AS (SELECT p_partkey, p_brand, p_size, p_type FROM part)
SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, CASE WHEN a.p_type = b.p_type THEN 'identity' ELSE 'name' END AS kind
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE len(list_intersect(string_split(a.p_type, ' '), string_split(b.p_type, ' '))) > 0 AND NOT (a.p_partkey % 10 = 0 AND b.p_partkey % 10 = 1)""")
def candidate_pairs(spark, d):
    """Pairs within a bucket whose names share a word; pairs that were parked are left out."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type", F.split("p_type", " ").alias("words"))
    a, b = (p.select("p_brand", "p_size", *(F.col(c).alias(f"{side}_{c}") for c in ("p_partkey", "p_type", "words"))) for side in "ab")
    pairs = a.join(b, ["p_brand", "p_size"]).where((F.col("a_p_partkey") < F.col("b_p_partkey")) & F.arrays_overlap("a_words", "b_words"))
    parked = (F.col("a_p_partkey") % 10 == 0) & (F.col("b_p_partkey") % 10 == 1)
    kind = F.when(F.col("a_p_type") == F.col("b_p_type"), "identity").otherwise("name")
    return pairs.where(~parked).select(F.col("a_p_partkey").alias("a_id"), F.col("b_p_partkey").alias("b_id"), kind.alias("kind"))


@register("""WITH RECURSIVE e AS (SELECT DISTINCT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey AND a.p_partkey % 3 = b.p_partkey % 3),
r AS (SELECT x AS node, x AS label FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.node WHERE r.label < e.y)
SELECT node, min(label) AS component FROM r GROUP BY node""")
def duplicate_groups(spark, d):
    """Transitive closure of pairs; a bucket's rows meet in a star, not in all pairs."""
    p = table(spark, d, "part").select("p_partkey", F.min("p_partkey").over(Window.partitionBy("p_brand", "p_size", F.col("p_partkey") % 3)).alias("least"))
    return connected_components(p.where("p_partkey <> least"), "least", "p_partkey")


@register("""WITH p AS (SELECT p_partkey, p_brand, unnest(string_split(p_type, ' ')) AS word FROM part)
SELECT word FROM p GROUP BY word HAVING count(DISTINCT p_brand) = (SELECT max(n) FROM (SELECT count(DISTINCT p_brand) AS n FROM p GROUP BY word))""")
def identifying_keys(spark, d):
    """Words that occur in the most brands; the reference point of keys that identify a place."""
    p = table(spark, d, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("word"))
    n = p.groupBy("word").agg(F.count_distinct("p_brand").alias("n"))
    return n.join(F.broadcast(n.agg(F.max("n").alias("n"))), "n").select("word")


@register("""WITH m AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS keep FROM orders), l AS (SELECT DISTINCT keep, l_linenumber, l_partkey FROM lineitem JOIN m ON l_orderkey = o_orderkey)
SELECT keep AS project_id, count(*) AS children FROM l GROUP BY keep""")
def merge_apply(spark, d):
    """Children of merged records go to the survivor; those with its natural keys collapse."""
    o = table(spark, d, "orders")
    m = o.select("o_orderkey", F.min("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority")).alias("keep"))
    moved = table(spark, d, "lineitem").join(m, F.col("l_orderkey") == F.col("o_orderkey")).select("keep", "l_linenumber", "l_partkey").distinct()
    return moved.groupBy(F.col("keep").alias("project_id")).agg(F.count("*").alias("children"))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def known_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@register("""WITH g AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS double_counted FROM g WHERE r > 1 GROUP BY o_custkey""")
def double_counted(spark, d):
    """A group's capacity beyond its largest member."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(cents).alias("all"), F.max(cents).alias("most"), F.count("*").alias("n"))
    return sums.where("n > 1").select("o_custkey", (F.col("all") - F.col("most")).alias("double_counted"))


# customers as sites: segment and nation are the company, thousands of the balance the place and how finely it is named
_GRANULAR = """k AS (SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || c_nationkey || '|' || CASE WHEN CAST(floor(c_acctbal / 1000) AS BIGINT) % 2 = 0 THEN 'city:' ELSE 'county:' END || 'p' || CAST(floor(c_acctbal / 2000) AS BIGINT) || '|X' AS key FROM customer),
p AS (SELECT id, split_part(key, '|', 1) AS company, split_part(split_part(key, '|', 2), ':', 1) AS kind, split_part(split_part(key, '|', 2), ':', 2) AS place FROM k)"""


@register(f"""WITH {_GRANULAR}, o AS (SELECT company, place, kind, min(id) AS least FROM p GROUP BY ALL)
SELECT DISTINCT least(id, least) AS a_id, greatest(id, least) AS b_id FROM p JOIN o ON p.company = o.company AND p.place = o.place AND p.kind <> o.kind""")
def cross_granularity_pairs(spark, d):
    """City and county records of one company and place: each with the least record of the other kind, not all with all."""
    thousands = lambda n: F.floor(F.col("c_acctbal") / n)
    key = F.concat(F.lower("c_mktsegment"), F.lit(" "), "c_nationkey", F.lit("|"), F.when(thousands(1000) % 2 == 0, "city:").otherwise("county:"), F.lit("p"), thousands(2000), F.lit("|X"))
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), key.alias("key"))
    least = k.groupBy(F.col("key").alias("other")).agg(F.min("id").alias("least"))
    swapped = F.when(F.contains("key", F.lit("|city:")), F.replace("key", F.lit("|city:"), F.lit("|county:"))).otherwise(F.replace("key", F.lit("|county:"), F.lit("|city:")))
    met = k.join(least, swapped == F.col("other")).where(cross_granularity(F.col("key"), F.col("other")))
    return met.select(F.least("id", "least").alias("a_id"), F.greatest("id", "least").alias("b_id")).distinct()


# progress: users as projects, event types as milestones
_IMPLIED = {"purchase": ["view", "click"], "click": ["view"], "refund": ["purchase"], "signup": ["view"]}


@register("""WITH r AS (SELECT user_id, list_distinct(list(event_type)) AS seen FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id)
SELECT user_id, len(seen) AS reached, len(list_filter(list_distinct(list_concat(CASE WHEN list_contains(seen, 'purchase') THEN ['view', 'click'] ELSE [] END, CASE WHEN list_contains(seen, 'click') THEN ['view'] ELSE [] END,
 CASE WHEN list_contains(seen, 'refund') THEN ['purchase'] ELSE [] END, CASE WHEN list_contains(seen, 'signup') THEN ['view'] ELSE [] END)), lambda x: NOT list_contains(seen, x))) AS implied FROM r""")
def implied_milestones(spark, d):
    """Milestones that reached ones imply, one step deep, without those reached."""
    seen = table(spark, d, "events").where("ts <= timestamp_ntz'2024-01-20'").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    implied = F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*[
        F.when(F.array_contains("seen", k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in _IMPLIED.items()])))
    return seen.select("user_id", F.size("seen").cast("long").alias("reached"), F.size(F.array_except(implied, "seen")).cast("long").alias("implied"))


_LADDER = ("view", "click", "purchase", "refund")


@register("""WITH r AS (SELECT user_id, list_distinct(list(event_type)) AS seen FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id),
f AS (SELECT user_id, greatest(CASE WHEN list_contains(seen, 'view') THEN 1 ELSE 0 END, CASE WHEN list_contains(seen, 'click') THEN 2 ELSE 0 END, CASE WHEN list_contains(seen, 'purchase') THEN 3 ELSE 0 END, CASE WHEN list_contains(seen, 'refund') THEN 4 ELSE 0 END) AS far FROM r)
SELECT user_id, CAST(far AS INT) AS furthest, (['view','click','purchase','refund'])[far + 1] AS next_milestone FROM f""")
def track_standing(spark, d):
    """The furthest rung as of a date, and the one after it, null at the top."""
    rank = F.array_position(F.array(*map(F.lit, _LADDER)), F.col("event_type"))
    far = table(spark, d, "events").where("ts <= timestamp_ntz'2024-01-20'").groupBy("user_id").agg(F.max(rank).cast("int").alias("furthest"))
    return far.withColumn("next_milestone", F.try_element_at(F.array(*map(F.lit, _LADDER)), F.col("furthest") + 1))


@register("""SELECT user_id, event_type, CAST(min(ts) AS DATE) AS first_day, count(*) - 1 AS restated, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) > 20 AS conflicting FROM events GROUP BY user_id, event_type""")
def timeline_fold(spark, d):
    first, last = F.min("ts"), F.max("ts")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.to_date(first).alias("first_day"), (F.count("*") - 1).alias("restated"), (F.datediff(F.to_date(last), F.to_date(first)) > 20).alias("conflicting"))


@register("""WITH s AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT user_id, count(*) AS slips, CAST(sum(CAST(round((value - before) * 100) AS BIGINT)) AS BIGINT) AS slipped FROM s WHERE value > before GROUP BY user_id""")
def slippage_lag(spark, d):
    s = table(spark, d, "events").withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts")))
    return s.where("value > before").groupBy("user_id").agg(F.count("*").alias("slips"), F.sum(F.round((F.col("value") - F.col("before")) * 100).cast("long")).alias("slipped"))


_SIGN = "CASE event_type WHEN 'refund' THEN 'bad' WHEN 'purchase' THEN 'good' ELSE 'neutral' END"


@register(f"""SELECT user_id, count(*) FILTER ({_SIGN} = 'good') AS good, count(*) FILTER ({_SIGN} = 'bad') AS bad, count(*) FILTER ({_SIGN} = 'neutral') AS neutral FROM events
WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-22' GROUP BY user_id""")
def digest_counts(spark, d):
    sign = F.expr(_SIGN)
    rows = table(spark, d, "events").where("ts > timestamp_ntz'2024-01-15' and ts <= timestamp_ntz'2024-01-22'")
    return rows.groupBy("user_id").agg(*[F.count_if(sign == s).alias(s) for s in ("good", "bad", "neutral")])


@register(f"""SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-22'
ORDER BY round(value) DESC, CASE {_SIGN} WHEN 'bad' THEN 0 WHEN 'good' THEN 1 ELSE 2 END, ts DESC, event_id LIMIT 50""")
def digest_rank(spark, d):
    rows = table(spark, d, "events").where("ts > timestamp_ntz'2024-01-15' and ts <= timestamp_ntz'2024-01-22'")
    order = F.expr(f"CASE {_SIGN} WHEN 'bad' THEN 0 WHEN 'good' THEN 1 ELSE 2 END")
    return rows.orderBy(F.round("value").desc(), order, F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "event_type")


@register("""SELECT user_id, event_type, event_id, restated FROM (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) - 1 AS restated,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def digest_fold(spark, d):
    """The best signal of each kind, with how many restate it; a combined maximum, no window."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), (F.count("*") - 1).alias("restated"))


@register(f"""WITH {PROJECT}, w AS (SELECT c_name AS entry, c_name AS key, 1 AS prio FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT c_name, c_mktsegment, 2 FROM customer WHERE c_custkey % 40 = 0),
m AS (SELECT entry, id, prio FROM w JOIN project ON key = company UNION ALL SELECT entry, id, prio FROM w JOIN project ON key = segment)
SELECT entry, id, CASE min(prio) WHEN 1 THEN 'operator' ELSE 'tenant' END AS via FROM m GROUP BY entry, id""")
def watch_match(spark, d):
    """Watched names by operator, else by tenant; the first way counts."""
    p, c = projects(spark, d), table(spark, d, "customer")
    w1 = c.where("c_custkey % 20 = 0").select(F.col("c_name").alias("entry"), F.col("c_name").alias("key"), F.lit(1).alias("prio"))
    w2 = c.where("c_custkey % 40 = 0").select(F.col("c_name").alias("entry"), F.col("c_mktsegment").alias("key"), F.lit(2).alias("prio"))
    return watched(w1.union(w2), p.select("id", F.array("company", "segment").alias("keys"))).select("entry", "id", F.when(F.col("prio") == 1, "operator").otherwise("tenant").alias("via"))
