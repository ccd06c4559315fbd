"""Contradictions, implausible figures and provenance, on inputs joined from the tables beneath each record."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.operators import rules
from claimforge.plans.registry import register
from claimforge.session import table

AS_OF = "1998-01-10"
_CATEGORIES = ("grid_capacity", "water", "permitting", "equipment_supply", "financing")
_MILESTONES = {"signup": "announced", "view": "permit_filed", "click": "groundbreaking", "purchase": "energized", "error": "equipment_install"}


def _projects(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    phase = F.when((F.col("o_orderstatus") == "P") & (F.col("c_mktsegment") == "MACHINERY"), "cancelled").when(F.col("o_orderstatus") == "P", "construction").when(
        F.col("o_orderstatus") == "O", "announced").otherwise("operational")
    return x.select(
        F.col("o_orderkey").alias("id"), phase.alias("phase"), F.col("o_totalprice").alias("mw_planned"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal") * 20).alias("mw_built"),
        F.to_date("o_orderdate").alias("announced"), F.date_add(F.to_date("o_orderdate"), F.floor(F.col("c_acctbal") / 10).cast("int")).alias("online"),
        F.concat("n_name", F.when(F.col("c_mktsegment") == "BUILDING", " County").otherwise(" City")).alias("city"), F.substring("o_orderpriority", 3, 30).alias("tenant"))


def _claims(spark, d):
    quote = F.when(F.col("l_returnflag") == "R", "N/A").when(F.col("l_discount") < 0.005, " ").otherwise(F.concat(F.lit("ships "), F.col("l_quantity").cast("int"), F.lit(" MW")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_extendedprice").alias("value_num"), quote.alias("quote"))


def _blocks(spark, d):
    key = F.concat(F.lit("phase-"), "l_linenumber", F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit(".hall-"), F.lower("l_returnflag"))))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), key.alias("block_key"), F.col("l_extendedprice").alias("mw"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N"), "live").when(F.col("l_tax") > 0.075, "ended").otherwise("pending").alias("state"),
        (F.col("l_tax") < 0.045).alias("confirmed"), F.to_date("l_shipdate").alias("online"), (F.col("l_linenumber") < 7).alias("placed"))


def _events(spark, d):
    kind = F.create_map(*[F.lit(x) for pair in _MILESTONES.items() for x in pair])
    return table(spark, d, "events").select(
        F.floor(F.col("event_id") / 4).cast("long").alias("project_id"), kind[F.col("event_type")].alias("event_type"), F.date_sub(F.to_date("ts"), 9500).alias("event_date"))


def _risks(spark, d):
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("l_partkey") % 5).cast("int") + 1)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), category.alias("category"), F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"))


_BENEATH = """p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'announced' WHEN 'F' THEN 'operational' ELSE CASE WHEN c_mktsegment = 'MACHINERY' THEN 'cancelled' ELSE 'construction' END END AS phase,
 o_totalprice AS planned, CASE WHEN c_acctbal > 5000 THEN c_acctbal * 20 END AS built, CAST(o_orderdate AS DATE) AS announced, CAST(o_orderdate AS DATE) + CAST(floor(c_acctbal / 10) AS INT) AS online,
 c_mktsegment = 'BUILDING' AS county, upper(substr(o_orderpriority, 3)) = 'NOT SPECIFIED' AS blank FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT l_orderkey AS id, l_extendedprice AS mw, l_returnflag = 'R' OR l_discount < 0.005 AS noquote, l_linestatus = 'F' AND l_returnflag IN ('A', 'R') AS live,
 l_tax <= 0.075 AND NOT (l_linestatus = 'F' AND l_returnflag IN ('A', 'R')) AS waiting, l_tax < 0.045 AS sure, CAST(l_shipdate AS DATE) AS due, l_linenumber AS n, l_returnflag AS flag,
 l_linestatus = 'O' AS isopen, l_partkey % 5 AS cat FROM lineitem),
e AS (SELECT event_id // 4 AS id, event_type AS t, CAST(ts AS DATE) - 9500 AS day FROM events),
s AS (SELECT id, list_distinct(list(t)) AS ts FROM e GROUP BY id),
b AS (SELECT p.*, (SELECT max(mw) FROM l WHERE l.id = p.id) AS best, (SELECT sum(mw) FROM l WHERE l.id = p.id) AS total, (SELECT count(*) FROM l WHERE l.id = p.id) AS nb,
 coalesce((SELECT bool_or(noquote) FROM l WHERE l.id = p.id), false) AS noquote, coalesce((SELECT bool_or(live) FROM l WHERE l.id = p.id), false) AS live,
 coalesce((SELECT bool_or(waiting) FROM l WHERE l.id = p.id), false) AS waiting, coalesce((SELECT bool_or(live AND sure) FROM l WHERE l.id = p.id), false) AS cited,
 coalesce((SELECT bool_or(waiting AND due < DATE '1998-01-10') FROM l WHERE l.id = p.id), false) AS late, coalesce((SELECT bool_or(due >= DATE '1998-01-10') FROM l WHERE l.id = p.id), false) AS ahead,
 coalesce((SELECT bool_or(n = 7) FROM l WHERE l.id = p.id), false) AS unplaced, EXISTS (SELECT 1 FROM l x JOIN l y ON x.id = y.id AND x.n = y.n WHERE x.id = p.id AND x.flag <> 'A' AND y.flag = 'A') AS nested,
 EXISTS (SELECT 1 FROM e WHERE e.id = p.id) AS told, EXISTS (SELECT 1 FROM e WHERE e.id = p.id AND t = 'purchase' AND day <= DATE '1998-01-10') AS energized, EXISTS (SELECT 1 FROM e WHERE e.id = p.id AND day > DATE '1998-01-10') AS future,
 EXISTS (SELECT 1 FROM e WHERE e.id = p.id AND t IN ('click', 'error')) AS started, EXISTS (SELECT 1 FROM e WHERE e.id = p.id AND t = 'error') AS equipped,
 EXISTS (SELECT 1 FROM l JOIN s ON s.id = l.id WHERE l.id = p.id AND isopen AND ((cat = 0 AND list_contains(ts, 'purchase')) OR (cat IN (1, 2) AND (list_contains(ts, 'click') OR list_contains(ts, 'error') OR list_contains(ts, 'purchase')))
   OR (cat = 3 AND list_contains(ts, 'error')))) AS over FROM p)"""


def _codes(*rows):
    return " UNION ALL ".join(f"SELECT id, '{code}' AS code, '{severity}' AS severity FROM b WHERE {test}" for code, severity, test in rows)


@register(f"WITH {_BENEATH} " + _codes(
    ("value_without_evidence", "warning", "nb = 0"),
    ("value_above_its_evidence", "warning", "nb > 0 AND planned - greatest(best, total) > 0.2 * planned"),
    ("phase_without_construction", "warning", "(phase = 'construction' OR phase = 'operational') AND told AND built IS NULL AND NOT (energized OR started)"),
    ("milestone_in_the_future", "warning", "future"),
    ("live_block_without_cited_capacity", "warning", "phase = 'operational' AND live AND built IS NULL"),
    ("operational_without_built_capacity", "warning", "phase = 'operational' AND NOT live AND built IS NULL"),
    ("built_capacity_uncited_in_blocks", "warning", "built > 0 AND phase = 'operational' AND live AND NOT cited"),
    ("no_block_for_energisation", "warning", "energized AND phase IN ('announced', 'construction') AND nb > 0 AND NOT live"),
    ("energized_but_not_operational", "error", "energized AND phase IN ('announced', 'construction') AND (nb = 0 OR (live AND NOT waiting))"),
    ("built_exceeds_planned", "error", "built IS NOT NULL AND built - planned > 0"),
    ("online_before_announced", "error", "announced > online"),
    ("block_past_its_own_date", "warning", "late"),
    ("past_its_own_date", "warning", "phase IN ('announced', 'construction') AND DATE '1998-01-10' > online AND NOT (late OR ahead)"),
    ("block_label_ambiguous", "warning", "unplaced"),
    ("blocks_may_double_count", "warning", "nested"),
    ("cancelled_but_building", "error", "equipped AND phase = 'cancelled'"),
    ("obstacle_on_a_finished_track", "warning", "over"),
    ("placeholder_value", "error", "blank"),
    ("placeholder_quote", "warning", "noquote"),
    ("city_holds_a_county_name", "warning", "county")))
def contradictions(spark, d):
    return rules.contradictions(_projects(spark, d), _claims(spark, d), _blocks(spark, d), _events(spark, d), _risks(spark, d), AS_OF)


@register("""WITH t AS (SELECT l_orderkey AS id, max(l_quantity) AS top FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS id, o_totalprice / 50 AS mw, c_acctbal * 1e6 AS usd, CAST(c_custkey * 1000 AS DOUBLE) * 1.3 / 1000 AS drawn, o_orderstatus AS st, top FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON t.id = o_orderkey)
SELECT id, unnest(list_filter([
 CASE WHEN abs(mw / (top * 1000) - 1) <= 0.15 OR abs(mw / (top * 100) - 1) <= 0.15 OR abs(top / (mw * 1000) - 1) <= 0.15 OR abs(top / (mw * 100) - 1) <= 0.15 THEN 'same_figure_two_units' END,
 CASE WHEN mw > 8000 THEN 'campus_exceeds_worlds_largest' END, CASE WHEN mw >= 1000 AND st <> 'F' THEN 'giant_capacity_unconfirmed' END,
 CASE WHEN mw >= 5 AND (usd < 300000 * mw OR usd > 60000000 * mw) THEN 'usd_per_mw_out_of_band' END, CASE WHEN mw >= 500 AND usd < 3000000 * mw THEN 'investment_below_build_cost' END,
 CASE WHEN drawn < mw / 2 OR drawn > mw * 2 THEN 'h200_disagrees_with_capacity' END, CASE WHEN top / 3 > mw THEN 'block_out_of_scale' END], lambda c: c IS NOT NULL)) AS code FROM x""")
def implausible_figures(spark, d):
    """Orders as campuses: a fiftieth of the price in megawatts, the customer's balance in millions, lines as tranches."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 50).alias("mw"), (F.col("c_acctbal") * 1e6).alias("usd"), (F.col("c_custkey") * 1000).cast("double").alias("chips"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("confidence"))
    return rules.implausible(x, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_quantity").alias("mw")))


@register("""WITH c AS (SELECT l_orderkey, l_linestatus = 'F' AS sure, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS w, l_discount > 0.03 AS quoted, l_tax >= 0.08 AS out,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax >= 0.08, l_linestatus = 'F' DESC, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END DESC, l_shipdate DESC,
 's' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' || CAST(l_linenumber AS VARCHAR) DESC) AS r FROM lineitem)
SELECT l_orderkey AS project_id, CASE WHEN out THEN 'defaulted' WHEN sure AND w > 1 THEN 'reported' WHEN sure THEN 'derived' WHEN quoted THEN 'unconfirmed' ELSE 'inferred' END AS tier FROM c WHERE r = 1""")
def value_provenance(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_quantity").alias("value_num"), (F.col("l_linestatus") == "F").alias("confirmed"), (F.col("l_tax") >= 0.08).alias("decided_against"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END").alias("weight"), F.col("l_shipdate").alias("fetched_at"), (F.col("l_discount") > 0.03).alias("quoted"),
        F.format_string("s%08d-%08d-%d", "l_suppkey", "l_partkey", "l_linenumber").alias("url"))
    return rules.provenance(x)
