"""Golden records and trust: policies, conflicts, confidence, censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions.identity import registrable_domain
from claimforge.operators import claims as C
from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources.adapters import CLAIM, PAGE, PROJECT, claims, pages, projects

_LIVE = """live AS (
  SELECT * FROM (SELECT *, bool_or(confirmed) OVER (PARTITION BY project_id) AS any_confirmed FROM claim WHERE NOT decided_against)
  WHERE confirmed OR NOT any_confirmed)"""
_ORDER = "confirmed DESC, weight DESC, fetched_at DESC, url DESC"


@register(f"""WITH {CLAIM}, {PROJECT}, {_LIVE}, best AS (
  SELECT project_id, value_num FROM live QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) = 1)
SELECT state, count(*) AS projects, CAST(sum(CAST(round(coalesce(value_num, 0)) AS BIGINT)) AS BIGINT) AS resolved,
       CAST(sum(CAST(round(mw * 100) AS BIGINT)) AS BIGINT) AS mw_cents
FROM project LEFT JOIN best ON id = project_id GROUP BY state""")
def resolve_prefer_weight(spark, d):
    """The strongest claim of each project, with its company's state, rolled up by state."""
    best = C.resolve(claims(spark, d), "prefer_weight", "project_id")
    joined = projects(spark, d).join(best, F.col("id") == F.col("project_id"), "left")
    return joined.groupBy("state").agg(
        F.count("*").alias("projects"), F.sum(F.round(F.coalesce("value", F.lit(0))).cast("long")).alias("resolved"),
        F.sum(F.round(F.col("mw") * 100).cast("long")).alias("mw_cents"))


@register(f"WITH {CLAIM}, {_LIVE} SELECT project_id, max(value_num) AS value FROM live GROUP BY project_id")
def resolve_max(spark, d):
    return C.resolve(claims(spark, d), "max", "project_id")


@register(f"WITH {CLAIM}, {_LIVE} SELECT project_id, min(value_date) AS value FROM live GROUP BY project_id")
def resolve_min(spark, d):
    return C.resolve(claims(spark, d).withColumnRenamed("value_date", "value_str"), "min", "project_id")


@register(f"""WITH {CLAIM}, {_LIVE}, stopped AS (
  SELECT project_id, value_phase FROM live WHERE value_phase IN ('paused','cancelled') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) = 1),
far AS (SELECT project_id, max(list_position(['announced','permitting','construction','operational'], value_phase)) AS r FROM live GROUP BY project_id)
SELECT far.project_id, coalesce(value_phase, (['announced','permitting','construction','operational'])[r]) AS value FROM far LEFT JOIN stopped USING (project_id)""")
def resolve_ladder(spark, d):
    return C.resolve(claims(spark, d).withColumnRenamed("value_phase", "value_str"), "ladder", "project_id")


@register(f"""WITH {CLAIM}, {_LIVE}, best AS (
  SELECT project_id, value_num FROM live QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) = 1)
SELECT o_orderkey AS project_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, value_num) AS value FROM orders LEFT JOIN best ON o_orderkey = project_id""")
def resolve_fill_only(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("existing"))
    return C.with_existing(rows, C.resolve(claims(spark, d), "fill_only", "project_id"), "project_id", "existing", fill_only=True).select("project_id", "value")


_COLLISION = f"""WITH {CLAIM}, {_LIVE}, w AS (
  SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) = 1),
r AS (SELECT live.* FROM live JOIN w USING (project_id)
  WHERE live.value_num <> w.value_num AND abs(live.value_num - w.value_num) > greatest(abs(live.value_num), abs(w.value_num)) * 0.2
  QUALIFY row_number() OVER (PARTITION BY live.project_id ORDER BY live.confirmed DESC, live.weight DESC, live.fetched_at DESC, live.url DESC) = 1),
c AS (SELECT project_id, w.value_num AS winner, r.value_num AS rival,
  CASE WHEN w.weight > r.weight THEN 'weight' WHEN w.fetched_at > r.fetched_at THEN 'recency' ELSE 'tie_break' END AS decided_by FROM w JOIN r USING (project_id))"""


@register(_COLLISION + " SELECT * FROM c")
def conflict_report(spark, d):
    return C.collisions(claims(spark, d), "project_id")


@register(_COLLISION + " SELECT decided_by, count(*) AS n, CAST(sum(CAST(winner - rival AS BIGINT)) AS BIGINT) AS spread FROM c GROUP BY decided_by")
def collision_decided_by(spark, d):
    found = C.collisions(claims(spark, d), "project_id")
    return found.groupBy("decided_by").agg(F.count("*").alias("n"), F.sum((F.col("winner") - F.col("rival")).cast("long")).alias("spread"))


@register("""SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value_str, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value_num
FROM events WHERE event_id % 13 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL""")
def claims_json_explode(spark, d):
    sources = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(F.col("props")).alias("claims"))
    return C.explode_claims(sources, ["k"])


@register(f"""WITH {CLAIM} SELECT project_id, url, CAST(row_number() OVER (PARTITION BY project_id ORDER BY decided_against, confirmed DESC, weight DESC, fetched_at DESC, url DESC) AS INT) AS rank
FROM claim""")
def claim_ranking(spark, d):
    return C.ranked(claims(spark, d), "project_id").select("project_id", "url", "rank")


def _sources(spark, d):
    return claims(spark, d).select(
        "project_id", "weight", (F.col("l_suppkey") % 10 == 0).alias("placeholder"), (F.col("l_partkey") % 9 == 0).alias("derived"),
        (F.col("l_suppkey") % 7 == 0).alias("tertiary"), F.concat(F.lit("d"), F.col("l_suppkey") % 4).alias("domain"),
        F.when(F.col("l_linenumber") % 4 == 0, "").otherwise("mw").alias("fields"), F.col("value_num").alias("mw"),
        F.struct("fetched_at", "url").alias("position"), (F.col("l_linenumber") + 2).alias("populated"), (F.col("l_partkey") % 50 == 0).alias("verified"))


@register(f"""WITH {CLAIM}, s AS (
  SELECT project_id, weight, l_suppkey % 10 = 0 AS placeholder, l_partkey % 9 = 0 AS derived, l_suppkey % 7 = 0 AS tertiary, 'd' || CAST(l_suppkey % 4 AS VARCHAR) AS domain,
         CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'mw' END AS fields, value_num AS mw, fetched_at, url, l_linenumber + 2 AS populated, l_partkey % 50 = 0 AS verified FROM claim),
real AS (SELECT * FROM s WHERE NOT placeholder AND NOT derived),
base AS (SELECT project_id, max(weight) AS best, count(DISTINCT CASE WHEN NOT tertiary AND fields <> '' THEN domain END) AS domains, max(populated) AS populated, bool_or(verified) AS verified FROM real GROUP BY project_id),
t AS (SELECT *, first_value(mw) OVER (PARTITION BY project_id ORDER BY fetched_at, url) AS first_mw FROM real WHERE NOT tertiary),
conflict AS (SELECT project_id, bool_or(mw <> first_mw AND abs(mw - first_mw) > 0.2 * greatest(abs(mw), abs(first_mw))) AS conflict FROM t GROUP BY project_id),
dom AS (SELECT project_id, mw, first_mw FROM t QUALIFY row_number() OVER (PARTITION BY project_id, domain ORDER BY fetched_at, url) = 1),
agree AS (SELECT project_id, count(*) >= 2 AND NOT bool_or(mw <> first_mw AND abs(mw - first_mw) > 0.2 * greatest(abs(mw), abs(first_mw))) AS agree FROM dom GROUP BY project_id),
raw AS (SELECT project_id, populated, verified, least(best, 2) + CAST(domains >= 2 AS INT) + coalesce(CAST(agree AS INT), 0) - coalesce(CAST(conflict AS INT), 0) AS score
  FROM base LEFT JOIN conflict USING (project_id) LEFT JOIN agree USING (project_id)),
scored AS (SELECT project_id, greatest(1, least(3, CASE WHEN verified THEN 3 WHEN populated < 5 THEN least(score, 1) ELSE score END)) AS score FROM raw)
SELECT project_id, CAST(coalesce(score, 0) AS INT) AS score FROM (SELECT DISTINCT project_id FROM s) LEFT JOIN scored USING (project_id)""")
def confidence_score(spark, d):
    return C.confidence(_sources(spark, d), "project_id", ["mw"])


@register(f"""WITH {PAGE} SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, count(*) AS pages, count(DISTINCT host) AS hosts FROM page GROUP BY 1""")
def independent_domains(spark, d):
    return pages(spark, d).groupBy(registrable_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"))


@register(f"""WITH {CLAIM} SELECT project_id, bool_or(confirmed) AS confirmed, bool_or(decided_against) AND NOT bool_or(confirmed) AS out_of_scale,
 bool_or(weight = 1) AND NOT bool_or(confirmed) AND NOT bool_or(decided_against) AS unquoted FROM claim GROUP BY project_id""")
def demoted_sets(spark, d):
    """Membership flags of three sets, each net of the ones before it."""
    flags = claims(spark, d).groupBy("project_id").agg(F.bool_or("confirmed").alias("confirmed"), F.bool_or("decided_against").alias("o"), F.bool_or(F.col("weight") == 1).alias("u"))
    return flags.selectExpr("project_id", "confirmed", "o AND NOT confirmed AS out_of_scale", "u AND NOT confirmed AND NOT o AS unquoted")


_BUCKET = "CASE WHEN decided_against THEN 'superseded' WHEN confirmed AND weight >= 2 THEN 'reported' WHEN confirmed THEN 'derived' WHEN weight = 1 THEN 'defect' ELSE 'unconfirmed' END"


@register(f"""WITH {CLAIM}, c AS (SELECT *, {_BUCKET} AS bucket, year(fetched_at) AS vintage FROM claim)
SELECT coalesce(bucket, '*') AS bucket, CAST(coalesce(vintage, 0) AS INT) AS vintage, count(*) AS n FROM c GROUP BY CUBE (bucket, vintage)""")
def evidence_census(spark, d):
    rows = claims(spark, d).select(F.expr(_BUCKET).alias("bucket"), F.year("fetched_at").alias("vintage"))
    return rows.cube("bucket", "vintage").agg(F.count("*").alias("n")).select(F.coalesce("bucket", F.lit("*")).alias("bucket"), F.coalesce("vintage", F.lit(0)).alias("vintage"), "n")


@register(f"WITH {CLAIM} SELECT project_id, url FROM claim WHERE {_BUCKET} = 'defect' ORDER BY project_id, url")
def silent_defects(spark, d):
    return claims(spark, d).where(F.expr(_BUCKET) == "defect").select("project_id", "url").orderBy("project_id", "url")


@register(f"""WITH {CLAIM}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confirmed DESC, weight DESC, url DESC) AS rn FROM claim WHERE NOT decided_against),
w AS (SELECT * FROM r WHERE rn = 1)
SELECT r.project_id, count(*) AS newer_rivals FROM r JOIN w ON r.project_id = w.project_id AND r.confirmed = w.confirmed AND r.weight = w.weight AND r.fetched_at > w.fetched_at AND r.value_num <> w.value_num
GROUP BY r.project_id""")
def recency_inversions(spark, d):
    """Winners by URL that tied rivals of a later date and another value contest."""
    live = claims(spark, d).where("not decided_against")
    w = live.groupBy("project_id").agg(F.max_by(F.struct("confirmed", "weight", "fetched_at", "value_num"), F.struct("confirmed", "weight", "url")).alias("w"))
    tied = (F.col("confirmed") == F.col("w.confirmed")) & (F.col("weight") == F.col("w.weight")) & (F.col("fetched_at") > F.col("w.fetched_at")) & (F.col("value_num") != F.col("w.value_num"))
    return live.join(w, "project_id").where(tied).groupBy("project_id").agg(F.count("*").alias("newer_rivals"))


@register(f"""WITH {CLAIM}, {_LIVE} SELECT weight, count(*) AS claims, count(DISTINCT project_id) AS projects, CAST(sum(CAST(confirmed AS INT)) AS BIGINT) AS confirmed FROM live GROUP BY weight""")
def claims_by_weight(spark, d):
    live = C.ranked(claims(spark, d).where("not decided_against"), "project_id")
    any_sure = claims(spark, d).where("not decided_against").groupBy("project_id").agg(F.bool_or("confirmed").alias("any"))
    return live.join(any_sure, "project_id").where("confirmed or not any").groupBy("weight").agg(
        F.count("*").alias("claims"), F.count_distinct("project_id").alias("projects"), F.sum(F.col("confirmed").cast("int")).alias("confirmed"))
