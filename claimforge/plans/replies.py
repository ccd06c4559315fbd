"""Records from replies about orders, and their obstacles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.operators import extraction as X
from claimforge.plans.registry import register
from claimforge.session import table

_STATES = ("TX", "OH", "VA", "AZ", "GA", "IA", "OR", "NV", "UT", "WI", "IN", "LA", "MS", "AL", "TN", "KY", "NC", "SC", "PA", "NY", "NJ", "IL", "MI", "MN", "WA")


def replies(spark, d):
    """An article a paragraph long on every order, and a model's reply on it: in a fence, bare, or no JSON at all."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mw, usd = F.floor(F.col("o_totalprice") / 1000), F.col("o_custkey") * 10
    first = F.concat(F.col("c_name"), F.lit(" plans a "), mw, F.lit(" MW campus\nin  Harbor."))
    cost, begun = F.concat(F.lit("It will cost $"), usd, F.lit(" million.")), F.lit("Construction has begun, and residents have sued over its noise.")
    article = F.concat_ws(" ", first, cost, begun)
    kind = F.substring("o_orderpriority", 1, 1)
    entry = lambda field, quote: F.struct(F.lit(field).alias("field"), quote.alias("quote"))
    on_mw = F.when(kind == "1", entry("mw_planned", F.concat(F.lit("plans a "), mw, F.lit(" mw campus in harbor")))).when(kind == "2", entry("name", F.concat(mw, F.lit(" MW campus")))).when(
        kind == "3", entry("mw_planned", F.lit("Construction has begun"))).when(kind == "4", entry("mw_planned", F.concat(F.lit("a gigantic "), mw + 1, F.lit(" MW park of dreams"))))
    evidence = F.when(kind != "5", F.array(on_mw, entry("investment_usd", F.concat(F.lit("It will cost $"), usd, F.lit(" million"))), entry("phase", F.lit("construction has begun"))))
    risk = lambda category, quote: F.struct(F.lit(category).alias("category"), F.lit("They object.").alias("summary"), quote.alias("quote"), F.lit("grave").alias("severity"), F.lit(-3).alias("delay_days"))
    risks = F.array(risk("community_opposition", F.when(kind != "5", F.lit("residents have sued"))), risk("water", F.lit("residents have sued")), risk("water", F.lit("again")), risk("weather", F.lit("rain")))
    project = F.struct(
        F.when(kind == "5", "Harbor County").otherwise("Harbor").alias("city"), F.col("c_name").alias("company"), F.element_at(F.array(*map(F.lit, _STATES)), F.col("c_nationkey") + 1).alias("state"),
        F.when(kind == "1", F.concat(mw, F.lit(" MW"))).otherwise(mw.cast("string")).alias("mw_planned"), F.concat(F.lit("about $"), usd, F.lit(" million")).alias("investment_usd"),
        F.lit("under construction").alias("phase"), F.lit("Q3 2027").alias("expected_online"), evidence.alias("evidence"), risks.alias("risks"))
    body = F.to_json(F.struct(F.array(project).alias("projects")))
    reply = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("o_orderstatus") == "F", body).otherwise("I found no project.")
    # a row is small and dear: tasks by number, as tasks by size would be few
    o = o.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "o_orderkey")
    return o.select(F.concat(F.lit("https://news.example/"), "o_orderkey").alias("url"), reply.alias("reply"), article.alias("article"))


_REPLY = """x AS (
  SELECT 'https://news.example/' || o_orderkey AS url, c_name AS company, ([""" + ", ".join(f"'{s}'" for s in _STATES) + """])[c_nationkey + 1] AS state, substr(o_orderpriority, 1, 1) AS kind,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS mw, o_custkey * 10 * 1000000 AS usd
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
), y AS (SELECT *, mw > 0 AND usd > 0 AND usd / mw > 50000000 AS huge FROM x)"""


@register(f"""WITH {_REPLY} SELECT url, company || CASE kind WHEN '5' THEN ' Harbor County' ELSE ' Harbor' END AS name, company, state, CASE kind WHEN '5' THEN '' ELSE 'Harbor' END AS city, CASE kind WHEN '5' THEN 'Harbor County' ELSE '' END AS county,
 CAST(mw AS DOUBLE) AS mw_planned, usd AS investment_usd, 'construction' AS phase,
 concat_ws(',', 'expected_online:no_quote', CASE WHEN huge THEN 'investment_usd:out_of_scale' WHEN kind = '5' THEN 'investment_usd:no_quote' END,
  CASE kind WHEN '3' THEN 'mw_planned:quote_off_target' WHEN '4' THEN 'mw_planned:quote_unverified' WHEN '5' THEN 'mw_planned:no_quote' END, CASE WHEN kind = '5' THEN 'phase:no_quote' END) AS reasons,
 concat_ws('; ', 'investment_usd: approximate', 'expected_online: to the quarter', CASE WHEN huge THEN 'investment_usd: $' || CAST(floor(usd / mw / 1000000) AS BIGINT) || 'M per MW' END) AS notes FROM y""")
def reply_records(spark, d):
    """Typed records of replies: every value, and for those that no quote of the article states the reason."""
    found = X.records(X.parsed(replies(spark, d)))
    reasons = F.array_join(F.array_sort(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return found.select("url", "name", "company", "state", *[F.coalesce(c, F.lit("")).alias(c) for c in ("city", "county")], "mw_planned", "investment_usd", "phase", reasons.alias("reasons"), F.array_join("notes", "; ").alias("notes"))


@register(f"""WITH {_REPLY} SELECT url, category, 'watch' AS severity, CASE WHEN category = 'water' OR kind = '5' THEN '' ELSE 'residents have sued' END AS quote,
 CASE WHEN category = 'water' THEN 'quote_off_target' WHEN kind = '5' THEN 'no_quote' ELSE '' END AS unconfirmed FROM y, (VALUES ('community_opposition'), ('water')) AS v(category)""")
def reply_obstacles(spark, d):
    """Obstacles of replies: kept without their quote where it isn't in the article or speaks of another kind."""
    found = X.obstacles(X.parsed(replies(spark, d)))
    return found.select("url", "category", "severity", *[F.coalesce(c, F.lit("")).alias(c) for c in ("quote", "unconfirmed")])


@register("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'at_least' WHEN '2' THEN 'approximate' WHEN '3' THEN 'at_most' ELSE 'exact' END AS bound FROM orders WHERE o_totalprice >= 1000""")
def value_bounds(spark, d):
    """Bounds that sentences put on a capacity, each of their two figures having its own hedge."""
    from claimforge.operators.positions import bound

    mw = F.floor(F.col("o_totalprice") / 1000)
    kind = F.substring("o_orderpriority", 1, 1)
    hedge = F.when(kind == "1", "more than approximately ").when(kind == "2", "close to ").when(kind == "3", "as much as ").when(kind == "4", "").otherwise("more than a decade ago it was said that the site would have ")
    number = F.when(F.col("o_orderstatus") == "O", F.format_number(mw * 1000, 0)).otherwise(mw.cast("string"))
    quote = F.concat(F.lit("Over many homes and farms a very long way from there, "), hedge, number, F.when(F.col("o_orderstatus") == "O", " MW").otherwise(" GW"), F.lit(" will come, at most once"))
    return table(spark, d, "orders").where("o_totalprice >= 1000").select("o_orderkey", bound(quote, (mw * 1000).cast("double")).alias("bound"))
