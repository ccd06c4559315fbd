"""What the streaming operators give over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources import sitemaps
from claimforge.streaming import queue, timers


@register("""WITH s AS (SELECT o_custkey AS project_id, o_orderdate AS learned, max(CAST(l_shipdate AS DATE)) AS expected FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, lag(expected) OVER w AS previous, lag(learned) OVER w AS was FROM s WINDOW w AS (PARTITION BY project_id ORDER BY learned)),
e AS (SELECT project_id, expected AS event_date, arg_max(previous, learned) AS previous FROM m WHERE expected > previous AND date_diff('microsecond', was, learned) <= 730 * 86400000000 GROUP BY ALL)
SELECT project_id, event_date, CASE WHEN year(event_date) > year(previous) THEN CAST(event_date - previous AS INTEGER) END AS delay_days,
 'expected_online moved from ' || previous || ' to ' || event_date || CASE WHEN year(event_date) > year(previous) THEN ' (+' || CAST(event_date - previous AS INTEGER) || ' days)'
 ELSE ' within ' || year(previous) || '; this may be a more precise restatement rather than a delay' END AS description FROM e""")
def delay_events(spark, d):
    """Moves of a customer's latest ship date from one order to the next, one event a new date."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("expected"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("learned"))
    said = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return timers.delay_events(timers.date_moves(said)).select("project_id", "event_date", "delay_days", "description")


_STATUS = "CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'error' THEN 'fetch_error' WHEN 'view' THEN 'no_project' WHEN 'click' THEN 'thin_content' ELSE 'ok' END"


@register(f"""WITH r AS (SELECT 'https://site.example/' || user_id AS url, {_STATUS} AS status, ts AS t, CAST(event_id AS VARCHAR) AS run_id FROM events),
o AS (SELECT url, arg_max(status, row(t, status, run_id)) AS status, count(*) AS attempts, max(t) AS tried FROM r WHERE status <> 'discovered' GROUP BY url),
f AS (SELECT url, min(t) AS seen, arg_min(CASE WHEN status = 'discovered' THEN 'found by ' || run_id ELSE '' END, row(t, status <> 'discovered', status, run_id)) AS found FROM r GROUP BY url)
SELECT url, coalesce(o.status, 'discovered') AS status, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, nullif(found, '') AS title,
 CAST(epoch_us(seen) AS BIGINT) AS first_seen_us, CAST(epoch_us(coalesce(tried, seen)) AS BIGINT) AS last_tried_us FROM f LEFT JOIN o USING (url)""")
def queue_states(spark, d):
    """A queue after two batches, cut at an instant: the same as of all rows at once."""
    rows = table(spark, d, "events").select(
        F.concat(F.lit("https://site.example/"), F.col("user_id").cast("string")).alias("url"), F.expr(_STATUS).alias("status"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").cast("string").alias("run_id"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("long").alias("attempts"), F.lit(None).cast("string").alias("error"),
        F.lit("feed").alias("feed"), F.lit(None).cast("timestamp").alias("published_at"))
    rows = rows.withColumn("title", F.when(F.col("status") == queue.PENDING, F.concat(F.lit("found by "), F.col("run_id"))))
    early = F.col("at") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    first = queue.advance(spark.createDataFrame([], queue.STATE), rows.where(early))
    state = queue.applied(first, queue.advance(first, rows.where(~early)))
    return state.select("url", "status", "attempts", "title", F.unix_micros("first_seen_at").alias("first_seen_us"), F.unix_micros("last_tried_at").alias("last_tried_us"))


@register("""WITH p AS (SELECT page_id, url, page_id // 50 AS child, page_id // 500 AS root FROM pages WHERE url IS NOT NULL), c AS (SELECT DISTINCT root, child, child % 3 <> 0 AS article FROM p),
k AS (SELECT root, child FROM c WHERE article OR root NOT IN (SELECT root FROM c WHERE article) QUALIFY row_number() OVER (PARTITION BY root ORDER BY child DESC) <= 4)
SELECT DISTINCT 'site ' || root AS name, CASE WHEN child % 3 <> 0 THEN 'https://s.example/news-' ELSE 'https://s.example/company-' END || child AS via, url FROM p JOIN k USING (root, child)""")
def sitemap_walk(spark, d):
    """Sitemaps of the pages, 50 a child and ten children an index, walked from their indices; the newest four children of each count."""
    p = table(spark, d, "pages").where("url is not null").select("page_id", "url", F.expr("page_id div 50").alias("child"), F.expr("page_id div 500").alias("root"))
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    via = F.concat(F.when(F.col("child") % 3 != 0, "https://s.example/news-").otherwise("https://s.example/company-"), F.col("child").cast("string"))
    listed = p.groupBy("root", "child").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")))).alias("body")).withColumn("via", via)
    children = listed.select(F.col("via").alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))
    root = F.concat(F.lit("https://s.example/index-"), F.col("root").cast("string"))
    line = F.concat(F.lit("<sitemap><loc>"), "via", F.lit("</loc><lastmod>"), F.expr("date_add(date'2000-01-01', int(child))").cast("string"), F.lit("</lastmod></sitemap>"))
    indices = listed.groupBy("root").agg(F.concat_ws("", F.collect_list(line)).alias("body")).select(root.alias("url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("xml"))
    roots = p.select(F.concat(F.lit("site "), F.col("root").cast("string")).alias("name"), root.alias("url")).distinct()
    return sitemaps.walk(roots, children.unionByName(indices))[0].select("name", "via", "url").distinct()
