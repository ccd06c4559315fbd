"""Texts, normalisers, readers and incremental plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import dates, numbers, text
from claimforge.operators.reports import top_by
from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources import readers, sinks
from claimforge.sources.adapters import PAGE, pages, projects, risks
from claimforge.streaming import incremental


@register("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 900 AS DOUBLE) WHEN 1 THEN (o_orderkey % 900) * 1000.0 WHEN 2 THEN CAST(o_orderkey % 900 AS DOUBLE) ELSE NULL END AS mw,
 CASE o_orderkey % 4 WHEN 1 THEN 'approximate' WHEN 2 THEN 'range' END AS note FROM orders""")
def norm_mw(spark, d):
    n = (F.col("o_orderkey") % 900).cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(n, F.lit(" MW"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("about "), n, F.lit(" GW"))).when(
        F.col("o_orderkey") % 4 == 2, F.concat(n, F.lit("-1,000 MW"))).otherwise("TBD")
    return table(spark, d, "orders").withColumn("p", numbers.norm_mw(raw)).select("o_orderkey", F.col("p.value").alias("mw"), F.col("p.note").alias("note"))


@register("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 50) * 1000000000 WHEN 1 THEN (o_orderkey % 50) * 1000000 WHEN 2 THEN o_orderkey % 50 * 1000000 ELSE NULL END AS BIGINT) AS usd FROM orders""")
def norm_money(spark, d):
    n = (F.col("o_orderkey") % 50).cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$"), n, F.lit(" billion"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("US$ "), n, F.lit("M"))).when(
        F.col("o_orderkey") % 4 == 2, F.concat(F.lit("up to $"), n, F.lit(" to 60 million dollars"))).otherwise("undisclosed")
    return table(spark, d, "orders").select("o_orderkey", numbers.norm_money(raw).value.alias("usd"))


@register("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN make_date(CAST(year(o_orderdate) AS INT), 3 * CAST(quarter(o_orderdate) AS INT) - 2, 1)
 WHEN 2 THEN make_date(CAST(year(o_orderdate) AS INT), 10, 1) WHEN 3 THEN make_date(CAST(year(o_orderdate) AS INT), 1, 1) WHEN 4 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS day,
 CASE o_orderkey % 6 WHEN 0 THEN 'day' WHEN 1 THEN 'quarter' WHEN 2 THEN 'quarter' WHEN 3 THEN 'year' WHEN 4 THEN 'month' END AS precision FROM orders""")
def norm_date(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.date_format(t, "MMMM d, yyyy")).when(k == 1, F.concat(F.lit("Q"), F.quarter(t), F.lit(" "), F.year(t)))
        .when(k == 2, F.concat(F.lit("late "), F.year(t))).when(k == 3, F.year(t).cast("string")).when(k == 4, F.date_format(t, "yyyy-MM")).otherwise("next spring")
    )
    return table(spark, d, "orders").withColumn("p", dates.norm_date(raw)).select("o_orderkey", F.col("p.value").alias("day"), F.col("p.precision").alias("precision"))


@register("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'announced' WHEN 1 THEN 'construction' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'operational' END AS phase FROM orders""")
def norm_phase(spark, d):
    words = F.array(*map(F.lit, ["Proposed", "now under construction there", "plans withdrawn", "In  service", "nothing known"]))
    return table(spark, d, "orders").select("o_orderkey", text.norm_phase(F.element_at(words, (F.col("o_orderkey") % 5).cast("int") + 1)).alias("phase"))


_TIERS = {"exclude": ["scum"], "topic": ["the", "der", "la"], "signal": ["ered", "onhe"], "risk": ["idiot", "moron"]}
_HAY = r"(' ' || trim(regexp_replace(lower(text), '[^a-z0-9$]+', ' ', 'g')) || ' ')"


def _has(words):
    return "(" + " OR ".join(f"contains(hay, ' {w} ')" for w in words) + ")"


def _first(words):
    return "CASE " + " ".join(f"WHEN contains(hay, ' {w} ') THEN '{w}'" for w in words) + " END"


@register(f"""WITH h AS (SELECT doc_id, {_HAY} AS hay FROM documents)
SELECT doc_id, NOT {_has(_TIERS['exclude'])} AND {_has(_TIERS['topic'])} AND ({_has(_TIERS['signal'])} OR {_has(_TIERS['risk'])}) AS keep,
 CASE WHEN {_has(_TIERS['exclude'])} THEN 'excluded: ' || {_first(_TIERS['exclude'])} WHEN NOT {_has(_TIERS['topic'])} THEN 'no topic' WHEN {_has(_TIERS['signal'])} THEN 'signal: ' || {_first(_TIERS['signal'])}
 WHEN {_has(_TIERS['risk'])} THEN 'risk: ' || {_first(_TIERS['risk'])} ELSE 'no signal' END AS reason FROM h""")
def keyword_filter(spark, d):
    return table(spark, d, "documents").withColumn("p", text.keyword_filter(F.col("text"), **_TIERS)).select("doc_id", "p.keep", "p.reason")


@register("""SELECT p.doc_id, b.item_id FROM documents p JOIN benchmark b ON contains(trim(regexp_replace(lower(p.text), '[ \\t\\n\\r]+', ' ', 'g')), trim(regexp_replace(lower(b.text), '[ \\t\\n\\r]+', ' ', 'g')))""".replace("\\\\", "\\"))
def quote_verbatim(spark, d):
    """Documents that hold a passage verbatim, white space and case aside.

    The inner words of a passage are whole in any text that holds it: hashes of up to four of them find candidates
    by equality, and only those are compared.  A passage of one or two words has none, and is looked for in all texts.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " "))
    docs = table(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("folded"))
    quotes = table(spark, d, "benchmark").select("item_id", fold(F.col("text")).alias("quote"))
    words = F.split("quote", " ")
    width = F.least(F.lit(4), F.size(words) - 2)
    quotes = quotes.select("item_id", "quote", width.alias("width"), F.when(width > 0, F.xxhash64(F.slice(words, F.lit(2), width))).alias("key"))
    widths = [r.width for r in quotes.where("width > 0").select("width").distinct().collect()]  # 1 to 4

    def grams(width: int):
        all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1))), lambda i: F.xxhash64(F.slice("words", i, width)))
        return F.when(F.size("words") >= width, all_of).otherwise(F.array().cast("array<long>"))

    keys = quotes.where("width > 0").select("item_id", "key")
    split = docs.select("doc_id", F.split("folded", " ").alias("words"))  # a column, as a lambda would split the text again for each word
    hashed = split.select("doc_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<long>"), *map(grams, widths)))).alias("key"))
    hits = hashed.join(keys, "key").select("doc_id", "item_id").distinct()
    found = hits.join(docs, "doc_id").join(quotes.select("item_id", "quote"), "item_id").where(F.contains("folded", F.col("quote"))).select("doc_id", "item_id")
    short = quotes.where("width <= 0").select("item_id", "quote")
    if short.limit(1).count():
        found = found.union(docs.join(short, F.contains(F.col("folded"), F.col("quote"))).select("doc_id", "item_id"))
    return found


@register("""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 342) || chr(10) || '[...]' || chr(10) || right(text, 151) END AS cut FROM documents""".replace("342", "345").replace("151", "148"))
def truncate_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_head_tail(F.col("text"), 500).alias("cut"))


@register("""SELECT doc_id, CAST(coalesce(list_sum(list_filter(list_transform(string_split(text, chr(10)), lambda x: length(trim(x, ' '))), lambda n: n >= 60)), 0) AS BIGINT) AS prose FROM documents""")
def prose_length(spark, d):
    return table(spark, d, "documents").select("doc_id", text.prose_length(F.col("text")).alias("prose"))


@register(r"""WITH n AS (SELECT doc_id, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters, length(regexp_replace(text, '[^一-鿿぀-ヿ가-힯]', '', 'g')) AS foreign_ FROM documents)
SELECT doc_id, letters = 0 OR 10 * foreign_ <= letters AS english FROM n""")
def looks_english(spark, d):
    return table(spark, d, "documents").select("doc_id", text.looks_english(F.col("text")).alias("english"))


_TERMS = {"the": 1.0, "ered": 4.0, "onhe": 2.5}


@register(r"""WITH w AS (SELECT doc_id, length(text) AS n, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g'), ' ') AS words FROM documents), c AS (SELECT doc_id, n, len(list_filter(words, lambda x: x = 'the')) AS a, len(list_filter(words, lambda x: x = 'ered')) AS b, len(list_filter(words, lambda x: x = 'onhe')) AS c FROM w)
SELECT doc_id, round((CASE WHEN a > 0 THEN 1.0 * (1 + 0.3 * (a - 1)) ELSE 0 END + CASE WHEN b > 0 THEN 4.0 * (1 + 0.3 * (b - 1)) ELSE 0 END + CASE WHEN c > 0 THEN 2.5 * (1 + 0.3 * (c - 1)) ELSE 0 END) / greatest(1.0, n / 800.0), 4)::DOUBLE AS score FROM c""")
def paragraph_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.score_paragraph(F.col("text"), _TERMS), 4).alias("score"))


_CHROME = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "noscript", "nav", "footer", "header", "aside", "form"):
    _CHROME = f"regexp_replace({_CHROME}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"


@register(rf"""WITH a AS (SELECT page_id, {_CHROME} AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|section|article)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*', chr(10), 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS text FROM c""".replace("\\\\", "\\"))
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@register("""SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c_nationkey * 2.0 - 10) / 2), 2) + cos(radians(10.0)) * cos(radians(c_nationkey * 2.0)) * pow(sin(radians((c_custkey % 90) * 1.0) / 2), 2)))), 3) AS km FROM customer""")
def haversine(spark, d):
    lat, lon = F.col("c_nationkey") * F.lit(2.0), (F.col("c_custkey") % 90) * F.lit(1.0)
    return table(spark, d, "customer").select("c_custkey", F.round(numbers.km_apart(F.lit(10.0), F.lit(0.0), lat, lon), 3).alias("km"))


@register("""WITH s AS (SELECT o_orderkey, o_totalprice * 1000 / 1.3 AS n, pow(10.0, floor(log10(o_totalprice * 1000 / 1.3)) - 1) AS step FROM orders) SELECT o_orderkey, CAST(round_even(n / step, 0) * step AS BIGINT) AS chips FROM s""")
def h200_equivalent(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.h200_equivalent(F.col("o_totalprice")).alias("chips"))


@register("SELECT doc_id, sha256(text) AS content, substr(sha256(text), 1, 12) AS tag FROM documents")
def record_tags(spark, d):
    digest = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("content"), F.substring(digest, 1, 12).alias("tag"))


# readers
@register("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS capacity FROM orders""")
def queue_column_map(spark, d):
    """The first candidate column that isn't blank."""
    raw = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("Project ID"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("TBD").alias("MW Capacity"), F.col("o_orderstatus").alias("MW Energy"))
    mapped = readers.map_columns(raw, {"id": ["project id"], "capacity": ["MW Capacity", "MW Energy", "MFO"]}, required=("id",))
    return mapped.select(F.col("id").cast("long").alias("id"), "capacity")


@register("""SELECT CASE WHEN o_totalprice < 1000 AND o_orderstatus = 'P' THEN 'price,status' WHEN o_totalprice < 1000 THEN 'price' WHEN o_orderstatus = 'P' THEN 'status' ELSE 'ok' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def reject_split(spark, d):
    good, bad = readers.split_rejects(table(spark, d, "orders"), {"price": F.col("o_totalprice") >= 1000, "status": F.col("o_orderstatus") != "P"})
    rows = good.select(F.lit("ok").alias("reason")).union(bad.select(F.concat_ws(",", "reasons").alias("reason")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@register(r"""SELECT page_id, trim(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([^/]+?)(?:\.[a-z]+)?/?$', 1), '[-_]+', ' ', 'g')) AS title FROM pages""")
def slug_titles(spark, d):
    return table(spark, d, "pages").select("page_id", readers.slug_title(F.col("url")).alias("title"))


@register("SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM nation")
def place_keys(spark, d):
    x = table(spark, d, "nation").withColumn("place", F.concat("n_name", F.lit(" County (old)")))
    return readers.load_places(x, "place", "n_nationkey").select("n_nationkey", "key")


@register(f"""WITH {PAGE}, c AS (SELECT url, page_id AS seen FROM page UNION ALL SELECT url, page_id + 1000000 FROM page WHERE page_id % 2 = 0) SELECT url, min(seen) AS seen_at FROM c WHERE url NOT IN (SELECT url FROM page WHERE page_id % 5 = 0) GROUP BY url""")
def first_seen_dedup(spark, d):
    p = pages(spark, d)
    c = p.select("url", F.col("page_id").alias("seen_at")).union(p.where("page_id % 2 = 0").select("url", F.col("page_id") + 1000000))
    return incremental.new_urls(c, p.where("page_id % 5 = 0"))


@register("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'kept' WHEN b.v IS NULL OR a.v = b.v THEN 'unchanged' ELSE 'update' END AS action
 FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k) GROUP BY action""")
def upsert_actions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    incoming = o.where("k % 2 = 0").select("k", F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 7 == 0, "X").otherwise(F.col("v")).alias("v"))
    return incremental.upsert(o.where("k % 3 <> 0"), incoming, "k").groupBy("action").agg(F.count("*").alias("n"))


@register("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def daily_digest_window(spark, d):
    return incremental.daily_digest(table(spark, d, "events"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, CAST(min(ts) AS DATE) AS day, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    return incremental.sessions(table(spark, d, "events")).select("user_id", F.to_date("start").alias("day"), "n")


@register("""SELECT o_orderkey AS id, count(l_orderkey) AS risks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'O' GROUP BY o_orderkey""")
def json_nested_export(spark, d):
    """Nested documents, read back for the count of their children."""
    docs = sinks.nested(projects(spark, d), {"risks": risks(spark, d).where("status = 'open'").select("project_id", "risk_id", "category", "severity")})
    parsed = F.from_json("document", "risks array<struct<risk_id string>>")
    return docs.select("id", F.coalesce(F.size(parsed.risks), F.lit(0)).alias("n")).select("id", F.greatest(F.lit(0), "n").cast("long").alias("risks"))


@register("SELECT conv_id, role AS last_role, turn AS turns FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_state(spark, d):
    return top_by(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", F.col("role").alias("last_role"), F.col("turn").alias("turns"))
