"""Codes, queues, duplicates, merges and exports of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import codes
from claimforge.operators.progress import standing
from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources.adapters import CLAIM, PAGE, PROJECT, RISK, claims, pages, projects, risks

_NAMES = ["Texas", "new  york", "va", "Washington D.C.", "Atlantis", "TBD"]


@register("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'TX' WHEN 1 THEN 'NY' WHEN 2 THEN 'VA' END AS state,
 CASE o_orderkey % 6 WHEN 3 THEN 'state: can''t read ''Washington D.C.''' WHEN 4 THEN 'state: can''t read ''Atlantis''' END AS warning FROM orders""")
def norm_states(spark, d):
    raw = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % 6).cast("int") + 1)
    p = codes.soft(raw, codes.norm_state(raw), "state")
    return table(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.value").alias("state"), "p.warning")


@register("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'DE' END AS country FROM nation""")
def norm_countries(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["U.S.A.", "canada", "de", "elsewhere", ""])), F.col("n_regionkey").cast("int") + 1)
    return table(spark, d, "nation").select("n_nationkey", codes.norm_country(raw).alias("country"))


@register("""SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'household' WHEN 'MACHINERY' THEN 'machinery' END AS choice FROM customer""")
def norm_choices(spark, d):
    return table(spark, d, "customer").select("c_custkey", codes.norm_choice(F.col("c_mktsegment"), ["household", "machinery", "other_kind"]).alias("choice"))


@register("""SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN url END AS url FROM pages""")
def norm_urls(spark, d):
    k = F.col("page_id") % 3
    raw = F.when(k == 1, F.concat(F.lit("ftp:"), "url")).when(k == 2, F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", codes.norm_url(raw).alias("url"))


_TYPED = r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id % 6 AS k FROM pages)"""


@register(_TYPED + """ SELECT page_id, CASE WHEN k IN (0, 1) THEN 'company_filing' WHEN k = 2 THEN 'government_doc' WHEN k = 3 THEN 'trade_press' ELSE 'general_media' END AS kind FROM h""")
def source_types(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(.*)$", 1)
    hosts = F.array(*map(F.lit, ["www.sec.gov", "news.operator.com", "x.state.va.us", "www.heatmap.com:443"]))
    host = F.coalesce(F.try_element_at(hosts, (F.col("page_id") % 6).cast("int") + 1), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return table(spark, d, "pages").select("page_id", codes.source_type(F.concat(F.lit("https://user@"), host, path), ["operator.com"]).alias("kind"))


@register("""SELECT p_partkey, p_type IN ('PROMO', 'STANDARD') OR p_size % 7 = 0 AS generation FROM part""")
def generation_labels(spark, d):
    label = F.when(F.col("p_type") == "PROMO", "Solar (Farm)").when(F.col("p_type") == "STANDARD", "Unit 1, gas turbine.").otherwise(F.concat(F.lit("Hall "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", codes.is_generation(label, F.when(F.col("p_size") % 7 == 0, "West Power PLANT")).alias("generation"))


@register("""SELECT c_custkey, list_sort(list_distinct(list_filter(list_transform(string_split(c_mktsegment || ', ' || lower(c_mktsegment) || ',,' || c_mktsegment, ','), lambda x: trim(x)), lambda x: x <> ''))) AS names,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINERY' ELSE '' END AS cell FROM customer""")
def name_lists(spark, d):
    names = codes.names_in(F.concat("c_mktsegment", F.lit(", "), F.lower("c_mktsegment"), F.lit(",,"), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_sort(names).alias("names"), codes.canonical_list(names, ["BUILDING", "MACHINERY"]).alias("cell"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS reason, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'F quoted' ELSE 'excerpt' END AS quote,
 o_orderkey % 3 = 0 AND o_orderstatus = 'F' AS exact FROM orders""")
def reasons_and_quotes(spark, d):
    notes = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.create_map(F.lit("mw"), F.col("o_orderpriority"), F.lit("usd"), F.lit("other")))).when(F.col("o_orderkey") % 3 == 1, "{broken")
    quotes = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.create_map(F.lit("mw"), F.when(F.col("o_orderstatus") == "F", "F quoted").otherwise(" "))))
    q = codes.quote_of(quotes, F.lit("mw"), F.lit("excerpt"))
    return table(spark, d, "orders").select("o_orderkey", codes.reason_of(notes, F.lit("mw")).alias("reason"), q.alias("q")).select("o_orderkey", "reason", "q.quote", "q.exact")


@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE l_quantity * 1000 END AS stated,
 coalesce(CASE WHEN l_linenumber % 3 = 1 THEN l_quantity WHEN l_linenumber % 3 = 2 THEN l_quantity * 1000 END > 3 * l_quantity, false) AS out_of_scale FROM lineitem""")
def label_capacity(spark, d):
    """What a tranche's label states, against its own figure."""
    n = F.col("l_quantity").cast("int").cast("string")
    label = F.when(F.col("l_linenumber") % 3 == 0, "Phase 2").when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Hall A ("), n, F.lit(" MW)"))).otherwise(F.concat(n, F.lit("GW campus")))
    x = table(spark, d, "lineitem").withColumn("stated", codes.label_megawatts(label))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "stated", F.coalesce(F.col("stated") > 3 * F.col("l_quantity"), F.lit(False)).alias("out_of_scale"))


@register("""SELECT doc_id, text AS mended FROM documents""")
def demojibake(spark, d):
    """Texts that were read as Windows-1252 come back; the damage is done by the decoder, so undoing it gives the text."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def damage(texts):
        def once(t):
            try:
                return None if t is None else t.encode("utf-8").decode("cp1252")
            except UnicodeError:
                return t

        return texts.map(once)

    return table(spark, d, "documents").select("doc_id", codes.demojibake(damage(F.col("text"))).alias("mended"))


# filters and queues
@register(f"""WITH {PAGE} SELECT page_id, CASE WHEN status IN ('failed', 'pending') AND page_id % 4 <> 3 THEN 'queued' WHEN status IN ('failed', 'pending') THEN 'too old' ELSE 'done' END AS outcome FROM page""")
def refiltered_queue(spark, d):
    """The queue's filter applied again: what was read stays, what waits is held against the cut-off."""
    age = F.col("page_id") % 4
    return pages(spark, d).select("page_id", F.when(~F.col("status").isin("failed", "pending"), "done").when(age == 3, "too old").otherwise("queued").alias("outcome"))


@register(r"""SELECT page_id FROM pages WHERE page_id >= 20 AND regexp_matches(lower(regexp_replace(url, '^[a-z]+://[^/?#]+', '')), '/(en|de)/')""")
def candidates_since(spark, d):
    """Newer pages whose path names a topic; the host says nothing."""
    path = F.lower(F.coalesce(F.parse_url(F.col("url"), F.lit("PATH")), F.lit("")))
    return table(spark, d, "pages").where("page_id >= 20").where(path.contains("/en/") | path.contains("/de/")).select("page_id")


@register(f"""WITH {PAGE} SELECT page_id, url FROM page WHERE status = 'failed' ORDER BY size, page_id LIMIT 30""")
def failed_oldest(spark, d):
    return pages(spark, d).where("status = 'failed'").orderBy("size", "page_id").limit(30).select("page_id", "url")


@register(f"""WITH {PAGE}, t AS (SELECT host, count(*) FILTER (size % 4 = 0) AS decisive FROM page GROUP BY host), k AS (SELECT DISTINCT host FROM page WHERE page_id % 13 = 0)
SELECT host, decisive FROM t WHERE decisive >= 1 AND host NOT IN (SELECT host FROM k) ORDER BY decisive DESC, host LIMIT 15""")
def feeds_to_probe(spark, d):
    """Publishers by decisive pages that aren't configured yet."""
    p = pages(spark, d)
    known = p.where("page_id % 13 = 0").select("host").distinct()
    found = p.groupBy("host").agg(F.count_if(F.col("size") % 4 == 0).alias("decisive")).where("decisive >= 1")
    return found.join(known, "host", "left_anti").orderBy(F.desc("decisive"), "host").limit(15)


@register("""WITH q AS (SELECT o_orderkey AS id, '"' || c_name || '" "' || n_name || '"' AS a, o_orderstatus AS st, o_orderpriority AS pr FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
u AS (SELECT id, 1 AS n, a || ' data center' AS q FROM q UNION ALL SELECT id, 2, a || ' megawatts' FROM q WHERE st <> 'F' UNION ALL SELECT id, 3, a || ' investment billion' FROM q WHERE pr = '1-URGENT' UNION ALL SELECT id, 4, a || ' cost' FROM q WHERE pr = '1-URGENT')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) AS INT) AS place, q AS query FROM u""")
def search_queries(spark, d):
    """Queries for a record's missing fields, anchored on its company and place; equal ones count once."""
    phrases = {"mw": ["megawatts"], "usd": ["investment billion", "cost", "investment billion"]}
    n = F.broadcast(table(spark, d, "nation"))
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    missing = {"mw": F.col("o_orderstatus") != "F", "usd": F.col("o_orderpriority") == "1-URGENT"}
    wanted = [F.when(missing[k], F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in phrases.items()]
    anchor = F.concat(F.lit('"'), "c_name", F.lit('" "'), "n_name", F.lit('" '))
    every = F.slice(F.array_distinct(F.flatten(F.array(F.array(F.lit("data center")), *wanted))), 1, 12)
    out = x.select(F.col("o_orderkey").alias("id"), anchor.alias("anchor"), F.posexplode(every).alias("k", "phrase"))
    return out.select("id", (F.col("k") + 1).alias("place"), F.concat("anchor", "phrase").alias("query"))


# joins on urls, names and keys
@register("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'source' END, CASE WHEN page_id IS NOT NULL THEN 'queue' END) AS dated_by FROM documents LEFT JOIN pages ON page_id = doc_id
UNION ALL SELECT page_id, 'queue' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)""")
def published_index(spark, d):
    """One date a page: what a source says overrides the queue's."""
    source = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "source").alias("s"))
    queue = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("queue").alias("q"))
    return source.join(queue, "doc_id", "full_outer").select("doc_id", F.coalesce("s", "q").alias("dated_by"))


@register("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem WHERE l_orderkey = o_orderkey)) AS day FROM orders""")
def late_facts(spark, d):
    """Dates that come later fill what is empty only."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("late"))
    o = table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")), F.col("late")).alias("day"))


@register("""SELECT o_orderkey AS id, (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey LIMIT 1) AS first_source FROM orders""")
def first_citation(spark, d):
    """The first source of a record: a minimum by order, combined before the shuffle; left out records stay."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("first_source"))
    return table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), "first_source")


@register("""WITH k AS (SELECT p_partkey, split_part(p_brand, '#', 2) || '|' || p_type AS key FROM part), n AS (SELECT s_suppkey, (s_suppkey % 25) || '|ECONOMY' AS key FROM supplier)
SELECT s_suppkey, min(p_partkey) AS found FROM n LEFT JOIN k ON k.key = n.key OR (k.key LIKE split_part(n.key, '|', 1) || '|%' AND k.key LIKE '%|' || split_part(n.key, '|', 2)) GROUP BY s_suppkey""")
def duplicate_candidate(spark, d):
    """The first record of the same parts of a key; parts are columns, so the search is a join by equality."""
    known = table(spark, d, "part").groupBy(F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("a"), F.col("p_type").alias("b")).agg(F.min("p_partkey").alias("found"))
    new = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).cast("string").alias("a"), F.lit("ECONOMY").alias("b"))
    return new.join(known, ["a", "b"], "left").select("s_suppkey", "found")


_URL_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"
_ROSTER = [("example org", 1), ("example net es", 2), ("en example com", 3), ("nowhere", 4)]


@register(f"""WITH w AS (SELECT page_id, {_URL_WORDS} AS words FROM pages), r(name, rid) AS (VALUES ('example org', 1), ('example net es', 2), ('en example com', 3), ('nowhere', 4))
SELECT page_id, rid FROM w JOIN r ON list_has_all(words, string_split(name, ' '))""")
def archive_leads(spark, d):
    """Pages whose address has every word of a roster name: names meet on their first word, then all words are checked."""
    roster = spark.createDataFrame([(n.split(), r) for n, r in _ROSTER], "name array<string>, rid int")
    p = table(spark, d, "pages").select("page_id", F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " ")), " ")).alias("words"))
    word = p.select("page_id", "words", F.explode("words").alias("word"))
    hits = word.join(F.broadcast(roster.withColumn("word", F.col("name")[0])), "word")
    return hits.where(F.size(F.array_except("name", "words")) == 0).select("page_id", "rid")


@register(r"""WITH u AS (SELECT page_id, page_id % 7 AS st, lower(regexp_extract(url, '/([a-z]+)/[0-9]+', 1)) AS lang FROM pages)
SELECT lang, st AS status, count(*) AS pages FROM u WHERE lang <> '' AND st IN (3, 4) GROUP BY ALL""")
def harvest_queue(spark, d):
    """Queue rows whose slug names a record, by status."""
    lang = F.lower(F.regexp_extract("url", r"/([a-z]+)/[0-9]+", 1))
    rows = table(spark, d, "pages").select(lang.alias("lang"), (F.col("page_id") % 7).alias("status"))
    return rows.where((F.col("lang") != "") & F.col("status").isin(3, 4)).groupBy("lang", "status").agg(F.count("*").alias("pages"))


# aggregates
@register(f"""WITH {PROJECT}, {RISK} SELECT category, count(*) AS projects, CAST(sum(CAST(round(mw * 100) AS BIGINT)) AS BIGINT) AS mw, CAST(sum(CASE WHEN severity = 'blocking' THEN CAST(round(mw * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS blocking,
 CAST(sum(CASE WHEN severity = 'material' THEN CAST(round(mw * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS material, CAST(sum(CASE WHEN severity = 'watch' THEN CAST(round(mw * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS watch
FROM risk JOIN project ON id = project_id WHERE status = 'open' GROUP BY category""")
def open_risk_capacity(spark, d):
    """Capacity behind each category, a term for every open risk row, by severity."""
    mw = F.round(F.col("mw") * 100).cast("long")
    rows = risks(spark, d).where("status = 'open'").join(projects(spark, d).select("id", "mw"), F.col("id") == F.col("project_id"))
    by = [F.sum(F.when(F.col("severity") == s, mw).otherwise(0)).alias(s) for s in ("blocking", "material", "watch")]
    return rows.groupBy("category").agg(F.count("*").alias("projects"), F.sum(mw).alias("mw"), *by)


@register("""SELECT max(ts) AS last_crawl, count(*) AS rows FROM events""")
def last_crawl(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("last_crawl"), F.count("*").alias("rows"))


@register("""SELECT count(*) FILTER (o_totalprice > 100000) + count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') + count(*) FILTER (o_orderstatus <> 'O') AS filled,
 2 * count(*) + count(*) FILTER (o_orderstatus <> 'O' OR o_totalprice > 100000) AS attemptable FROM orders""")
def report_score(spark, d):
    """Fields that are filled of those that may be; a field that is rightly empty isn't asked for."""
    filled = [F.col("o_totalprice") > 100000, F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderstatus") != "O"]
    asked = [F.lit(True), F.lit(True), filled[2] | filled[0]]
    return table(spark, d, "orders").agg(F.sum(sum((x.cast("long") for x in filled), F.lit(0))).alias("filled"), F.sum(sum((x.cast("long") for x in asked), F.lit(0))).alias("attemptable"))


@register(f"""WITH {PAGE} SELECT coalesce(feed, '(no feed)') AS feed, count(*) AS entries, count(*) FILTER (size % 3 = 0) AS would_queue, round(count(*) FILTER (size % 3 = 0) / count(*), 4) AS rate FROM page GROUP BY 1""")
def feed_probe_scores(spark, d):
    n, hits = F.count("*"), F.count_if(F.col("size") % 3 == 0)
    return pages(spark, d).groupBy(F.coalesce("feed", F.lit("(no feed)")).alias("feed")).agg(n.alias("entries"), hits.alias("would_queue"), F.round(hits / n, 4).alias("rate"))


@register("""SELECT o_custkey AS grp, o_orderkey AS kept FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '4-NOT SPECIFIED' DESC, o_totalprice DESC, o_orderkey) = 1""")
def group_representative(spark, d):
    """Of a group of duplicates the one with a tenant, then the largest, then the first: one combined maximum."""
    order = F.struct((F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("t"), "o_totalprice", (-F.col("o_orderkey")).alias("k"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.max_by("o_orderkey", order).alias("kept"))


@register("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey),
r AS (SELECT a, b, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb, (oa.o_orderstatus = 'F')::INT AS fa, (ob.o_orderstatus = 'F')::INT AS fb FROM p JOIN orders oa ON oa.o_orderkey = a JOIN orders ob ON ob.o_orderkey = b LEFT JOIN c x ON x.l_orderkey = a LEFT JOIN c y ON y.l_orderkey = b)
SELECT a, b, CASE WHEN nb > na OR (nb = na AND fb > fa) THEN b ELSE a END AS survivor FROM r""")
def merge_survivor(spark, d):
    """Of each duplicate pair the one of more citations, then more filled fields, then the lower id."""
    cited = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("o_orderstatus") == "F").alias("f"), (-F.col("o_orderkey")).alias("k"))
    a, b = (o.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias(s), rank.alias(f"r{s}")) for s in "ab")
    return a.join(b, ["o_custkey", "o_orderpriority"]).where("a < b").select("a", "b", F.when(F.col("ra") >= F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("survivor"))


@register(f"""WITH {CLAIM} SELECT project_id, CAST(l_linenumber AS INT) AS kind FROM claim QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, url) = 1""")
def best_source_type(spark, d):
    """The type of the first source of the greatest weight."""
    return claims(spark, d).groupBy("project_id").agg(F.min_by(F.col("l_linenumber").cast("int"), F.struct((-F.col("weight")).alias("w"), "url")).alias("kind"))


@register("""SELECT DISTINCT c_mktsegment AS company, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def states_of_companies(spark, d):
    n = F.broadcast(table(spark, d, "nation"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("company"), F.col("n_name").alias("state")).distinct()


@register("""WITH a AS (SELECT o_custkey AS x, o_orderkey AS y, 1 AS pass FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_totalprice > 200000)
SELECT x, y, min(pass) AS pass FROM a GROUP BY x, y""")
def two_duplicate_passes(spark, d):
    """Pairs of two passes; the second adds only what the first hasn't."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("y"), "o_orderstatus", "o_totalprice")
    first, second = o.where("o_orderstatus = 'F'").select("x", "y"), o.where("o_totalprice > 200000").select("x", "y")
    return first.withColumn("pass", F.lit(1)).union(second.join(first, ["x", "y"], "left_anti").withColumn("pass", F.lit(2)))


@register("""WITH g AS (SELECT s_nationkey % 5 AS grp, s_suppkey % 3 AS part, list_sort(list(DISTINCT s_suppkey % 4)) AS ids FROM supplier GROUP BY ALL)
SELECT a.grp, a.part FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.grp = a.grp AND b.part <> a.part AND list_has_all(b.ids, a.ids) AND (len(b.ids) > len(a.ids) OR (len(b.ids) = len(a.ids) AND b.part < a.part)))""")
def subsumed_groups(spark, d):
    """Groups that no other of their family holds whole; of equal ones the first stays. Pairs meet on a shared member and are counted."""
    m = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("grp"), (F.col("s_suppkey") % 3).alias("part"), (F.col("s_suppkey") % 4).alias("id")).distinct()
    size = m.groupBy("grp", "part").agg(F.count("*").alias("n"))
    a = m.join(size, ["grp", "part"])
    b = a.select("grp", "id", F.col("part").alias("other"), F.col("n").alias("size"))
    shared = a.join(b, ["grp", "id"]).where("part <> other").groupBy("grp", "part", "n", "other", "size").agg(F.count("*").alias("shared"))
    inside = shared.where("shared = n and (size > n or size = n and other < part)").select("grp", "part").distinct()
    return size.join(inside, ["grp", "part"], "left_anti").select("grp", "part")


# exports and hashes
@register(f"""WITH {PROJECT}, {RISK}, r AS (SELECT project_id, string_agg(category || ':' || severity, ';' ORDER BY category, first_seen, risk_id) AS cell FROM risk WHERE status = 'open' GROUP BY 1),
c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, company, phase, coalesce(cell, '') AS risks, coalesce(n, 0) AS sources FROM project LEFT JOIN r ON project_id = id LEFT JOIN c ON l_orderkey = id""")
def flat_rows(spark, d):
    """A flat row a record: open risks as ``category:severity`` in a stable order, and the number of sources."""
    cell = F.array_sort(F.collect_list(F.struct("category", "first_seen", "risk_id", "severity")))
    r = risks(spark, d).where("status = 'open'").groupBy("project_id").agg(F.concat_ws(";", F.transform(cell, lambda x: F.concat(x["category"], F.lit(":"), x["severity"]))).alias("risks"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("sources"))
    p = projects(spark, d).select("id", "company", "phase")
    x = p.join(r, p["id"] == r["project_id"], "left").join(n, p["id"] == n["key"], "left")
    return x.select("id", "company", "phase", F.coalesce("risks", F.lit("")).alias("risks"), F.coalesce("sources", F.lit(0)).alias("sources"))


@register("""WITH c AS (SELECT l_orderkey, string_agg(l_partkey || ':' || l_linestatus, '|' ORDER BY l_partkey || ':' || l_linestatus) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, substr(sha256(o_custkey || '|' || o_orderstatus || '|' || coalesce(lines, '')), 1, 16) AS fingerprint FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def record_fingerprint(spark, d):
    """A hash of a record's fields and of its children in a stable order."""
    line = F.concat("l_partkey", F.lit(":"), "l_linestatus")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("|", F.array_sort(F.collect_list(line))).alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    whole = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", F.coalesce("lines", F.lit("")))
    return o.select(F.col("o_orderkey").alias("id"), F.left(F.sha2(whole, 256), F.lit(16)).alias("fingerprint"))


@register("""SELECT o_orderkey AS id, CASE WHEN o_totalprice * 10000 >= 1e9 THEN '$' || printf('%.1f', o_totalprice * 10000 / 1e9) || 'B' ELSE '$' || printf('%.0f', o_totalprice * 10000 / 1e6) || 'M' END AS cost FROM orders""")
def formatted_dollars(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.replace(codes.dollars(F.col("o_totalprice") * 10000), F.lit(","), F.lit("")).alias("cost"))


@register(f"""WITH {CLAIM}, w AS (SELECT project_id, arg_max(value_num, ROW(confirmed, weight, fetched_at, url)) AS value FROM claim WHERE NOT decided_against GROUP BY 1)
SELECT o_orderkey AS id, CAST(l.n AS BIGINT) AS claims, NOT coalesce(l.hit, false) AS stored_unsupported FROM orders LEFT JOIN w ON project_id = o_orderkey LEFT JOIN (SELECT c.project_id, count(*) AS n, bool_or(c.value_num = round(o_totalprice / 10000)) AS hit FROM claim c JOIN orders ON o_orderkey = c.project_id GROUP BY 1) l ON l.project_id = o_orderkey""")
def stored_unsupported(spark, d):
    """Stored values that no claim states."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 10000).alias("stored"))
    hit = claims(spark, d).join(o, F.col("project_id") == F.col("id")).groupBy("project_id").agg(F.count("*").alias("claims"), F.bool_or(F.col("value_num") == F.col("stored")).alias("hit"))
    return o.join(hit, o["id"] == hit["project_id"], "left").select("id", "claims", (~F.coalesce("hit", F.lit(False))).alias("stored_unsupported"))


@register(f"""WITH {CLAIM}, x AS (SELECT *, CASE WHEN l_partkey % 6 = 0 AND confirmed THEN true ELSE decided_against END AS out FROM claim)
SELECT project_id, url AS winner FROM x WHERE NOT out QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY confirmed DESC, weight DESC, fetched_at DESC, url DESC) = 1""")
def superseded_winner(spark, d):
    """Decisions rule claims out before the ranking: they meet claims by url."""
    c = claims(spark, d)
    ruled = c.where("l_partkey % 6 = 0 and confirmed").select("project_id", "url").distinct().withColumn("ruled", F.lit(True))
    live = c.join(ruled, ["project_id", "url"], "left").where("ruled is null and not decided_against")
    return live.groupBy("project_id").agg(F.max_by("url", F.struct("confirmed", "weight", "fetched_at", "url")).alias("winner"))


@register("""SELECT event_type, count(*) AS read, count(*) FILTER (value > 100) AS matched, count(*) FILTER (value > 190) AS rejected,
 CASE WHEN count(*) FILTER (value > 100) = 0 THEN 'nothing matched' WHEN count(*) FILTER (value > 190) > 0.05 * count(*) FILTER (value > 100) THEN 'too many rejects' ELSE 'ok' END AS verdict FROM events GROUP BY event_type""")
def run_quality(spark, d):
    """Whether a run may stand: it matched something, and rejected a twentieth of that at most."""
    x = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("read"), F.count_if(F.col("value") > 100).alias("matched"), F.count_if(F.col("value") > 190).alias("rejected"))
    verdict = F.when(F.col("matched") == 0, "nothing matched").when(F.col("rejected") > 0.05 * F.col("matched"), "too many rejects").otherwise("ok")
    return x.withColumn("verdict", verdict)


@register("""WITH c AS (SELECT l_orderkey AS id, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_suppkey % 4 = 3) AS odd FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey AS id, max(m) AS most FROM (SELECT l_orderkey, l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS m FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_custkey % 5 = 0 THEN 'no locality' END, CASE WHEN coalesce(odd, 0) > 0 THEN 'dangling source' END, CASE WHEN coalesce(most, 0) > 1 THEN 'two risks of one kind and day' END], lambda x: x IS NOT NULL)) AS fault
FROM orders LEFT JOIN c ON c.id = o_orderkey LEFT JOIN k ON k.id = o_orderkey""")
def manual_record_faults(spark, d):
    """Faults of records that were typed in: a place is needed, children cite own sources, one risk of a kind and day."""
    line = table(spark, d, "lineitem")
    dangling = line.groupBy("l_orderkey").agg(F.bool_or(F.col("l_suppkey") % 4 == 3).alias("dangling"))
    twice = line.groupBy("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n")).groupBy(F.col("l_orderkey").alias("key")).agg((F.max("n") > 1).alias("twice"))
    o = table(spark, d, "orders").join(dangling, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(twice, F.col("o_orderkey") == F.col("key"), "left")
    faults = F.array_compact(F.array(F.when(F.col("o_custkey") % 5 == 0, "no locality"), F.when(F.col("dangling"), "dangling source"), F.when(F.col("twice"), "two risks of one kind and day")))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(faults).alias("fault"))


# progress and texts
@register("""WITH e AS (SELECT user_id AS id, CASE event_type WHEN 'signup' THEN 'announced' WHEN 'view' THEN 'permit_filed' WHEN 'click' THEN 'groundbreaking' WHEN 'purchase' THEN 'energized' ELSE 'first_customer' END AS m FROM events WHERE ts <= TIMESTAMP '2024-01-05'),
a AS (SELECT DISTINCT user_id AS id FROM events), f AS (SELECT a.id, coalesce(list(DISTINCT m) FILTER (m IS NOT NULL), []) AS ms FROM a LEFT JOIN e USING (id) GROUP BY a.id)
SELECT id AS project_id, 'power' AS track, CASE WHEN list_contains(ms, 'energized') THEN 2 ELSE 0 END AS rung, CASE WHEN list_contains(ms, 'energized') THEN NULL ELSE 'interconnection_agreement' END AS next_milestone FROM f
UNION ALL SELECT id, 'permits', CASE WHEN list_has_any(ms, ['groundbreaking', 'energized']) THEN 2 WHEN list_contains(ms, 'permit_filed') THEN 1 ELSE 0 END, CASE WHEN list_has_any(ms, ['groundbreaking', 'energized']) THEN NULL WHEN list_contains(ms, 'permit_filed') THEN 'permit_approved' ELSE 'permit_filed' END FROM f
UNION ALL SELECT id, 'site_control', CASE WHEN list_has_any(ms, ['groundbreaking', 'energized']) THEN 2 WHEN list_contains(ms, 'announced') THEN 1 ELSE 0 END, CASE WHEN list_has_any(ms, ['groundbreaking', 'energized']) THEN NULL WHEN list_contains(ms, 'announced') THEN 'land_acquired' ELSE 'announced' END FROM f
UNION ALL SELECT id, 'construction', CASE WHEN list_contains(ms, 'groundbreaking') THEN 2 ELSE 0 END, CASE WHEN list_contains(ms, 'groundbreaking') THEN 'equipment_install' ELSE 'site_work' END FROM f
UNION ALL SELECT id, 'commercial', CASE WHEN list_contains(ms, 'first_customer') THEN 1 ELSE 0 END, CASE WHEN list_contains(ms, 'first_customer') THEN NULL ELSE 'first_customer' END FROM f""")
def standings(spark, d):
    """How far each record is on each track as of a day, with what reached milestones imply."""
    kinds = F.create_map(*[F.lit(x) for pair in {"signup": "announced", "view": "permit_filed", "click": "groundbreaking", "purchase": "energized", "error": "first_customer"}.items() for x in pair])
    e = table(spark, d, "events").select(F.col("user_id").alias("project_id"), kinds[F.col("event_type")].alias("event_type"), F.when(F.col("ts") <= F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-05")).otherwise("2024-01-06").cast("date").alias("event_date"))
    none = spark.createDataFrame([], "project_id long, category string, severity string, status string")
    return standing(e, none, "2024-01-05").select("project_id", "track", "rung", "next_milestone")


@register(r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN true ELSE 10 * length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g')) <= length(regexp_replace(text, '[^\p{L}]', '', 'g')) END AS english
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, doc_id % 90) || repeat('数据', CAST(doc_id % 11 AS INT)) ELSE text END AS text FROM documents)""")
def cjk_share(spark, d):
    """Texts whose letters are hardly ever ideographs, kana or hangul; some documents get ideographs at their end."""
    from claimforge.functions.text import looks_english

    mixed = F.concat(F.substr("text", F.lit(1), (F.col("doc_id") % 90).cast("int")), F.repeat(F.lit("数据"), (F.col("doc_id") % 11).cast("int")))
    x = table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, mixed).otherwise(F.col("text")))
    return x.select("doc_id", looks_english(F.col("text")).alias("english"))


@register(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS words FROM documents)
SELECT doc_id, len(list_filter(words, lambda x: x IN ('the', 'of', 'ered', 'la'))) >= 0.1 * len(list_filter(words, lambda x: x <> '')) AND len(list_filter(words, lambda x: x <> '')) > 0 AS dense FROM w""")
def legalese_density(spark, d):
    """Texts a tenth of whose words are of a list."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    hits = F.size(F.filter(F.col("words"), lambda w: w.isin("the", "of", "ered", "la")))
    return table(spark, d, "documents").select("doc_id", words.alias("words")).select("doc_id", ((hits >= 0.1 * F.size("words")) & (F.size("words") > 0)).alias("dense"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount < 0.005 THEN 'no_quote' WHEN l_returnflag = 'R' THEN 'quote_unverified' WHEN l_tax > 0.055 THEN 'quote_off_target' ELSE 'confirmed' END AS verdict FROM lineitem""")
def evidence_gate(spark, d):
    """Claims by whether their quote is in the article and states the value."""
    from claimforge.operators.evidence import gate

    n = F.col("l_quantity").cast("int")
    article = F.concat(F.lit("The site of  "), n, F.lit(" MW\nis  planned. It was built in 2024. "), (n + 3), F.lit(" MW are "), F.lit("elsewhere."))
    quote = F.when(F.col("l_discount") < 0.005, "").when(F.col("l_returnflag") == "R", F.concat(F.lit("a site of "), n, F.lit(" megawatts"))).when(
        F.col("l_tax") > 0.055, F.concat((n + 3), F.lit(" MW are elsewhere"))).otherwise(F.concat(F.lit("the SITE of "), n, F.lit(" MW is planned")))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("mw").alias("field"), F.col("l_quantity").alias("value_num"), F.lit(None).cast("date").alias("value_date"),
                                           F.lit(None).cast("string").alias("value_str"), quote.alias("quote"), article.alias("article"))
    return gate(x).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "verdict")


@register("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'phase-' || (s_suppkey % 9 + 1) WHEN 1 THEN 'building-2' WHEN 2 THEN 'abilene.phase-' || (s_suppkey % 9 + 1) ELSE 'hall-b' END AS key FROM supplier""")
def block_key(spark, d):
    """Labels of tranches in any order and spelling to one key."""
    from pyspark.sql.types import StringType

    from claimforge.operators.tranches import block_key_of

    @F.pandas_udf(StringType())
    def key(labels, parents):
        return labels.combine(parents, block_key_of)

    k, n = F.col("s_suppkey") % 4, (F.col("s_suppkey") % 9 + 1).cast("string")
    label = F.when(k == 0, F.concat(F.lit("the Phase "), n, F.lit(" of the project"))).when(k == 1, "Second Building").when(k == 2, F.concat(F.lit("Phase"), n)).otherwise("Hall B")
    parent = F.when(k == 2, "Abilene campus").otherwise("")
    return table(spark, d, "supplier").select("s_suppkey", key(label, parent).alias("key"))


# gates, sweeps and worklists
@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = 0 THEN 'region' WHEN l_linenumber % 4 = 1 AND l_returnflag = 'A' THEN 'block:hall a' WHEN l_linenumber % 4 = 3 AND l_returnflag = 'R' THEN 'this_site' ELSE 'unnamed' END AS scope,
 CASE WHEN l_returnflag = 'N' THEN 'at_least' ELSE 'exact' END AS bound, CASE WHEN l_linestatus = 'F' AND l_tax > 0.035 THEN 'targeted' WHEN l_linestatus = 'F' THEN 'achieved' ELSE 'planned' END AS modality FROM lineitem""")
def axis_gates(spark, d):
    """Qualifiers of claims that their quotes license, the rest at their defaults."""
    from claimforge.operators.gates import axes

    four = F.col("l_linenumber") % 4
    quote = F.concat_ws("", F.lit("The site "), F.when(F.col("l_linestatus") == "F", "has  been built").otherwise("is there"), F.when(F.col("l_returnflag") == "N", " with more than 5 MW"), F.when(four == 0, " and jobs in the State"))
    scope = F.when(four == 0, "region").when(four == 1, F.when(F.col("l_returnflag") == "A", "block:hall a").otherwise("block:hall z")).when(four == 2, "portfolio").when(F.col("l_returnflag") == "R", "this_site").otherwise("galaxy")
    found = axes(scope, F.when(F.col("l_returnflag") != "R", "at_least").otherwise("at_most"), F.lit("achieved"), F.when((F.col("l_tax") > 0.035) & (F.col("l_linestatus") == "F"), "2030-01-01").otherwise("someday"),
                 quote, F.lit("2025-01-01").cast("date"), F.array(F.lit("hall a"), F.lit("hall b")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found.alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.scope", "x.bound", "x.modality")


@register("""SELECT event_id, event_type IN ('view', 'click') AS happened, event_type = 'error' OR (event_type = 'click' AND value > 100) AS supported FROM events""")
def quote_support(spark, d):
    """Whether quotes tell what happened, and whether they speak of the obstacle they are filed under."""
    from claimforge.operators.gates import records_the_past, supports_risk

    t = F.col("event_type")
    quote = F.when(t == "view", "The plant opened").when(t == "click", "It broke ground near the river").when(t == "error", "A transformer is scheduled for May").otherwise("Work will BEGIN soon")
    category = F.when(t == "error", "equipment_supply").when((t == "click") & (F.col("value") > 100), "water").otherwise("permitting")
    words = {"equipment_supply": ["transformer", "turbine"], "water": ["river", "aquifer"], "permitting": ["permit", "zoning"]}
    return table(spark, d, "events").select("event_id", records_the_past(quote).alias("happened"), supports_risk(category, quote, words).alias("supported"))


_CONDITIONS = {
    "has_source": 0, "no_silent_defect": 0, "no_errors": 0, "audit_clear": 1, "no_inversions": 1, "duplicates_answered": 1, "fields_present": 2, "values_backed": 2,
    "warnings_settled": 3, "blocks_settled": 3, "risks_confirmed": 3, "vintage_current": 3,
}


@register("""WITH l AS (SELECT l_orderkey AS id, count(*) AS n, bool_or(l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax < 0.08) AS defect, max(l_quantity) AS top, min(l_quantity) AS low, count(DISTINCT l_linenumber) < count(*) AS twice,
 bool_or(l_linestatus = 'F') AS sure, bool_or(l_linestatus = 'O' AND l_suppkey % 3 <> 0) AS unsure, bool_or(l_linenumber = 7) AS vague, max(CAST(l_shipdate AS DATE)) AS newest FROM lineitem GROUP BY 1),
w AS (SELECT o_custkey, o_orderpriority, count(*) AS m FROM orders GROUP BY ALL),
c AS (SELECT o_orderkey AS id, coalesce(n, 0) > 0 AS a1, NOT coalesce(defect, false) AS a2, o_totalprice >= 1000 AS a3, coalesce(top <= 45, true) AS b1, coalesce(low >= 2, true) AS b2, m = 1 AS b3,
 o_orderpriority <> '4-NOT SPECIFIED' AS c1, coalesce(sure, false) AS c2, NOT coalesce(twice, false) AS d1, NOT coalesce(vague, false) AS d2, NOT coalesce(unsure, false) AS d3, coalesce(newest >= DATE '1998-01-01', false) AS d4
 FROM orders JOIN w USING (o_custkey, o_orderpriority) LEFT JOIN l ON l.id = o_orderkey)
SELECT id, CASE WHEN NOT (a1 AND a2 AND a3) THEN -1 WHEN NOT (b1 AND b2 AND b3) THEN 0 WHEN NOT (c1 AND c2) THEN 1 WHEN NOT (d1 AND d2 AND d3 AND d4) THEN 2 ELSE 3 END AS tier,
 12 - (a1::INT + a2::INT + a3::INT + b1::INT + b2::INT + b3::INT + c1::INT + c2::INT + d1::INT + d2::INT + d3::INT + d4::INT) AS failed FROM c""")
def clean_cards(spark, d):
    """Twelve conditions of each record, the highest tier of which all hold with those below, and how many fail.

    Evidence is aggregated by record once; a tier is reached if none of its conditions or of a lower one fails.
    """
    x = F.col
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.bool_or((x("l_returnflag") == "R") & (x("l_linestatus") == "O") & (x("l_tax") < 0.08)).alias("defect"), F.max("l_quantity").alias("top"), F.min("l_quantity").alias("low"),
        (F.count_distinct("l_linenumber") < F.count("*")).alias("twice"), F.bool_or(x("l_linestatus") == "F").alias("sure"), F.bool_or((x("l_linestatus") == "O") & (x("l_suppkey") % 3 != 0)).alias("unsure"),
        F.bool_or(x("l_linenumber") == 7).alias("vague"), F.max("l_shipdate").alias("newest"))
    o = table(spark, d, "orders")
    groups = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("m"))
    rows = o.join(groups, ["o_custkey", "o_orderpriority"]).join(by, x("o_orderkey") == x("l_orderkey"), "left")
    yes = lambda c, default: F.coalesce(c, F.lit(default))
    holds = dict(zip(_CONDITIONS, [
        yes(x("n") > 0, False), ~yes(x("defect"), False), x("o_totalprice") >= 1000, yes(x("top") <= 45, True), yes(x("low") >= 2, True), x("m") == 1, x("o_orderpriority") != "4-NOT SPECIFIED", yes(x("sure"), False),
        ~yes(x("twice"), False), ~yes(x("vague"), False), ~yes(x("unsure"), False), yes(x("newest") >= F.lit("1998-01-01").cast("timestamp_ntz"), False)]))
    failing = F.array_compact(F.array(*[F.when(~holds[k], F.lit(tier)) for k, tier in _CONDITIONS.items()]))
    cards = rows.select(x("o_orderkey").alias("id"), failing.alias("f"))
    return cards.select("id", (F.coalesce(F.array_min("f"), F.lit(4)) - 1).alias("tier"), F.size("f").alias("failed"))


@register(r"""WITH u AS (SELECT page_id, ' ' || trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) || ' ' AS words FROM pages), p(id, company, place) AS (VALUES (1, 'example com', 'en'), (2, 'example net', 'es'), (3, 'm', 'fr'))
SELECT page_id, id FROM u JOIN p ON contains(words, ' ' || company || ' ') AND contains(words, ' ' || place || ' ')""")
def project_urls(spark, d):
    """Addresses that name a record's company and its place: companies meet on their first word, then the whole is checked."""
    names = spark.createDataFrame([(1, "example com", "en"), (2, "example net", "es"), (3, "m", "fr")], "id int, company string, place string")
    folded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " ")), F.lit(" "))
    p = table(spark, d, "pages").select("page_id", folded.alias("words"))
    words = p.select("page_id", "words", F.explode(F.array_distinct(F.split(F.trim("words"), " "))).alias("word"))
    hits = words.join(F.broadcast(names.withColumn("word", F.substring_index("company", " ", 1))), "word")
    inside = lambda c: F.contains("words", F.concat(F.lit(" "), F.col(c), F.lit(" ")))
    return hits.where(inside("company") & inside("place")).select("page_id", "id")


@register(f"""WITH {PAGE}, {PROJECT}, y AS (SELECT host, count(*) FILTER (size % 4 = 0) / count(*) AS yield FROM page GROUP BY host)
SELECT page_id, round(yield + CASE WHEN status = 'thin' THEN 0.5 ELSE 0 END, 4) AS score FROM page JOIN y USING (host) WHERE status <> 'ok' ORDER BY round(yield + CASE WHEN status = 'thin' THEN 0.5 ELSE 0 END, 4) DESC, url, page_id LIMIT 40""")
def backfill_candidates(spark, d):
    """Pages worth another reading: by their publisher's yield, thin ones first."""
    p = pages(spark, d)
    rate = p.groupBy("host").agg((F.count_if(F.col("size") % 4 == 0) / F.count("*")).alias("yield"))
    score = F.round(F.col("yield") + F.when(F.col("status") == "thin", 0.5).otherwise(0.0), 4)
    return p.where("status <> 'ok'").join(rate, "host").withColumn("score", score).orderBy(F.desc("score"), "url", "page_id").limit(40).select("page_id", "score")


@register("""WITH r AS (SELECT s_suppkey, s_suppkey % 60 AS k FROM supplier), p AS (SELECT p_size AS k, count(*) AS n, max(p_partkey % 4) AS best FROM part GROUP BY 1)
SELECT count(*) AS required, count(n) AS present, count(*) FILTER (best >= 2) AS confident FROM r LEFT JOIN p USING (k)""")
def required_progress(spark, d):
    """How many of a list of required records are there, and how many well sourced."""
    there = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("k")).agg(F.count("*").alias("n"), F.max(F.col("p_partkey") % 4).alias("best"))
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") % 60).alias("k"))
    return wanted.join(there, "k", "left").agg(F.count("*").alias("required"), F.count("n").alias("present"), F.count_if(F.col("best") >= 2).alias("confident"))
