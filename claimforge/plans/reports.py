"""Lists, statistics, gaps, exposure and buyers' positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.operators import reports as R
from claimforge.plans.registry import register
from claimforge.session import table
from claimforge.sources.adapters import PAGE, PROJECT, RISK, pages, projects, risks

_CENTS = "CAST(round(mw * 100) AS BIGINT)"


def _cents(c="mw"):
    return F.round(F.col(c) * 100).cast("long")


@register(f"""WITH {PROJECT}, {RISK} SELECT id, company, state, phase FROM project
WHERE contains(lower(company), '7') AND confidence >= 1 AND EXISTS (SELECT 1 FROM risk WHERE project_id = id AND status = 'open' AND category = 'power' AND severity = 'blocking')""")
def list_filtered_semi(spark, d):
    some = risks(spark, d).where("status = 'open' and category = 'power' and severity = 'blocking'")
    return R.filtered(projects(spark, d), company="7", min_confidence=1, open_risks=some).select("id", "company", "state", "phase")


@register(f"WITH {PROJECT} SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE mw END AS mw FROM project ORDER BY 2 DESC NULLS LAST, id LIMIT 100")
def list_sort_nulls_last(spark, d):
    rows = projects(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("mw")).alias("mw"))
    return rows.orderBy(F.col("mw").desc_nulls_last(), "id").limit(100)


@register(f"WITH {PROJECT} SELECT id, confidence, company FROM project WHERE confidence <= 1 ORDER BY confidence, id LIMIT 50")
def review_low_confidence(spark, d):
    return projects(spark, d).where("confidence <= 1").orderBy("confidence", "id").limit(50).select("id", "confidence", "company")


@register(f"""WITH {PROJECT} SELECT count(*) AS projects, coalesce(CAST(sum({_CENTS}) AS BIGINT), 0) AS mw_cents, count(CASE WHEN id % 7 <> 0 THEN mw END) AS with_mw FROM project""")
def stats_totals(spark, d):
    return projects(spark, d).agg(F.count("*").alias("projects"), F.coalesce(F.sum(_cents()), F.lit(0)).alias("mw_cents"), F.count(F.when(F.col("id") % 7 != 0, F.col("mw"))).alias("with_mw"))


@register(f"""WITH {PROJECT} SELECT CASE WHEN phase IS NOT NULL THEN 'phase' WHEN confidence IS NOT NULL THEN 'confidence' ELSE 'state' END AS kind,
 coalesce(phase, CAST(confidence AS VARCHAR), state) AS value, count(*) AS n FROM project GROUP BY GROUPING SETS ((phase), (confidence), (state))""")
def stats_grouping_sets(spark, d):
    """Three group counts from one scan."""
    p = projects(spark, d)
    sets = p.groupingSets([["phase"], ["confidence"], ["state"]], "phase", "confidence", "state").agg(F.count("*").alias("n"))
    kind = F.when(F.col("phase").isNotNull(), "phase").when(F.col("confidence").isNotNull(), "confidence").otherwise("state")
    return sets.select(kind.alias("kind"), F.coalesce("phase", F.col("confidence").cast("string"), "state").alias("value"), "n")


@register(f"""WITH {PROJECT}, {RISK} SELECT category, count(DISTINCT project_id) AS projects, CAST(sum({_CENTS}) AS BIGINT) AS mw_cents FROM risk JOIN project ON id = project_id WHERE status = 'open' GROUP BY category""")
def stats_by_open_risk(spark, d):
    """Projects count once, capacity once for each risk row."""
    joined = risks(spark, d).where("status = 'open'").join(projects(spark, d), F.col("id") == F.col("project_id"))
    return joined.groupBy("category").agg(F.count_distinct("project_id").alias("projects"), F.sum(_cents()).alias("mw_cents"))


@register(f"""WITH {PROJECT}, x AS (SELECT *, phase = 'operational' AS built, CASE WHEN id % 7 = 0 THEN NULL ELSE mw END AS m, CASE WHEN id % 5 = 0 THEN NULL ELSE announced END AS a FROM project),
c AS (SELECT 'mw' AS field, count(*) AS applicable, count(m) AS filled FROM x UNION ALL SELECT 'announced', count(*), count(a) FROM x
 UNION ALL SELECT 'built', count(*) FILTER (built), count(m) FILTER (built) FROM x)
SELECT field, applicable, filled, CAST(round_even(100.0 * filled / nullif(applicable, 0), 0) AS BIGINT) AS pct FROM c""")
def gap_coverage(spark, d):
    x, every = projects(spark, d), F.lit(True)
    m, a = F.when(F.col("id") % 7 != 0, F.col("mw")), F.when(F.col("id") % 5 != 0, F.col("announced"))
    return R.gap_coverage(x, {"mw": (every, m), "announced": (every, a), "built": (F.col("phase") == "operational", m)})


@register(f"""WITH {PROJECT}, x AS (SELECT id, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS missing FROM project)
SELECT id, CAST(missing AS BIGINT) AS missing FROM x ORDER BY missing DESC, id LIMIT 3""")
def gap_worst(spark, d):
    gaps = [F.when(F.col("id") % k == 0, F.lit(None)).otherwise(F.col("mw")) for k in (7, 5, 3)]
    x = projects(spark, d).select("id", sum((g.isNull().cast("long") for g in gaps), F.lit(0).cast("long")).alias("missing"))
    return x.orderBy(F.desc("missing"), "id").limit(3)


@register(f"""WITH {PAGE}, x AS (SELECT *, CASE WHEN status = 'pending' THEN 0 WHEN status = 'thin' THEN 1 ELSE 2 END AS priority, CASE WHEN page_id % 5 = 0 THEN NULL ELSE size END AS published FROM page)
SELECT page_id, priority, published FROM x ORDER BY priority, published ASC NULLS LAST, page_id LIMIT 60""")
def queue_priority(spark, d):
    x = pages(spark, d).select("page_id", F.expr("CASE WHEN status = 'pending' THEN 0 WHEN status = 'thin' THEN 1 ELSE 2 END").alias("priority"), F.when(F.col("page_id") % 5 != 0, F.col("size")).alias("published"))
    return x.orderBy("priority", F.col("published").asc_nulls_last(), "page_id").limit(60)


@register(f"""WITH {PAGE} SELECT page_id, status FROM page WHERE page_id % 2 = 0 AND (EXISTS (SELECT 1 FROM documents WHERE doc_id = page_id * 3) OR status = 'pending')""")
def undated_exists_or(spark, d):
    """An existence test within a disjunction: a marker join, no row twice."""
    cited = table(spark, d, "documents").select((F.col("doc_id")).alias("cited")).distinct()
    x = pages(spark, d).where("page_id % 2 = 0")
    return x.join(cited, F.col("page_id") * 3 == F.col("cited"), "left").where("cited is not null or status = 'pending'").select("page_id", "status")


@register(f"WITH {PAGE} SELECT host, min(page_id) AS first_page, count(*) AS pages FROM page WHERE url LIKE 'http%' AND NOT contains(url, '?') GROUP BY host")
def stale_min_fetch(spark, d):
    return pages(spark, d).where(F.startswith("url", F.lit("http")) & ~F.contains("url", F.lit("?"))).groupBy("host").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


_WORST = f"""{PROJECT}, {RISK}, worst AS (SELECT category, project_id, max(severity_rank) AS w FROM risk WHERE status = 'open' GROUP BY ALL),
x AS (SELECT category, count(*) AS projects, CAST(sum(CASE WHEN w = 3 THEN {_CENTS} ELSE 0 END) AS BIGINT) AS blocking, CAST(sum(CASE WHEN w = 2 THEN {_CENTS} ELSE 0 END) AS BIGINT) AS material,
 CAST(sum(CASE WHEN w = 1 THEN {_CENTS} ELSE 0 END) AS BIGINT) AS watch, count(*) FILTER (mw IS NULL) AS uncosted FROM worst JOIN project ON id = project_id GROUP BY category)"""


@register(f"WITH {_WORST} SELECT category, projects, blocking, material, watch, uncosted FROM x")
def exposure_by_category(spark, d):
    return R.exposure(risks(spark, d), projects(spark, d), "category").drop("weighted")


@register(f"WITH {_WORST} SELECT category, CAST(round((blocking + material / 2 + watch / 4) / 100, 2) AS DOUBLE) AS weighted FROM x")
def exposure_weighted(spark, d):
    return R.exposure(risks(spark, d), projects(spark, d), "category").select("category", F.round(F.col("weighted") / 100, 2).alias("weighted"))


@register(f"""WITH {PROJECT}, {RISK} SELECT category, severity, count(*) AS risks, CAST(sum({_CENTS}) AS BIGINT) AS mw_cents FROM risk JOIN project ON id = project_id WHERE status = 'open' GROUP BY category, severity""")
def risk_rows_by_category(spark, d):
    joined = risks(spark, d).where("status = 'open'").join(projects(spark, d), F.col("id") == F.col("project_id"))
    return joined.groupBy("category", "severity").agg(F.count("*").alias("risks"), F.sum(_cents()).alias("mw_cents"))


@register(f"""WITH {RISK}, one AS (SELECT * FROM risk QUALIFY row_number() OVER (PARTITION BY project_id, category, trim(regexp_replace(summary, '\\s+', ' ', 'g')) ORDER BY risk_id) = 1)
SELECT category, count(*) AS risks, count(*) FILTER (severity_rank = 3) AS blocking, count(*) FILTER (quoted) AS quoted FROM one GROUP BY category""")
def risks_deduplicated(spark, d):
    one = R.top_by(risks(spark, d).withColumn("said", F.trim(F.regexp_replace("summary", r"\s+", " "))), ["project_id", "category", "said"], [F.col("risk_id")])
    return one.groupBy("category").agg(F.count("*").alias("risks"), F.count_if(F.col("severity_rank") == 3).alias("blocking"), F.count_if(F.col("quoted")).alias("quoted"))


@register(f"""WITH {RISK} SELECT project_id, category, severity FROM risk WHERE status = 'open'
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY quoted DESC, severity_rank DESC, risk_id) = 1""")
def blocker_choice(spark, d):
    """Confirmed before severe, the first id of equals; the least id by a descending key of a combined maximum."""
    return R.top_by(risks(spark, d).where("status = 'open'"), ["project_id"], [F.desc("quoted"), F.desc("severity_rank"), F.col("risk_id")]).select("project_id", "category", "severity")


@register(f"""WITH {PROJECT} SELECT segment, count(*) AS projects, CAST(sum({_CENTS}) AS BIGINT) AS planned, CAST(sum(CASE WHEN phase = 'operational' THEN {_CENTS} ELSE 0 END) AS BIGINT) AS built,
 count(*) FILTER (phase = 'announced') AS announced, count(*) FILTER (phase = 'construction') AS construction, count(*) FILTER (phase = 'operational') AS operational, count(DISTINCT state) AS states FROM project GROUP BY segment""")
def buyer_rollup(spark, d):
    count = lambda p: F.count_if(F.col("phase") == p).alias(p)
    return projects(spark, d).groupBy("segment").agg(
        F.count("*").alias("projects"), F.sum(_cents()).alias("planned"), F.sum(F.when(F.col("phase") == "operational", _cents()).otherwise(0)).alias("built"),
        count("announced"), count("construction"), count("operational"), F.count_distinct("state").alias("states"))


@register(f"""WITH {PROJECT}, s AS (SELECT year(announced) AS year, CAST(sum({_CENTS}) AS BIGINT) AS value FROM project GROUP BY 1),
g AS (SELECT unnest(generate_series(a, least(b, a + 5))) AS year FROM (SELECT min(year) AS a, max(year) AS b FROM s))
SELECT CAST(g.year AS INT) AS year, coalesce(value, 0) AS value FROM g LEFT JOIN s USING (year)""")
def year_grid(spark, d):
    return R.year_grid(projects(spark, d), "announced", _cents())


@register(f"""WITH {PROJECT} SELECT CAST(year(announced) AS INT) AS year, CAST(quarter(announced) AS INT) AS quarter, count(*) AS projects, CAST(sum({_CENTS}) AS BIGINT) AS value FROM project GROUP BY ALL ORDER BY 1, 2 LIMIT 12""")
def quarter_grid(spark, d):
    x = projects(spark, d).groupBy(F.year("announced").alias("year"), F.quarter("announced").alias("quarter")).agg(F.count("*").alias("projects"), F.sum(_cents()).alias("value"))
    return x.orderBy("year", "quarter").limit(12)


@register(f"""WITH {PROJECT} SELECT coalesce(CASE WHEN custkey % 4 <> 0 THEN segment END, CASE WHEN custkey % 8 = 0 THEN 'self-built' END, 'unattributed') AS buyer, count(*) AS projects, CAST(sum({_CENTS}) AS BIGINT) AS mw_cents FROM project GROUP BY 1""")
def attribution(spark, d):
    buyer = F.coalesce(F.when(F.col("custkey") % 4 != 0, F.col("segment")), F.when(F.col("custkey") % 8 == 0, "self-built"), F.lit("unattributed"))
    return projects(spark, d).groupBy(buyer.alias("buyer")).agg(F.count("*").alias("projects"), F.sum(_cents()).alias("mw_cents"))


@register(f"""WITH {PROJECT} SELECT CAST(round_even(100.0 * avg(CASE WHEN id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 0) AS BIGINT) AS with_mw,
 CAST(round_even(100.0 * avg(CASE WHEN day(announced) = 1 THEN 1.0 ELSE 0.0 END), 0) AS BIGINT) AS month_start, CAST(round_even(100.0 * avg(CASE WHEN dayofyear(announced) = 1 THEN 1.0 ELSE 0.0 END), 0) AS BIGINT) AS new_year FROM project""")
def coverage_pct(spark, d):
    share = lambda c: F.bround(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100, 0).cast("long")
    return projects(spark, d).agg(share(F.col("id") % 7 != 0).alias("with_mw"), share(F.dayofmonth("announced") == 1).alias("month_start"), share(F.dayofyear("announced") == 1).alias("new_year"))


@register(f"""WITH {PROJECT} SELECT p.id, p.company FROM project p WHERE p.custkey IN (SELECT s_suppkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p.custkey)""")
def suspect_attributions(spark, d):
    p = projects(spark, d)
    found = p.join(table(spark, d, "supplier"), F.col("custkey") == F.col("s_suppkey"), "left_semi")
    return found.join(F.broadcast(table(spark, d, "nation")), F.col("custkey") == F.col("n_nationkey"), "left_anti").select("id", "company")


@register(f"""WITH {PROJECT}, {RISK}, w AS (SELECT segment, project_id, category, severity_rank, risk_id FROM risk JOIN project ON id = project_id WHERE status = 'open')
SELECT segment, project_id, category FROM w QUALIFY row_number() OVER (PARTITION BY segment ORDER BY severity_rank DESC, project_id DESC, risk_id DESC) = 1""")
def blocking_risk(spark, d):
    """The most severe open risk of each buyer by a combined maximum: no buyer's rows meet in a sort."""
    joined = risks(spark, d).where("status = 'open'").join(projects(spark, d).select("id", "segment"), F.col("id") == F.col("project_id"))
    best = joined.groupBy("segment").agg(F.max_by(F.struct("project_id", "category"), F.struct("severity_rank", "project_id", "risk_id")).alias("b"))
    return best.select("segment", "b.project_id", "b.category")


@register(f"""WITH {PROJECT}, t AS (SELECT *, sum({_CENTS}) OVER () AS total FROM project), s AS (SELECT segment, sum({_CENTS}) / max(total) AS share FROM t GROUP BY segment)
SELECT segment, CASE WHEN share >= 0.5 THEN 'most' WHEN share >= 0.25 THEN 'a large share' WHEN share >= 0.2 THEN 'a fifth' ELSE 'a small share' END AS share FROM s""")
def share_phrases(spark, d):
    sums = projects(spark, d).groupBy("segment").agg(F.sum(_cents()).alias("own"))
    share = F.col("own") / F.col("total")
    words = F.when(share >= 0.5, "most").when(share >= 0.25, "a large share").when(share >= 0.2, "a fifth").otherwise("a small share")
    return sums.join(F.broadcast(sums.agg(F.sum("own").alias("total")))).select("segment", words.alias("share"))


@register(f"""WITH {PROJECT} SELECT state, segment, count(*) AS n, string_agg(DISTINCT phase, ';' ORDER BY phase) AS phases, max(mw) AS largest FROM project GROUP BY state, segment ORDER BY n DESC, state, segment""")
def csv_row_shape(spark, d):
    x = projects(spark, d).groupBy("state", "segment").agg(F.count("*").alias("n"), F.concat_ws(";", F.array_sort(F.collect_set("phase"))).alias("phases"), F.max("mw").alias("largest"))
    return x.orderBy(F.desc("n"), "state", "segment")
