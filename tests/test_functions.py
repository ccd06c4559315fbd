import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimforge.functions import codes, dates, identity, numbers, text
from claimforge.operators import extraction
from claimforge.operators.components import connected_components
from claimforge.sources import readers


def values(spark, f, raws):
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
    return [r.v for r in rows.select("k", f(F.col("raw")).alias("v")).orderBy("k").collect()]


def test_megawatts(spark):
    cases = {
        "300 MW": (300, None), "1.2 GW": (1200, None), "500kW": (0.5, None), "~250 MW": (250, "approximate"), "up to 1,000 megawatts": (1000, "approximate"),
        "100-200 MW": (100, "range"), "1 to 2 GW": (1000, "range"), "TBD": (None, None), "": (None, None), None: (None, None), "lots": (None, None), "5 apples": (None, None), "12–15 MW": (12, "range"),
    }
    got = values(spark, numbers.norm_mw, cases)
    for (raw, (value, note)), r in zip(cases.items(), got):
        assert (r.value == pytest.approx(value) if value is not None else r.value is None) and r.note == note, raw


def test_money(spark):
    cases = {"$1.5 billion": 1_500_000_000, "US$ 20M": 20_000_000, "usd 5 bn": 5_000_000_000, "$10 to $15 million": 10_000_000, "$1-2 billion": 1_000_000_000, "about $3T": 3 * 10**12, "750": 750, "free": None, "undisclosed": None}
    assert [r.value for r in values(spark, numbers.norm_money, cases)] == list(cases.values())


def test_dates(spark):
    d = dt.date
    cases = {
        "2026-03-04": (d(2026, 3, 4), "day"), "2026-03-04T10:00:00": (d(2026, 3, 4), "day"), "3/4/69": (d(2069, 3, 4), "day"), "3/4/70": (d(1970, 3, 4), "day"), "2026-13-01": (None, None),
        "2026/7": (d(2026, 7, 1), "month"), "Q3 2027": (d(2027, 7, 1), "quarter"), "2027 q4": (d(2027, 10, 1), "quarter"), "H2 2028": (d(2028, 7, 1), "half"), "first half of 2028": (d(2028, 1, 1), "half"),
        "March 5, 2025": (d(2025, 3, 5), "day"), "5 Sept. 2025": (d(2025, 9, 5), "day"), "sep 2025": (d(2025, 9, 1), "month"), "2030": (d(2030, 1, 1), "year"), "by 2029": (d(2029, 1, 1), "year"),
        "late 2026": (d(2026, 10, 1), "quarter"), "mid-2026": (d(2026, 7, 1), "quarter"), "next year": (None, None), "soon": (None, None), "tbd": (None, None), "Smarch 5, 2025": (None, None), None: (None, None),
    }
    assert [(r.value, r.precision) for r in values(spark, dates.norm_date, cases)] == list(cases.values())


def test_dates_are_read_step_by_step(spark):
    """A text is named once in the expression: copies of it within one another made a million rows take hours."""
    plan = spark.createDataFrame([], "raw string").select(dates.norm_date(F.col("raw")))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("raw#") == 1 and len(plan) < 50_000


def test_texts_are_named_once(spark):
    """In each reader's expression, and so each of a reply's values is cleaned once."""
    raw, df = F.col("raw"), spark.createDataFrame([], "raw string")
    for value in (numbers.norm_mw(raw), numbers.norm_money(raw), text.norm_phase(raw), codes.norm_state(raw), extraction._text(raw)):
        plan = df.select(value.alias("v"))._jdf.queryExecution().analyzed().toString()
        assert plan.split("\n")[0].count("raw#") == 1


def test_placeholders(spark):
    cases = {"..": True, ".": False, "xx": True, "x": False, "x.": False, "__": True, "??": True, "?": True, " XX\n": True, "xx y": False, "$ tba soon": True, "placeholder 2": True, "": True, None: True, "5": False}
    assert values(spark, numbers.is_blank, cases) == list(cases.values())


def test_phases(spark):
    cases = {"Under Construction": "construction", "plans on hold": "paused", "withdrawn by applicant": "cancelled", "in-service": "operational", "permit review": "permitting", "gibberish": None, None: None}
    assert values(spark, text.norm_phase, cases) == list(cases.values())


def test_identity(spark):
    cases = {"Amazon Web Services, Inc.": "amazon", "Meta Platforms": "meta", "Crédit Holdings LLC": "credit", "AT&T": "at and t", "Switch, Inc.": "switch", "Acme Technologies Group Ltd": "acme", None: ""}
    assert values(spark, identity.company_key, cases) == list(cases.values())
    hosts = {"https://www.a.b.co.uk/x?y": "b.co.uk", "http://user@news.example.com:80/": "example.com", "example.org": "example.org", "": ""}
    assert values(spark, identity.registrable_domain, hosts) == list(hosts.values())
    counties = {"Loudoun County": True, "Ashburn": False, None: False}
    assert values(spark, identity.looks_like_county, counties) == list(counties.values())


def test_conflicts(spark):
    rows = spark.createDataFrame([(100.0, 121.0), (100.0, 125.0), (100.0, 126.0), (0.0, 0.0), (None, 5.0), (0.0, 1.0)], "a double, b double")
    assert [r.c for r in rows.select(numbers.values_conflict(F.col("a"), F.col("b")).alias("c")).collect()] == [False, False, True, False, False, True]


def test_text(spark):
    page = "<html><nav>menu</nav><p>One &amp; two<br>three</p><!-- x --><script>bad()</script><p>four</p></html>"
    assert values(spark, text.html_to_text, [page]) == ["One & two\nthree\nfour"]
    assert values(spark, text.looks_english, ["hello", "数据中心建设", "", "mostly english 数"]) == [True, False, True, True]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>http://a/1</link><pubDate>Mon, 06 May 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="http://b/2"/><updated>2024-05-06T10:00:00Z</updated></entry></feed>'
    site = "<urlset><url><loc>http://c/big-news</loc><lastmod>2024-05-06</lastmod></url></urlset>"
    rows = spark.createDataFrame([("r", rss), ("a", atom), ("s", site), ("x", "<rss><item>"), ("n", None)], "source string, xml string")
    got = {r.source: r for r in readers.parse_feeds(rows).withColumn("when", readers.timestamp_of(F.col("published"))).collect()}
    assert (got["r"].title, got["r"].url, got["a"].url, got["s"].url) == ("A", "http://a/1", "http://b/2", "http://c/big-news")
    assert got["x"].kind.startswith("error") and got["n"].kind.startswith("error")
    assert got["r"].when == got["a"].when is not None and got["s"].when is not None


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 51: 50, 60: 60}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_scan_their_edges_once_and_write_few_files(spark):
    rows = spark.sparkContext.accumulator(0)

    def found(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    most = 2 * spark.sparkContext.defaultParallelism
    settings = {"spark.sql.shuffle.partitions": str(5 * most), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(1000).selectExpr("id as src", "id + 1000 as dst").mapInArrow(found, "src long, dst long")
        got = connected_components(edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows.value == 1000
    assert got.rdd.getNumPartitions() <= most
    assert sorted(map(tuple, got.collect())) == sorted((n, k) for k in range(1000) for n in (k, k + 1000))


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "q.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Project</t></si><si><r><t>M</t></r><r><t>W</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   f'<row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3"><v>12.5</v></c></row></sheetData></worksheet>')
    got = [(r.line, r.cells) for r in readers.read_xlsx(spark, str(tmp_path / "q.xlsx")).collect()]
    assert got == [(1, ["Project", None, "MW"]), (3, ["x", "12.5"])]


def test_page_dates_and_links(spark):
    rows = [
        (1, "http://a.com/x", '<script>{"datePublished": "2024-05-06T10:00:00Z"}</script><a href="https://b.org/1">b</a><a href="http://www.a.com/2">own</a>'),
        (2, "http://a.com/2023/1/5/x", "<p>none</p>"), (3, "http://a.com/y", '<meta property="article:published_time" content="2022-02-03"><a href="https://web.archive.org/web/2020/http://c.net/z">z</a>'),
        (4, "http://a.com/z", '<time datetime="1990-01-01">'),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert [str(r.d) for r in df.select(readers.published_date(F.col("html"), F.col("url")).alias("d"), "page_id").orderBy("page_id").collect()] == ["2024-05-06", "2023-01-05", "2022-02-03", "None"]
    assert sorted((r.page_id, r.link) for r in readers.external_links(df).collect()) == [(1, "https://b.org/1"), (3, "http://c.net/z")]


def test_places_and_queues(spark):
    places = spark.createDataFrame([("VA", "ashburn", "Loudoun", 39.0, -77.5), ("VA", "twin", "A", 1.0, 1.0), ("VA", "twin", "B", 2.0, 2.0)], "state string, key string, county string, lat double, lon double")
    rows = spark.createDataFrame([(1, "Ashburn (CDP)", "VA", None, None, None), (2, "Twin", "VA", None, None, None), (3, "Ashburn", "VA", "Kept", 5.0, None)], "id int, city string, state string, county string, lat double, lon double")
    assert {r.id: (r.county, r.lat, r.lon) for r in readers.fill_places(rows, places).collect()} == {1: ("Loudoun", 39.0, -77.5), 2: (None, None, None), 3: ("Kept", 5.0, -77.5)}
    queue = spark.createDataFrame([("1", "Acme Cloud Campus", "1,000", "Active", None, None, "Q2 2027"), ("2", "Other", "5 MW", "?", "2024-01-02", None, ""), ("3", "acme", "TBD", "Suspended", None, None, None)],
                                  "id string, name string, capacity string, status string, withdrawn string, in_service string, online string")
    got = {r.id: (r.company, r.mw, r.phase, str(r.expected_online)) for r in readers.queue_records(queue, ["Acme", "Acme Cloud"]).collect()}
    assert got == {"1": ("Acme Cloud", 1000.0, "permitting", "2027-04-01"), "2": (None, 5.0, "cancelled", "None"), "3": ("Acme", None, "paused", "None")}


def test_candidates(spark):
    rows = [("http://x.com/1", "Data center campus permit filed", "", "q"), ("http://x.com/1", "again", "", "z"), ("http://m.bad.org/2", "data center permit", "", "q"), ("http://y.com", "数据中心数据中心", "", "q"), ("http://z.com", "crypto data center permit", "", "q")]
    got = {r.url: (r.keep, r.reason) for r in readers.useful_candidates(spark.createDataFrame(rows, "url string, title string, snippet string, query string"), ["bad.org"], ["crypto"], ["data center"], ["permit"], ["lawsuit"]).collect()}
    assert got == {"http://x.com/1": (True, "signal: permit"), "http://m.bad.org/2": (False, "blocked host"), "http://y.com": (False, "not english"), "http://z.com": (False, "excluded: crypto")}
