"""Workbooks as a data source, feeds as a table function, and the walk of sitemaps."""

import zipfile

from claimforge.sources import sitemaps, workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


def test_workbooks_by_sheet(spark, tmp_path):
    workbooks.register(spark)
    workbook(tmp_path / "a.xlsx", {"Active": '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row r="4"><c r="B4"><v>12.5</v></c></row>', "Old": '<row><c t="inlineStr"><is><t>x</t></is></c><c><v>7</v></c></row><row/>'}, ("MW", "Project"))
    workbook(tmp_path / "b.xlsx", {"Active": '<row r="2"><c r="AB2"><v>1</v></c></row>', "None": ""})
    rows = spark.read.format("workbook").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    got = sorted((r.file[-6:], r.sheet, r.line, tuple(r.cells)) for r in rows.collect())
    assert got == [("a.xlsx", "Active", 1, ("Project", None, "MW")), ("a.xlsx", "Active", 4, (None, "12.5")), ("a.xlsx", "Old", 1, ("x", "7")), ("a.xlsx", "Old", 2, ()), ("b.xlsx", "Active", 2, (None,) * 27 + ("1",))]
    assert spark.read.format("workbook").option("sheet", "Old").load(str(tmp_path / "a.xlsx")).count() == 2
    assert spark.read.format("workbook").option("sheet", "missing").load(str(tmp_path)).count() == 0


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>2024-05-0{k + 1}</lastmod></url>" for k, u in enumerate(urls)) + "</urlset>"


def index(*children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</sitemap>" for u, d in children) + "</sitemapindex>"


def test_feed_entries_in_sql(spark):
    sitemaps.register(spark)
    spark.createDataFrame([(1, urlset("u", "v")), (2, "<broken"), (3, None)], "id int, xml string").createOrReplaceTempView("feeds")
    got = [tuple(r) for r in spark.sql("SELECT d.id, e.position, e.url, e.kind FROM feeds d, LATERAL feed_entries(d.xml) e ORDER BY 1, 2").collect()]
    assert got[:2] == [(1, 0, "u", "sitemap"), (1, 1, "v", "sitemap")]
    assert [(r[0], r[2], r[3][:5]) for r in got[2:]] == [(2, None, "error"), (3, None, "error")]


def test_walk_of_sitemaps(spark):
    docs = [("i", index(("company", "2024-09-09"), ("news-1", "2024-01-01"), ("news-2", None), ("Story-3", "2024-03-01"), ("news-4", "2024-02-01T10:00:00Z"))), ("news-1", urlset("a1")), ("news-2", urlset("a2")),
            ("Story-3", urlset("a3", "a3b")), ("news-4", "<broken"), ("plain", urlset("p")), ("none", "<sitemapindex></sitemapindex>"), ("other", index(("x", None), ("gone", None), ("i", None))), ("x", urlset("ax"))]
    roots = spark.createDataFrame([("I", "i"), ("P", "plain"), ("N", "none"), ("O", "other"), ("M", "missing"), (None, "i"), ("I", None), ("P", "plain")], "name string, url string")
    entries, problems = sitemaps.walk(roots, spark.createDataFrame(docs, "url string, xml string"), most_children=3)
    assert sorted(tuple(r)[:3] for r in entries.collect()) == [("I", "Story-3", "a3"), ("I", "Story-3", "a3b"), ("I", "news-1", "a1"), ("O", "x", "ax"), ("P", "plain", "p")]
    got = sorted((r.name, r.problem.split(":")[0]) for r in problems.collect())
    assert got == [("I", "news-4 error"), ("M", "missing is not there"), ("N", "none error"), ("O", "gone is not there")]
    first = sitemaps.walk(roots, spark.createDataFrame(docs, "url string, xml string"), most_children=2, newest_first=False)[0]
    assert sorted(r.url for r in first.where("name = 'I'").collect()) == ["a1", "a2"]
    assert sitemaps.walk(roots.limit(0), spark.createDataFrame(docs, "url string, xml string"))[0].count() == 0
