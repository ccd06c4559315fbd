"""Reports, ledgers and rejects on disk; first rows; gazetteers beyond the broadcast."""

from pyspark.sql import functions as F

from claimforge.sources import readers, sinks
from claimforge.streaming import incremental


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a|b <c>", None)], "id int, name string, x string")
    assert sinks.markdown(rows, "T") == "# T\n\n| id | name | x |\n| --- | --- | --- |\n| 1 | a\\|b <c> |  |\n"
    page = sinks.html(rows, "T & U")
    assert "<title>T &amp; U</title>" in page and "<tr><td>1</td><td>a|b &lt;c&gt;</td><td></td></tr>" in page and page.startswith("<!DOCTYPE html>")


def test_files(spark, tmp_path):
    p = spark.createDataFrame([(2, "B", "s", "VA", "built", 1.5, None, 1), (1, "A", "s", "VA", "built", None, None, 2)], "id int, company string, segment string, state string, phase string, mw double, announced date, confidence int")
    sinks.write_csv(p, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text() == "id,company,segment,state,phase,mw,announced,confidence\n1,A,s,VA,built,,,2\n2,B,s,VA,built,1.5,,1\n"
    ledger = str(tmp_path / "ledger")
    sinks.append_ledger(p.select("id", "company"), ledger)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(ledger)
    assert sorted(tuple(r) for r in sinks.read_ledger(spark, ledger, "id int, company string").collect()) == [(1, "A"), (2, "B")]
    good = sinks.write_rejects(p, {"no mw": F.col("mw").isNotNull()}, str(tmp_path / "rejects"))
    assert [r.id for r in good.collect()] == [2] and spark.read.json(str(tmp_path / "rejects")).select("id").first().id == 1


def test_first_seen_is_the_first(spark):
    rows = spark.createDataFrame([("a", 3, "late"), ("a", 1, "first"), ("b", 2, "only")], "k string, ts long, v string")
    assert sorted(tuple(r) for r in incremental.first_seen(rows, ["k"]).collect()) == [("a", 1, "first"), ("b", 2, "only")]


def test_large_gazetteers_are_shuffled(spark, monkeypatch):
    places = spark.createDataFrame([("VA", "ashburn", "Loudoun", 39.0, -77.5)], "state string, key string, county string, lat double, lon double")
    rows = spark.createDataFrame([(1, "Ashburn", "VA", None, None, None)], "id int, city string, state string, county string, lat double, lon double")
    monkeypatch.setattr(readers, "PLACES", 0)
    assert [(r.county, r.lat) for r in readers.fill_places(rows, places).collect()] == [("Loudoun", 39.0)]
