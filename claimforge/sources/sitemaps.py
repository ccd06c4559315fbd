"""Feeds and sitemaps in SQL, and the walk from a sitemap's index to its children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from claimforge.session import ship
from claimforge.sources.readers import feed_rows


@udtf(returnType="position int, title string, url string, published string, kind string")
class FeedEntries:
    """A document's entries in its order: ``SELECT * FROM documents d, LATERAL feed_entries(d.xml)``; errors as ``parse_feeds`` has them.

    A document that can be read but lists nothing is an error, too: every document gives a row.
    """

    def eval(self, xml: str):
        for position, row in enumerate(feed_rows(xml) or [(None, None, None, "error: lists nothing")]):
            yield (position, *row)


def register(spark: SparkSession) -> None:
    """Make ``feed_entries`` known to the session's SQL."""
    ship(spark)
    spark.udtf.register("feed_entries", FeedEntries)


def walk(roots: DataFrame, documents: DataFrame, most_children: int = 4, newest_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entries that the sitemaps ``roots`` (``name, url``) lead to, and what went wrong: ``(name, via, url, published)``, ``(name, problem)``.

    ``documents`` is ``url, xml``, one row an address.  A root that is an index is followed one level: to those children whose address
    speaks of articles, or if none does to all, ``most_children`` of them by date, newest first and those without one last, else in
    their order.  A child that is an index itself isn't followed.  A root or child that isn't there, can't be read or lists nothing is a problem of
    its own and stops no other; rows without name or address are passed over.
    """
    register(roots.sparkSession)
    roots = roots.select("name", "url").where("name is not null and url is not null").distinct()
    bodies = documents.select("url", "xml")

    def parsed(wanted: DataFrame) -> DataFrame:
        """``name, via, entry`` of addresses ``name, via``; ``entry`` is null where there is no document."""
        found = wanted.join(bodies.withColumnRenamed("url", "via"), "via", "left")
        entry = F.struct("position", F.col("e.url").alias("url"), "published", "kind")
        rows = found.where("xml is not null").alias("d").lateralJoin(FeedEntries(F.col("d.xml").outer()).alias("e"))
        return rows.select("name", "via", entry.alias("entry")).unionByName(found.where("xml is null").select("name", "via", F.lit(None).cast("struct<position int, url string, published string, kind string>").alias("entry")))

    top = parsed(roots.withColumnRenamed("url", "via"))
    listed = top.where("entry.kind = 'index'").select("name", "via", "entry.*")
    article = F.lower("url").rlike("article|news|post|story")
    root = Window.partitionBy("name", "via")
    order = [F.to_date(F.substring("published", 1, 10)).desc_nulls_last()] if newest_first else []
    children = listed.withColumn("article", article).withColumn("any", F.max("article").over(root)).where("article or not any")
    children = children.withColumn("n", F.row_number().over(root.orderBy(*order, "position"))).where(F.col("n") <= most_children)
    below = parsed(children.select("name", F.col("url").alias("via")).distinct())
    entries = top.unionByName(below).where("entry.kind not like 'error%' and entry.kind <> 'index'").select("name", "via", "entry.url", "entry.published")

    def problems(rows: DataFrame) -> DataFrame:
        what = F.when(F.col("entry").isNull(), "is not there").when(F.col("entry.kind").like("error%"), F.col("entry.kind"))
        return rows.select("name", F.concat_ws(" ", "via", what).alias("problem"), what.alias("what")).where("what is not null").select("name", "problem")

    return entries, problems(top).unionByName(problems(below)).distinct()
