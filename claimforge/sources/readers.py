"""Readers: queue exports with column maps, feeds, places, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimforge.functions.numbers import is_blank
from claimforge.session import ship


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """All columns as text, quoted fields may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def read_json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def map_columns(df: DataFrame, columns: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Logical columns from the first candidate that isn't blank; raises if a required one has no candidate."""
    have = {c.strip().lower(): c for c in df.columns}
    found: dict[str, Column] = {}
    for name, candidates in columns.items():
        present = [F.col(f"`{have[c.strip().lower()]}`") for c in candidates if c.strip().lower() in have]
        if not present and name in required:
            raise ValueError(f"no column for {name}: one of {', '.join(candidates)}")
        found[name] = F.coalesce(*[F.when(~is_blank(c), F.trim(c)) for c in present]) if present else F.lit(None).cast("string")
    return df.select(*[c.alias(n) for n, c in found.items()])


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with ``reasons``."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def feed_rows(xml: str | None) -> list[tuple[str | None, str | None, str | None, str]]:
    """``title, url, published, kind`` of a feed's or sitemap's entries; a malformed document gives one row of kind ``error``."""
    import xml.etree.ElementTree as ET

    def local(tag) -> str:
        return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""

    try:
        root = ET.fromstring((xml or "").strip())
    except ET.ParseError as e:
        return [(None, None, None, f"error: {e.msg if hasattr(e, 'msg') else e}"[:80])]
    kind = {"rss": "rss", "rdf": "rss", "feed": "atom", "urlset": "sitemap", "sitemapindex": "index"}.get(local(root.tag), "error: unknown root")
    out = []
    for item in (x for x in root.iter() if local(x.tag) in ("item", "entry", "url", "sitemap")):
        fields = {}
        for child in item:
            name = local(child.tag)
            text = (child.get("href") or child.text or "") if name == "link" else (child.text or "")
            if name not in fields and text.strip():
                fields[name] = text.strip()
        url = fields.get("link") or fields.get("loc")
        if url:
            when = fields.get("pubdate") or fields.get("published") or fields.get("updated") or fields.get("lastmod")
            out.append((fields.get("title"), url, when, kind))
    return out


def parse_feeds(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """RSS, Atom and sitemaps to ``source, title, url, published, kind``; a malformed document gives one row of kind ``error``."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(source, *row) for source, xml in zip(batch["source"], batch["xml"]) for row in feed_rows(xml)]
            yield pd.DataFrame(out, columns=["source", "title", "url", "published", "kind"])

    return documents.select("source", F.col(xml_col).alias("xml")).mapInPandas(run, "source string, title string, url string, published string, kind string")


def timestamp_of(raw: Column) -> Column:
    """ISO, RFC 822 and plain dates; null unless within 2000 and two days from now at most."""
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd"]
    when = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*0?", ""), F.lit(f)) for f in forms])
    return F.when(when.between(F.lit("2000-01-01").cast("timestamp"), F.current_timestamp() + F.expr("interval 2 days")), when)


def date_from_url(url: Column) -> Column:
    """The date that a path like /2024/05/17/ or /2024-05-17 states."""
    digits = F.regexp_extract(url, r"/(20\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:[/-]|$)", 0)
    part = lambda k: F.regexp_extract(url, r"/(20\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:[/-]|$)", k)
    return F.when(digits != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).try_cast("date")


def slug_title(url: Column) -> Column:
    """The last path segment as a title."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+?)(?:\.[a-z]+)?/?$", 1)
    return F.trim(F.regexp_replace(last, r"[-_]+", " "))


def place_key(name: Column) -> Column:
    """A place's name without brackets, legal suffix, marks and case."""
    text = F.lower(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    for _ in range(3):
        text = F.regexp_replace(text, r"\s(?:county|parish|borough|city|town|village|cdp|municipality)$", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def load_places(rows: DataFrame, name: str, state: str, aliases: DataFrame | None = None) -> DataFrame:
    """``state, key`` with all columns; aliases never displace a real key."""
    real = rows.withColumn("key", place_key(F.col(name))).withColumn("_prio", F.lit(0))
    every = real if aliases is None else real.unionByName(aliases.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy(state, "key").orderBy("_prio", name)
    return every.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_prio")


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """``file, line, cells array<string>`` of a workbook's sheet; Spark reads the files, so they can be in any store.

    Shared and inline strings, numbers and booleans as they are written; missing cells are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import xml.etree.ElementTree as ET
        import zipfile

        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

        def column(ref: str) -> int:
            n = 0
            for c in re.match(r"[A-Z]+", ref)[0]:
                n = 26 * n + ord(c) - 64
            return n

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        for item in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si"):
                            shared.append("".join(t.text or "" for t in item.iter(f"{space}t")))
                    for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{space}row"):
                        cells: list = []
                        for cell in row.iter(f"{space}c"):
                            at = column(cell.get("r")) if cell.get("r") else len(cells) + 1
                            cells += [None] * (at - len(cells))
                            value = cell.find(f"{space}v")
                            if cell.get("t") == "inlineStr":
                                cells[at - 1] = "".join(t.text or "" for t in cell.iter(f"{space}t"))
                            elif value is not None and value.text is not None:
                                cells[at - 1] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                        out.append((file, int(row.get("r") or len(out) + 1), cells))
                yield pd.DataFrame(out, columns=["file", "line", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line int, cells array<string>")


def published_date(html: Column, url: Column) -> Column:
    """The date that a page states: JSON-LD, then meta tags, then a time element, then its path; within 2000 and two days from now."""
    patterns = [
        r'"datePublished"\s*:\s*"([^"]+)"', r'(?i)<meta[^>]+(?:article:published_time|datepublished|pubdate|og:published_time)["\'][^>]*content=["\']([^"\']+)',
        r'(?i)<meta[^>]*content=["\']([^"\']+)["\'][^>]+(?:article:published_time|datepublished|pubdate)', r'(?i)<time[^>]+datetime=["\']([^"\']+)',
    ]
    found = [timestamp_of(F.regexp_extract(html, p, 1)) for p in patterns]
    return F.coalesce(*[F.to_date(x) for x in found], date_from_url(url))


def external_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, link`` of every absolute link of a page to another host, archive copies unwrapped."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r'(?i)<a[^>]+href=["\'](https?://[^"\'\s]+)'), F.lit(1))
    link = F.regexp_replace(F.col("raw"), r"^https?://web\.archive\.org/web/\d+[a-z_]*/", "")
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(links)).alias("raw")).withColumn("link", link)
    return rows.where(host(F.col("link")) != host(F.col("url"))).select("page_id", "link").distinct()


#: Rows of a gazetteer that may be broadcast: about 20 MB.
PLACES = 200_000


def fill_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """County and coordinates where a (state, city) lies in exactly one county; what is there stays.

    ``places`` has ``state, key, county, lat, lon``.  A gazetteer of up to PLACES places is broadcast; a larger one is
    joined by a shuffle.
    """
    one = places.groupBy("state", "key").agg(F.count_distinct("county").alias("n"), F.min("county").alias("_county"), F.min_by("lat", "county").alias("_lat"), F.min_by("lon", "county").alias("_lon")).where("n = 1").drop("n")
    one = F.broadcast(one) if places.limit(PLACES + 1).count() <= PLACES else one
    joined = rows.withColumn("key", place_key(F.col("city"))).join(one, ["state", "key"], "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in ("county", "lat", "lon") else F.col(c) for c in rows.columns])


#: Statuses of grid queues and the phases they stand for.
QUEUE_PHASES = {"withdrawn": "cancelled", "cancelled": "cancelled", "deactivated": "cancelled", "in service": "operational", "in-service": "operational", "suspended": "paused", "under construction": "construction", "active": "permitting"}


def queue_records(rows: DataFrame, operators: list[str]) -> DataFrame:
    """Mapped queue rows to records: MW, phase, dates, and the operator that the name mentions (the longest match)."""
    from claimforge.functions import dates, numbers

    status = F.lower(F.trim("status"))
    phase = F.when(numbers.norm_mw(F.col("withdrawn"))["value"].isNotNull() | dates.norm_date(F.col("withdrawn"))["value"].isNotNull(), "cancelled")
    phase = phase.when(dates.norm_date(F.col("in_service"))["value"].isNotNull(), "operational")
    for word, name in QUEUE_PHASES.items():
        phase = phase.when(status == word, name)
    ordered = F.array(*map(F.lit, sorted(operators, key=lambda o: (-len(o), o))))
    named = F.try_element_at(F.filter(ordered, lambda o: F.contains(F.lower(F.col("name")), F.lower(o))), F.lit(1))
    return rows.select("id", "name", named.alias("company"), numbers.norm_mw(F.col("capacity"))["value"].alias("mw"), phase.otherwise("announced").alias("phase"), dates.norm_date(F.col("online"))["value"].alias("expected_online"))


def useful_candidates(hits: DataFrame, blocked: list[str], exclude: list[str], topic: list[str], signal: list[str], risk: list[str]) -> DataFrame:
    """Search hits to queue candidates: distinct URL, host not blocked, and the keyword tiers on title and snippet; with the reason."""
    from claimforge.functions import text

    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    bad = F.exists(F.array(*map(F.lit, blocked)), lambda b: (host == b) | F.endswith(host, F.concat(F.lit("."), b))) if blocked else F.lit(False)
    rows = hits.groupBy("url").agg(F.min_by(F.struct("title", "snippet", "query"), F.struct("query", "title", "snippet")).alias("h")).select("url", "h.*")
    verdict = text.keyword_filter(F.concat_ws(" ", "title", "snippet"), exclude, topic, signal, risk)
    rows = rows.withColumn("v", verdict).withColumn("english", text.looks_english(F.concat_ws(" ", "title", "snippet")))
    reason = F.when(bad, "blocked host").when(~F.col("english"), "not english").otherwise(F.col("v.reason"))
    return rows.select("url", "title", F.substring(F.concat(F.lit("search:"), "query"), 1, 120).alias("feed"), (~bad & F.col("english") & F.col("v.keep")).alias("keep"), reason.alias("reason"))
