"""Codes, choices and lists as Column expressions: each gives null for what it doesn't know."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimforge.functions.numbers import bind, blank_text, clean, is_blank

#: States and territories with their postal codes, countries with theirs.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC", "washington dc": "DC", "washington d.c.": "DC", "puerto rico": "PR", "guam": "GU", "american samoa": "AS",
    "northern mariana islands": "MP", "u.s. virgin islands": "VI", "us virgin islands": "VI", "virgin islands": "VI",
}
COUNTRIES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "america": "US",
    "ca": "CA", "canada": "CA", "mx": "MX", "mexico": "MX",
}
#: Hosts of the trade press, first labels of newsrooms, words that name generation or grid plant.
TRADE_PRESS = tuple("datacenterdynamics datacenterfrontier datacenterknowledge utilitydive rtoinsider latitudemedia heatmap semianalysis theregister".split())
NEWSROOMS = tuple("news about blog ir investor newsroom press".split())
GENERATION = tuple(
    "battery bess ccct ccgt generating generation grid interconnection nuclear plant plants powerplant ppa solar storage substation transmission turbine "
    "turbines uprate uprates wind".split())


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def norm_state(raw: Column) -> Column:
    """The postal code of a state by code or name, else null."""
    def read(text: Column) -> Column:
        code = F.when(F.upper(text).isin(*sorted(set(STATES.values()))), F.upper(text))
        return F.when(~blank_text(F.lower(text)), F.coalesce(code, _lookup(STATES, F.rtrim(F.lower(text), F.lit(".")))))

    return bind(clean(raw), read)


def norm_country(raw: Column) -> Column:
    """Two letters as they are in capitals, else the code of a known name, else null."""
    text = clean(raw)
    return F.when(~is_blank(raw), F.when(text.rlike("^[A-Za-z]{2}$"), F.upper(text)).otherwise(_lookup(COUNTRIES, F.lower(text))))


def norm_choice(raw: Column, allowed: list[str]) -> Column:
    """One of ``allowed``, white space and hyphens as underscores, else null."""
    text = F.translate(F.lower(clean(raw)), " -", "__")
    return F.when(~is_blank(raw) & text.isin(*allowed), text)


def norm_url(raw: Column) -> Column:
    """An absolute http or https address, else null."""
    text = clean(raw)
    host = F.regexp_extract(text, r"(?i)^https?://(\S+)$", 1)
    return F.when(~is_blank(raw) & (F.length(host) > 1) & ~F.left(host, F.lit(1)).isin(*"/$.?#"), text)


def soft(raw: Column, value: Column, field: str) -> Column:
    """``struct<value, warning>``: a text that isn't blank and that the normaliser can't read leaves a warning."""
    lost = ~is_blank(raw) & value.isNull()
    return F.struct(value.alias("value"), F.when(lost, F.concat(F.lit(f"{field}: can't read '"), raw, F.lit("'"))).alias("warning"))


def host_of(url: Column) -> Column:
    host = F.substring_index(F.regexp_extract(url, r"^(?:[^/]*//)?([^/?#]*)", 1), "@", -1)
    return F.lower(F.substring_index(host, ":", 1))


def source_type(url: Column, operators: list[str] = ()) -> Column:
    """How much an address says about its publisher: operators' own and filings first, then governments, trade press, the rest.

    ``operators`` are hosts of first parties; a newsroom below one counts as its own.
    """
    host = host_of(url)
    bare = F.regexp_replace(host, r"^www\.", "")
    label, parent = F.substring_index(bare, ".", 1), F.regexp_extract(bare, r"^[^.]*\.(.+)$", 1)
    under = lambda domain: (host == domain) | host.endswith(f".{domain}")
    filing = (bare.isin(*operators) | (parent.isin(*operators) & label.isin(*NEWSROOMS)) if operators else F.lit(False)) | under("sec.gov")
    last = F.substring_index(host, ".", -1)
    return (
        F.when(filing, "company_filing").when(last.isin("gov", "mil") | host.rlike(r"\.state\.[a-z]{2}\.us$"), "government_doc")
        .when((last == "com") & F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(*TRADE_PRESS), "trade_press").otherwise("general_media")
    )


def is_generation(label: Column, parent: Column) -> Column:
    """Whether a tranche's label or its parent's has a word for generation or grid plant."""
    words = F.transform(F.split(F.lower(F.concat_ws(" ", label, parent)), r"\s+"), lambda w: F.trim(w, F.lit(".,()")))
    return F.arrays_overlap(words, F.array(*map(F.lit, GENERATION)))


def names_in(cell: Column) -> Column:
    """The distinct names of a comma-separated cell, trimmed; none for null."""
    names = F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def canonical_list(names: Column, order: list[str]) -> Column:
    """Names in a fixed order as a cell; those that the order lacks go."""
    return F.concat_ws(",", F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(names, x)))


def reason_of(notes: Column, field: Column) -> Column:
    """What a JSON object of strings says of a field; null if it says nothing or is malformed."""
    return F.try_element_at(F.from_json(notes, "map<string,string>"), field)


def quote_of(quotes: Column, field: Column, excerpt: Column) -> Column:
    """``struct<quote, exact>``: the field's own quote, else the excerpt."""
    own = F.nullif(F.trim(reason_of(quotes, field)), F.lit(""))
    return F.struct(F.coalesce(own, excerpt).alias("quote"), own.isNotNull().alias("exact"))


def label_megawatts(label: Column) -> Column:
    """Megawatts that a label states, null if none."""
    figure = F.replace(F.regexp_extract(label, r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(mw|gw)\b", 1), F.lit(","), F.lit("")).try_cast("double")
    return figure * F.when(F.lower(F.regexp_extract(label, r"(?i)\d\s*(mw|gw)\b", 1)) == "gw", 1000.0).otherwise(1.0)


def dollars(usd: Column) -> Column:
    """Billions or millions with a sign, null for null."""
    scaled = F.when(usd >= 1e9, F.concat(F.format_number(usd / 1e9, 1), F.lit("B"))).otherwise(F.concat(F.format_number(usd / 1e6, 0), F.lit("M")))
    return F.concat(F.lit("$"), scaled)


@F.pandas_udf(StringType())
def demojibake(texts: pd.Series) -> pd.Series:
    """Undoes UTF-8 that was read as Windows-1252 and written again; leaves what doesn't decode.

    Spark's decoders replace what they can't read, so they can't tell.
    """

    def mend(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        try:
            return text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return text

    return texts.map(mend)
