"""Typed records from a model's replies: projects, obstacles and tranches, each value with what its article says for it.

A reply is parsed as a variant, so fields may have any type or be missing.  A value that no quote of the article states
is kept with the reason, never dropped; so is a figure that can't be this site's.  Records without an identity are refused.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from claimforge.functions import codes, dates, numbers
from claimforge.functions.identity import looks_like_county
from claimforge.functions.text import looks_english, norm_phase
from claimforge.operators.evidence import dates_in, dollars_in, fold, megawatts_in, recover, reply_json, states_phase
from claimforge.operators.gates import supports_risk
from claimforge.operators.tranches import block_key

#: How many projects, obstacles and tranches of a reply count, dollars a megawatt beyond which money is a programme's.
PROJECTS, RISKS, BLOCKS, USD_PER_MW = 5, 6, 8, 50_000_000
#: Severities and statuses, and wording that a quote needs for each kind of obstacle.
SEVERITIES = ["watch", "material", "blocking"]
STATUSES = ["planned", "permitting", "under_construction", "shell_complete", "energized", "serving", "paused", "cancelled"]
RISK_WORDING = {
    "grid_capacity": ["grid capacity", "not enough power", "insufficient power", "capacity constraint", "power constraint", "curtail", "load growth", "cannot supply",
                      "energy shortfall", "queue position", "interconnection"],
    "transmission": ["transmission", "substation", "transmission line", "power line", "kilovolt", "kv line", "upgrade the grid", "grid upgrade", "interconnection", "energiz"],
    "permitting": ["permit", "zoning", "rezon", "entitlement", "approval", "variance", "moratorium", "special use", "planning commission", "board of supervisors", "council"],
    "environmental": ["environmental", "air quality", "air permit", "emissions", "wetland", "endangered", "impact statement", "epa", "pollution"],
    "equipment_supply": ["transformer", "switchgear", "chiller", "cooling equipment", "turbine", "generator", "lead time", "supply chain", "shortage", "backlog", "delivery"],
    "chip_supply": ["chip", "gpu", "accelerator", "semiconductor", "nvidia", "allocation", "silicon"],
    "financing": ["financ", "funding", "capital", "investor", "debt", "loan", "raise", "cost overrun", "budget"],
    "offtake": ["tenant", "customer", "lease", "leasing", "offtake", "pre-leas", "preleas", "commitment", "speculative", "unleased"],
    "community_opposition": ["opposition", "oppose", "resident", "neighbor", "neighbour", "lawsuit", "sued", "sue", "litigation", "referendum", "petition", "protest", "noise",
                             "backlash", "objection"],
    "water": ["water", "aquifer", "groundwater", "gallons", "cooling water", "drought", "wastewater", "discharge"],
}

@F.pandas_udf(ArrayType(StringType()))
def settle(quotes: pd.Series, article: pd.Series, folded: pd.Series) -> pd.Series:
    """Each quote as it may be stored: itself if the article holds it, else the article's words for what was copied, else null."""
    import re

    def alike(text: str) -> str:
        text = re.sub("[–—−]", "-", re.sub("[“”]", '"', re.sub("[‘’]", "'", text.lower())))
        return re.sub(r"\s+", " ", text).strip()

    def one(quote, text, hay):
        if not quote or not alike(quote) or hay is None:
            return None
        return quote.strip() if alike(quote) in hay else recover(quote, text)[0]

    return pd.Series([None if qs is None else [one(q, text, hay) for q in qs] for qs, text, hay in zip(quotes, article, folded)])


def _text(value: Column) -> Column:
    """Cleaned text, null if blank."""
    return numbers.bind(numbers.clean(value), lambda text: F.when(~numbers.blank_text(F.lower(text)), text))


def _at(variant: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(variant) if isinstance(variant, str) else variant, f"$.{path}", kind)


def _quotes(variant: Column | str) -> Column:
    """``array<struct<field, quote>>`` of the entries that are objects with a quote of their own; empty where there is no list."""
    entries = F.coalesce(_at(variant, "evidence", "array<variant>"), F.array().cast("array<variant>"))
    pairs = F.transform(entries, lambda e: F.struct(_at(e, "field").alias("field"), _at(e, "quote").alias("quote")))
    return F.filter(pairs, lambda e: F.trim(e["quote"]) != "")


def parsed(replies: DataFrame) -> DataFrame:
    """``url, place, raw, article``: one row per project of each reply; ``replies`` is ``url, reply, article``.

    Replies without a list of projects give none, nor do entries that aren't objects.
    """
    tree = replies.select("url", "article", F.try_parse_json(reply_json(F.col("reply"))).alias("tree"))
    listed = F.slice(F.coalesce(_at("tree", "projects", "array<variant>"), F.array().cast("array<variant>")), 1, PROJECTS)
    each = tree.select("url", "article", F.posexplode(listed).alias("place", "raw"))
    return each.where(F.schema_of_variant("raw").startswith("OBJECT")).select("url", "place", "raw", "article")


def _with_quotes(rows: DataFrame, variant: str) -> DataFrame:
    """``quotes array<struct<field, settled, folded, mw, usd, days>>`` of a variant's evidence, with all that each quote states."""
    rows = rows.withColumn("quotes", _quotes(variant))
    settled = settle(F.transform("quotes", lambda q: q["quote"]), F.col("article"), fold(F.col("article")))
    rows = rows.withColumn("settled", settled)
    return rows.withColumn("quotes", F.zip_with("quotes", "settled", lambda q, s: F.struct(
        q["field"].alias("field"), s.alias("settled"), fold(s).alias("folded"), megawatts_in(s).alias("mw"), dollars_in(s).alias("usd"), dates_in(s).alias("days")))).drop("settled")


def _number_in(name: str, value: Column):
    """Whether a quote's numbers of a kind hold a value."""
    return lambda q: F.exists(q[name], lambda v: F.abs(v - value) < 0.01)


def _support(field: str, states) -> Column:
    """``struct<quote, reason>``: the quote that states a value, its own if that does, and else why it is unconfirmed."""
    verified = F.filter("quotes", lambda q: q["settled"].isNotNull())
    own = F.filter(verified, lambda q: q["field"] == field)
    hits = F.filter(F.concat(F.slice(own, 1, 1), verified), lambda q: F.coalesce(states(q), F.lit(False)))
    quote = F.try_element_at(hits, F.lit(1))["settled"]
    labelled = F.exists("quotes", lambda q: (q["field"] == field) & q["settled"].isNull())
    reason = F.when(quote.isNotNull(), F.lit(None)).when(F.size(own) > 0, "quote_off_target").when(labelled, "quote_unverified").otherwise("no_quote")
    return F.struct(quote.alias("quote"), reason.alias("reason"))


def _says(value: Column):
    return lambda q: F.contains(q["folded"], fold(value))


def records(projects: DataFrame) -> DataFrame:
    """One row per project with an identity: values, ``quotes`` and ``reasons`` by field, ``notes`` on what was read how.

    ``projects`` comes from ``parsed``.  A county in the place of a city is one; without company, state and a city or county a row
    is no record (``refused`` has those).  Every value is there: the ones that no quote states have a reason, and so has money that
    no site of that capacity costs (``out_of_scale``).  ``blocker`` is not a claim, see ``obstacles``.
    """
    return _typed(projects).where("identified").drop("identified")


def refused(projects: DataFrame) -> DataFrame:
    """``url, place, company, state, city, county`` of the projects that nothing identifies."""
    return _typed(projects).where("not identified").select("url", "place", "company", "state", "city", "county")


def _typed(projects: DataFrame) -> DataFrame:
    told = ("name", "company", "customer", "city", "county", "state", "country", "mw_planned", "mw_built", "investment_usd", "phase", "first_announced", "expected_online", "notes")
    rows = _with_quotes(projects, "raw").select("url", "place", "quotes", *[_at("raw", k).alias(f"raw_{k}") for k in told])
    raw = lambda k: F.col(f"raw_{k}")
    rows = rows.select(
        "url", "place", "quotes", *[_text(raw(k)).alias(k) for k in ("name", "company", "customer", "city", "county")], codes.norm_state(raw("state")).alias("state"),
        F.coalesce(codes.norm_country(raw("country")), F.lit("US")).alias("country"), _text(raw("notes")).alias("summary"), norm_phase(raw("phase")).alias("phase"),
        *[numbers.norm_mw(raw(k)).alias(k) for k in ("mw_planned", "mw_built")], numbers.norm_money(raw("investment_usd")).alias("investment_usd"),
        *[dates.norm_date(raw(k)).alias(k) for k in ("first_announced", "expected_online")])
    in_county = F.coalesce(looks_like_county(F.col("city")), F.lit(False))
    rows = rows.withColumn("is_county", in_county).withColumn("county", F.when(F.col("is_county"), F.coalesce("county", "city")).otherwise(F.col("county")))
    rows = rows.withColumn("city", F.when(~F.col("is_county"), F.col("city"))).drop("is_county")
    number = lambda k: F.col(k)["value"]
    on_day = lambda k: (number(k), lambda q: F.array_contains(q["days"], number(k)))
    values = {
        "customer": (F.col("customer"), _says(F.col("customer"))), **{k: (number(k), _number_in("mw", number(k))) for k in ("mw_planned", "mw_built")},
        "investment_usd": (number("investment_usd"), _number_in("usd", number("investment_usd"))),
        "phase": (F.col("phase"), lambda q: looks_english(q["settled"]) & states_phase(q["settled"], F.col("phase"))), "first_announced": on_day("first_announced"), "expected_online": on_day("expected_online"),
    }
    rows = rows.withColumns({f"s_{k}": F.when(value.isNotNull(), _support(k, states)) for k, (value, states) in values.items()})
    money, mw = number("investment_usd"), number("mw_planned")
    huge = F.coalesce((mw > 0) & (money > 0) & (money / mw > USD_PER_MW), F.lit(False))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    as_map = lambda pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    reason = lambda k: F.when(huge, "out_of_scale").otherwise(F.col(f"s_{k}.reason")) if k == "investment_usd" else F.col(f"s_{k}.reason")
    notes = [F.concat(F.lit(f"{k}: "), F.col(k)["note"]) for k in ("mw_planned", "mw_built", "investment_usd")]
    notes += [F.when(F.col(k)["precision"] != "day", F.concat(F.lit(f"{k}: to the "), F.col(k)["precision"])) for k in ("first_announced", "expected_online")]
    notes += [F.when(huge, F.concat(F.lit("investment_usd: $"), (money / mw / 1e6).cast("long"), F.lit("M per MW"))), F.concat(F.lit("summary: "), F.col("summary"))]
    identified = F.col("company").isNotNull() & F.col("state").isNotNull() & (F.col("city").isNotNull() | F.col("county").isNotNull())
    return rows.select(
        "url", "place", F.coalesce("name", F.concat_ws(" ", "company", F.coalesce("city", "county"))).alias("name"), "company", "customer", "city", "county", "state", "country",
        *[number(k).alias(k) for k in ("mw_planned", "mw_built", "investment_usd")], "phase", *[number(k).alias(k) for k in ("first_announced", "expected_online")],
        as_map([entry(k, F.col(f"s_{k}.quote")) for k in values]).alias("quotes"), as_map([entry(k, reason(k)) for k in values]).alias("reasons"),
        F.array_compact(F.array(*notes)).alias("notes"), identified.alias("identified"))


def obstacles(projects: DataFrame) -> DataFrame:
    """``url, place, category, severity, summary, quote, unconfirmed, first_seen, delay_days``: what stands in a project's way.

    A kind that isn't known and one without a summary can't be kept; all others are, without the quote that failed and with the
    reason why.  Of two of one kind and date the first counts; of a project the first ``RISKS``.
    """
    listed = F.coalesce(_at("raw", "risks", "array<variant>"), F.array().cast("array<variant>"))
    rows = projects.select("url", "place", "article", F.posexplode(listed).alias("at", "risk"))
    rows = rows.select("url", "place", "at", "article", *[_at("risk", k).alias(k) for k in ("category", "severity", "summary", "quote", "first_seen", "delay_days")])
    rows = rows.withColumn("category", codes.norm_choice(F.col("category"), list(RISK_WORDING))).withColumn("summary", _text(F.col("summary"))).where("category is not null and summary is not null")
    rows = rows.withColumn("settled", settle(F.array("quote"), F.col("article"), fold(F.col("article")))[0])
    fits = supports_risk(F.col("category"), F.col("settled"), RISK_WORDING)
    why = F.when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no_quote").when(F.col("settled").isNull(), "quote_unverified").when(~fits, "quote_off_target")
    rows = rows.withColumn("unconfirmed", why).withColumn("first_seen", dates.norm_date(F.col("first_seen"))["value"])
    first = rows.groupBy("url", "place", "category", "first_seen").agg(F.min_by(F.struct("at", "severity", "summary", "settled", "unconfirmed", "delay_days"), "at").alias("r"))
    kept = first.groupBy("url", "place").agg(F.slice(F.array_sort(F.collect_list(F.struct("r.at", "category", "first_seen", "r"))), 1, RISKS).alias("all"))  # a reply's are few
    delay = F.col("x.r.delay_days").try_cast("int")
    return kept.select("url", "place", F.explode("all").alias("x")).select(
        "url", "place", "x.category", F.coalesce(codes.norm_choice(F.col("x.r.severity"), SEVERITIES), F.lit("watch")).alias("severity"), "x.r.summary",
        F.when(F.col("x.r.unconfirmed").isNull(), F.col("x.r.settled")).alias("quote"), "x.r.unconfirmed", "x.first_seen", F.when(delay >= 0, delay).alias("delay_days"))


def worst_obstacle(found: DataFrame) -> DataFrame:
    """``url, place, blocker, reason``: the obstacle that speaks for a project, confirmed ones first, then the most severe."""
    order = F.struct(F.col("unconfirmed").isNull(), F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.col("category"), F.col("summary"))
    return found.groupBy("url", "place").agg(F.max_by(F.struct("summary", "unconfirmed"), order).alias("w")).select("url", "place", F.col("w.summary").alias("blocker"), F.col("w.unconfirmed").alias("reason"))


def tranches(projects: DataFrame) -> DataFrame:
    """``url, place, block_key, label, parent, status, mw, investment_usd, energized_on, unconfirmed``: a campus's parts.

    A part's evidence is its own: only quotes filed with it count, and only if they name it.  Of two of one key the first counts; of
    a project the first ``BLOCKS`` entries.  ``unconfirmed`` maps the values without such a quote to the reason.
    """
    listed = F.slice(F.coalesce(_at("raw", "blocks", "array<variant>"), F.array().cast("array<variant>")), 1, BLOCKS)
    rows = _with_quotes(projects.select("url", "place", "article", F.posexplode(listed).alias("at", "block")), "block")
    rows = rows.select("url", "place", "at", "quotes", *[_text(_at("block", k)).alias(k) for k in ("label", "parent")], codes.norm_choice(_at("block", "status"), STATUSES).alias("status"),
                       numbers.norm_mw(_at("block", "mw"))["value"].alias("mw"), numbers.norm_money(_at("block", "investment_usd"))["value"].alias("investment_usd"),
                       dates.norm_date(_at("block", "energized_on"))["value"].alias("energized_on")).where("label is not null")
    rows = rows.withColumn("block_key", block_key(F.col("label"), F.col("parent")))
    first = rows.groupBy("url", "place", "block_key").agg(F.min_by(F.struct("quotes", "label", "parent", "status", "mw", "investment_usd", "energized_on"), "at").alias("b")).select("url", "place", "block_key", "b.*")
    names_it = lambda q: F.contains(fold(q), fold(F.col("label")))
    states = {"mw": _number_in("mw", F.col("mw")), "investment_usd": _number_in("usd", F.col("investment_usd")), "energized_on": lambda q: F.array_contains(q["days"], F.col("energized_on"))}
    first = first.withColumns({f"s_{k}": F.when(F.col(k).isNotNull(), _support(k, f)) for k, f in states.items()})
    reason = lambda k: F.when(F.col(f"s_{k}.quote").isNotNull() & ~names_it(F.col(f"s_{k}.quote")), "quote_off_target").otherwise(F.col(f"s_{k}.reason"))
    why = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), reason(k).alias("value")) for k in states]), lambda p: p["value"].isNotNull()))
    return first.select("url", "place", "block_key", "label", "parent", F.coalesce("status", F.lit("planned")).alias("status"), *states, why.alias("unconfirmed"))
