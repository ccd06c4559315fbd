"""Gates on the wording of quotes: a qualifier, a milestone or an obstacle counts only if its quote says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimforge.operators.evidence import fold

#: What each axis of a claim takes by default, and wording that licenses its other values.
DEFAULTS = {"bound": "exact", "modality": "planned", "scope": "unnamed"}
#: A scope that needs no wording: the figure is of the campus that the record is about.
THIS_SITE = "this_site"
SCOPES = {
    "programme": ["programme", "program", "across all", "in total", "nationwide", "overall"],
    "region": ["to the region", "regional", "local economy", "statewide", "in the state", "county"],
    "portfolio": ["portfolio", "its data centers", "all of its", "company-wide", "fleet"],
}
BOUNDS = {
    "approximate": ["about ", "approximately", "roughly", "around ", "~", "some ", "nearly", "circa", "estimated", "an estimated", "close to", "almost"],
    "at_least": ["more than", "at least", "over ", "upwards of", "north of", "in excess of", "+"],
    "at_most": ["up to", "as much as", "no more than", "at most", "maximum"],
}
MODALITIES = {
    "achieved": ["came online", "went live", "has begun", "began ", "broke ground", "completed", "opened", "is now", "has been", "energized", "energised", "delivered", "started"],
    "contracted": ["signed", "has agreed", "agreement", "filed an application", "contract", "committed", "approved", "secured", "entered into"],
    "targeted": ["targeted", "target", "aims to", "hopes to", "goal of", "by the end of"],
    "speculated": ["reports have", "reportedly", "could ", "may ", "might ", "potential", "expected to grow", "possible", "rumou", "unconfirmed"],
}
#: Wording of a plan, which records nothing done.
PLANNED = [
    "expected to", "is expected", "are expected", "expects to", "scheduled to", "scheduled for", "is scheduled", "targeted for", "targeting", "will begin", "will start",
    "will be", "plans to", "planned for", "aims to", "set to", "due to begin", "once operational", "when complete", "upon completion", "would be", "could be",
]


def says_any(quote: Column, marks: list[str]) -> Column:
    said = fold(F.coalesce(quote, F.lit("")))
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(said, m))


def licensed(value: Column, quote: Column, axis: str, markers: dict[str, list[str]]) -> Column:
    """``value`` if it is the axis's default or the quote has wording for it, else the default."""
    found = F.lit(DEFAULTS[axis])
    for name, marks in markers.items():
        found = F.when((value == name) & says_any(quote, marks), name).otherwise(found)
    return found


def axes(scope: Column, bound: Column, modality: Column, as_of: Column, quote: Column, today: Column, blocks: Column) -> Column:
    """``struct<scope, bound, modality, as_of>``: each axis falls back to its default; the figure isn't touched.

    A scope ``block:label`` stands if the label is among ``blocks``, ``this_site`` always; what is dated ahead isn't achieved, but targeted.
    """
    label = F.lower(F.trim(F.regexp_extract(scope, "^block:(.*)$", 1)))
    day = as_of.try_cast("date")
    of_block = scope.startswith("block:")
    return F.struct(
        F.when(of_block, F.when((label != "") & F.array_contains(blocks, label), scope).otherwise(DEFAULTS["scope"])).when(scope == THIS_SITE, THIS_SITE).otherwise(licensed(scope, quote, "scope", SCOPES)).alias("scope"),
        licensed(bound, quote, "bound", BOUNDS).alias("bound"),
        F.when((modality == "achieved") & (day > today), "targeted").otherwise(licensed(modality, quote, "modality", MODALITIES)).alias("modality"), day.alias("as_of"))


def records_the_past(quote: Column) -> Column:
    """Whether a quote tells what happened: it has none of the wording of plans."""
    return ~says_any(quote, PLANNED)


def supports_risk(category: Column, quote: Column, wording: dict[str, list[str]]) -> Column:
    """Whether a quote has wording for the obstacle it is filed under; a category without wording has no support."""
    found = F.lit(False)
    for name, marks in wording.items():
        found = F.when(category == name, says_any(quote, marks)).otherwise(found)
    return found
