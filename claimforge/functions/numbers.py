"""Numbers as people write them: power, money, coordinates; each with a disclosure of what was assumed."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for no value.
NULL_TOKENS = (
    "", "-", "--", "---", "?", "n/a", "n.a.", "na", "none", "null", "nil", "nan", "tbd", "tba", "unknown", "undisclosed",
    "not disclosed", "not available", "not stated", "not specified", "unspecified", "pending", "placeholder", "n.d.",
    "to be determined", "to be announced", "to be confirmed", "not yet determined", "not yet announced",
    "not yet disclosed", "not yet known", "coming soon", "forthcoming",
)
#: Words that begin a placeholder, and marks of which it may consist.
PLACEHOLDER_WORDS = ("tbd", "tba")
PLACEHOLDER_MARKS = (".", "?", "x", "_")
#: Megawatts of a unit, dollars of a scale word.
POWER_UNITS = {
    "": 1.0, "mw": 1.0, "megawatt": 1.0, "megawatts": 1.0, "mws": 1.0, "gw": 1000.0, "gigawatt": 1000.0, "gigawatts": 1000.0,
    "gws": 1000.0, "kw": 0.001, "kilowatt": 0.001, "kilowatts": 0.001,
}
MONEY_SCALES = {
    "": 1e0, "k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9,
    "t": 1e12, "tn": 1e12, "trillion": 1e12,
}
#: Words before a figure that make it approximate, and words of a currency.
APPROXIMATE = ("about", "approx", "approximately", "around", "nearly", "up to", "over", "more than", "at least", "almost")
CURRENCY = ("us", "usd", "dollar", "dollars")


def clean(raw: Column) -> Column:
    """Dashes to hyphens, white space to one space, trimmed. Compatibility forms are left to ``text.nfkc``."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, "[–—−]", "-"), r"[\s ]+", " "))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it: a lambda's variable, not a copy of its expression."""
    return F.transform(F.array(value), use)[0]


def is_blank(raw: Column) -> Column:
    """Null, a token for no value, or a placeholder."""
    return raw.isNull() | bind(F.lower(clean(raw)), blank_text)


def blank_text(text: Column) -> Column:
    """The same of a cleaned text in lower case."""
    word = F.regexp_extract(F.ltrim(F.replace(text, F.lit("$"), F.lit(" "))), r"^\w+", 0)
    filler = text.rlike("^(?:" + "|".join(re.escape(mark) + "{2,}" for mark in PLACEHOLDER_MARKS) + r")\z")
    return text.isNull() | text.isin(*NULL_TOKENS) | word.isin(*PLACEHOLDER_WORDS, "placeholder") | filler


def _unhedged(text: Column) -> Column:
    """A text without a sign or words in front that make its figure approximate."""
    def without(plain: Column) -> Column:
        found = plain
        for n in (1, 2):  # words
            lead = F.substring_index(plain, " ", n)
            hedge = [x for x in APPROXIMATE if x.count(" ") == n - 1]
            found = F.when(F.lower(lead).isin(*hedge), F.ltrim(F.substr(plain, F.length(lead) + 1))).otherwise(found)
        return found

    return bind(F.ltrim(F.regexp_replace(text, "^~", "")), without)


def _factor(unit: Column, table: dict[str, float]) -> Column:
    """The unit's factor, null for an unknown unit."""
    found = F.lit(None).cast("double")
    for value in sorted(set(table.values())):
        found = F.when(unit.isin(*[k for k, v in table.items() if v == value]), F.lit(value)).otherwise(found)
    return found


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, ",", "").try_cast("double")


#: Words between the ends of a range.
BETWEEN = ("to", "through", "thru")


def _figures(text: Column) -> Column:
    """``struct<single, ranged, low, low_unit, unit>``: whether a text is a figure or a range, its (lower) number, and units as words.

    Words are read one by one: a number, perhaps a unit, for a range a word between and the same again.  Nothing else may stand there.
    """
    apart = F.regexp_replace(F.lower(text), r"(?<=[\d.,])(?=[a-z])|(?<=[a-z])(?=\d)", " ")
    words = F.filter(F.split(F.replace(apart, F.lit("-"), F.lit(" to ")), " "), lambda w: w != "")

    def read(w: Column) -> Column:
        n = F.size(w)
        at = F.array_position(F.transform(w, lambda x: x.isin(*BETWEEN)), True).cast("int")
        item = lambda k: F.coalesce(F.get(w, k), F.lit(""))
        unit = lambda x: x.rlike("^[a-z]*$")
        low_unit, high_unit = F.when(at == 3, item(F.lit(1))).otherwise(""), item(at + 1)
        ranged = at.isin(2, 3) & (n - at).isin(1, 2) & item(F.lit(0)).rlike("^[0-9.,]+$") & item(at).rlike("^[0-9.,]+$") & unit(low_unit) & unit(high_unit)
        number = F.when(n == 1, F.regexp_replace(item(F.lit(0)), r"\.$", "")).otherwise(item(F.lit(0)))
        own_unit = F.regexp_replace(item(F.lit(1)), r"\.$", "")
        single = (at == 0) & n.isin(1, 2) & number.rlike(r"^[0-9,]+(\.[0-9]+)?$") & unit(own_unit)
        return F.struct(single.alias("single"), ranged.alias("ranged"), number.alias("low"), low_unit.alias("low_unit"), F.when(ranged, high_unit).otherwise(own_unit).alias("unit"))

    return F.transform(F.array(words), read)[0]


def norm_mw(raw: Column) -> Column:
    """``struct<value double, note string>``: megawatts; a range gives its lower bound; null if unreadable.

    The note tells ``range`` or ``approximate``, else it is null.
    """

    def told(text: Column, plain: Column, f: Column) -> Column:
        ranged = f["ranged"] & (f["low_unit"] == "")
        value = F.when(~blank_text(F.lower(text)) & (ranged | f["single"]), _number(f["low"]) * _factor(f["unit"], POWER_UNITS))
        return bind(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), F.lit(None)).when(ranged, "range").when(plain != text, "approximate").alias("note")))

    return bind(clean(raw), lambda text: bind(_unhedged(text), lambda plain: bind(_figures(plain), lambda f: told(text, plain, f))))


def norm_money(raw: Column) -> Column:
    """``struct<value bigint, note string>``: whole dollars, by the rules of ``norm_mw``; a scale at either end of a range is both ends'."""

    def amount(plain: Column) -> Column:
        words = F.split(F.regexp_replace(plain, r"\$|(?<=[A-Za-z])(?=\d)", " "), " +")
        return F.trim(F.concat_ws(" ", F.filter(words, lambda w: ~F.lower(w).isin(*CURRENCY))))

    def told(text: Column, plain: Column, f: Column) -> Column:
        scale = F.when(f["ranged"] & (f["low_unit"] != ""), f["low_unit"]).otherwise(f["unit"])
        known = f["single"] | f["ranged"] & _factor(f["unit"], MONEY_SCALES).isNotNull()
        value = F.when(~blank_text(F.lower(text)) & known, _number(f["low"]) * _factor(scale, MONEY_SCALES)).cast("long")
        return bind(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), F.lit(None)).when(f["ranged"], "range").when(plain != text, "approximate").alias("note")))

    return bind(clean(raw), lambda text: bind(_unhedged(text), lambda plain: bind(_figures(amount(plain)), lambda f: told(text, plain, f))))


def norm_coord(raw: Column, most: float) -> Column:
    """A coordinate within plus or minus ``most``, else null."""
    value = clean(raw).try_cast("double")
    return F.when(~is_blank(raw) & value.between(-most, most), value)


def values_conflict(a: Column, b: Column, tolerance: float = 0.2) -> Column:
    """Numbers that differ by over ``tolerance`` of the larger; a null or two zeros never conflict."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.coalesce((a != b) & (scale > 0) & (F.abs(a - b) > scale * F.lit(tolerance)), F.lit(False))


def h200_equivalent(mw: Column, kilowatts: float = 1.3) -> Column:
    """Accelerators that a capacity runs, to two significant figures, half to even."""
    count = mw * 1000 / F.lit(kilowatts)
    step = F.pow(F.lit(10.0), F.floor(F.log10(count)) - 1)
    return F.when(mw > 0, (F.bround(count / step) * step).cast("long"))


def km_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
