"""Dates as people write them, with the precision that they state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimforge.functions.numbers import bind, blank_text, clean

#: The months.
MONTHS = "january february march april may june july august september october november december".split()
#: The quarter that a word before a year stands for, and words that hedge a year.
QUALIFIERS = {
    "early": 1, "beginning": 1, "start": 1, "spring": 2, "mid": 3, "middle": 3, "summer": 3, "late": 4, "end": 4, "fall": 4, "autumn": 4, "winter": 4,
}
HEDGES = ("by", "around", "circa", "approx", "approximately", "roughly", "sometime in", "in or around")


#: What may stand beside a year, and the month in which the period that it names begins.
_MONTHS = {name: k for k, full in enumerate(MONTHS, 1) for name in (full, full[:3])} | {"sept": 9}
_QUARTERS = {f"q{k}": 3 * k - 2 for k in range(1, 5)}
_SEASONS = {word: 3 * k - 2 for word, k in QUALIFIERS.items()}
_HALVES = {"h1": 1, "h2": 7, "first half": 1, "second half": 7}
_YEARS = dict.fromkeys(("", *HEDGES), 1)
#: The same by precision, and whether the year has to be a recent one at the end (months: at the end).
_PERIODS = ((_QUARTERS, "quarter", "any"), (_MONTHS, "month", "end"), (_SEASONS, "quarter", "recent"), (_HALVES, "half", "recent"), (_YEARS, "year", "recent"))


def _named(name: Column) -> Column:
    """``struct<month, precision, fits>`` of a period's name, null if it is none; the literal map is constant-folded."""
    entry = lambda month, precision, fits: F.struct(F.lit(month).alias("month"), F.lit(precision).alias("precision"), F.lit(fits).alias("fits"))
    entries = [x for table, precision, fits in _PERIODS for key, month in table.items() for x in (F.lit(key), entry(month, precision, fits))]
    return F.try_element_at(F.create_map(*entries), name)


def _month(word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for entry in _MONTHS.items() for x in entry]), word)


def norm_date(raw: Column) -> Column:
    """``struct<value date, precision string>``; both null if blank, without a year, or unreadable.

    Precisions: day, month, quarter, half, year; the value is the first day of the period.  The text is cut into
    words.  All figures: year, month and day by their order and mark.  A year of four digits at an end: what
    stands beside it is looked up as the name of a period, or is a month and a day.

    Each step is bound before the next one uses it, so the expression stays as long as it is written here.
    """
    item = lambda words, k: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit(""))
    figures = lambda word, *lengths: F.length(word).isin(*lengths) & word.rlike(r"^\d+$")
    # what a text is read as: year, month, day, precision; all null if nothing holds
    read = lambda year, month, day, precision: F.struct(year.alias("year"), month.cast("string").alias("month"), day.alias("day"), precision.alias("precision"))
    one = F.lit("1")

    def short(text: Column) -> Column:
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[t ]"), F.left(text, F.lit(10))).otherwise(text)

    def in_figures(text: Column) -> Column:
        parts = F.split(text, "[-/]")
        cut = F.struct(F.regexp_replace(text, "[^-/]", "").alias("mark"), *[item(parts, k).alias(name) for k, name in enumerate("abc", 1)])
        return bind(cut, of_figures)

    def of_figures(p: Column) -> Column:
        mark, a, b, c = (p[x] for x in ("mark", *"abc"))
        late = c.try_cast("int")  # of two digits, 69 is 2069 and 70 is 1970
        late = late + F.when(F.length(c) == 4, 0).when(late < 70, 2000).otherwise(1900)
        return (
            F.when((mark == "--") & figures(a, 4) & figures(b, 2) & figures(c, 2), read(a, b, c, F.lit("day")))
            .when((mark == "//") & figures(a, 1, 2) & figures(b, 1, 2) & figures(c, 2, 4), read(late.cast("string"), a, b, F.lit("day")))
            .when(mark.isin("-", "/") & figures(a, 4) & figures(b, 1, 2), read(a, b, one, F.lit("month"))))

    def in_words(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text, r"[.,]+(?=\s|$)|-", " "), r"^(\d{4})(?=q\d$)", "$1 ")
        return bind(F.filter(F.split(plain, " "), lambda w: ~w.isin("", "of")), of_words)

    def of_words(words: Column) -> Column:
        ends = F.struct(item(words, 1).alias("first"), item(words, -1).alias("last"))
        return bind(bind(ends, lambda e: F.struct(
            figures(e["last"], 4).alias("at_end"), F.when(figures(e["last"], 4), e["last"]).when(figures(e["first"], 4), e["first"]).alias("year"))), lambda y: F.when(y["year"].isNotNull(), bind(
                F.when(y["at_end"], F.slice(words, 1, F.size(words) - 1)).otherwise(F.slice(words, 2, F.size(words))), lambda beside: around(y, beside))))

    def around(y: Column, beside: Column) -> Column:
        pair = F.struct(item(beside, 1).alias("x"), item(beside, 2).alias("y"))
        told = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _month(p["x"]).alias("month_x"), _month(p["y"]).alias("month_y"))
        with_day = F.when(y["at_end"] & (F.size(beside) == 2), bind(bind(pair, told), lambda t: (
            F.when(t["month_x"].isNotNull() & figures(t["y"], 1, 2), read(y["year"], t["month_x"], t["y"], F.lit("day")))
            .when(t["month_y"].isNotNull() & figures(t["x"], 1, 2), read(y["year"], F.coalesce(t["month_x"], t["month_y"]), t["x"], F.lit("day"))))))
        return F.coalesce(with_day, bind(_named(F.concat_ws(" ", beside)), lambda n: F.when(
            n.isNotNull() & ((n["fits"] == "any") | y["at_end"] & ((n["fits"] == "end") | y["year"].rlike("^(19|20)"))), read(y["year"], n["month"], one, n["precision"]))))

    def dated(found: Column) -> Column:
        date = F.concat_ws("-", F.lpad(found["year"], 4, "0"), F.lpad(found["month"], 2, "0"), F.lpad(found["day"], 2, "0")).try_cast("date")
        return bind(F.when(found.isNotNull(), date), lambda value: F.struct(value.alias("value"), F.when(value.isNotNull(), found["precision"]).alias("precision")))

    def unless_blank(text: Column) -> Column:
        return F.when(~blank_text(text), bind(short(text), lambda t: F.coalesce(in_figures(t), in_words(t))))

    return bind(bind(F.lower(clean(raw)), unless_blank), dated)
