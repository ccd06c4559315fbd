"""Where things stand in a text: figures and the hedges before them, the sentence around a quote, the part that it names."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from claimforge.functions.numbers import bind
from claimforge.operators.evidence import sentences
from claimforge.operators.gates import BOUNDS, DEFAULTS
from claimforge.operators.tranches import ORDINALS, segments

#: How far before a figure its hedge may end, and which kinds of hedge tell more: a direction more than imprecision.
WINDOW = 32
PRECEDENCE = {"approximate": 0, "at_least": 1, "at_most": 1}

_ALIKE = str.maketrans("‘’“”–—−", "''\"\"---")


def spellings(value: Column) -> Column:
    """How a sentence may write a positive number: 1200 as 1,200, 1200 or 1.2; others have no spelling."""
    shown = lambda x: F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", "")
    whole = F.floor(value)
    comma = lambda x: F.format_number(x, 0)
    scaled = [F.when((value / n >= 0.1) & (value / n < 1000), shown(value / n)) for n in (1e3, 1e6, 1e9)]
    fraction = F.when(value != whole, F.concat(comma(whole), F.regexp_extract(shown(value), r"(\..*)$", 1)))
    found = F.array_distinct(F.array_compact(F.array(comma(whole), whole.cast("string"), shown(value), fraction, *scaled)))
    return F.when(value > 0, found).otherwise(F.array().cast("array<string>"))


def _starts(text: Column, needles: Column) -> Column:
    """``array<int>`` of the letters before each place, but the first letter, where one of ``needles`` begins; overlapping ones too.

    A text is cut ahead of every such place by one pattern, so the places are sums of the pieces' lengths.
    """
    ahead = F.concat(F.lit("(?="), F.array_join(F.transform(needles, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|"), F.lit(")"))
    lengths = F.transform(F.split(text, ahead, -1), lambda piece: F.length(piece))
    step = lambda at, n: F.concat(at, F.array(n + F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0))))
    return F.when(F.size(needles) > 0, bind(F.aggregate(lengths, F.array().cast("array<int>"), step), lambda at: F.slice(at, 1, F.size(at) - 1)))


def bound(quote: Column, value: Column, window: int = WINDOW) -> Column:
    """The bound that a quote puts on a figure: of the hedges that end shortly before it the one that tells most, then the nearest.

    A quote without the figure, and one that hedges it not, says ``exact``: each figure of a sentence has its own hedge.  Only the
    letters before a figure are searched, for the last of each hedge in them.
    """
    reach = window + max(len(mark) for marks in BOUNDS.values() for mark in marks)

    def told(lead: Column) -> Column:
        gap = lambda mark: F.when(F.contains(lead, F.lit(mark)), F.length(F.substring_index(lead, mark, -1)))
        return F.array(*[F.struct(F.lit(-PRECEDENCE[name]).alias("rank"), F.least(*map(gap, marks)).alias("gap"), F.lit(name).alias("bound")) for name, marks in BOUNDS.items()])

    def found(x: Column) -> Column:
        leads = F.transform(_starts(x["text"], x["needles"]), lambda f: F.substr(x["text"], F.greatest(f - reach, F.lit(0)) + 1, F.least(f, F.lit(reach))))
        return F.array_min(F.filter(F.flatten(F.transform(leads, told)), lambda t: t["gap"] <= window))["bound"]

    best = bind(F.struct(F.lower(F.coalesce(quote, F.lit(""))).alias("text"), bind(value, spellings).alias("needles")), found)
    return F.coalesce(best, F.lit(DEFAULTS["bound"]))


def sentence_of(quote: str | None, article: str | None) -> str | None:
    """The article's whole sentence around a quote, from the stop or empty line before it to the stop after it; else the quote."""
    said = " ".join((quote or "").lower().translate(_ALIKE).split())
    words = [(m[0], m.start()) for m in re.finditer(r"\S+", article or "")]
    folded, at = [], []
    for word, start in words:
        low = (word.lower() if len(word.lower()) == len(word) else word).translate(_ALIKE)
        folded.append(low)
        at += range(start, start + len(low) + 1)
    found = " ".join(folded).find(said) if said else -1
    if found < 0:
        return quote
    start, end = at[found], at[found + len(said) - 1] + 1
    begins, ends = sentences(article)
    before, after = bisect_right(begins, start), bisect_left(ends, end)
    return article[begins[before - 1] if before else 0:ends[after] if after < len(ends) else len(article)].strip()


def names_part(label: str | None, parent: str | None, sentence: str | None) -> bool:
    """Whether a sentence names a part of a campus: the word of one of its (or its parent's) segments and, if numbered, the number in any form."""
    words = set(re.findall(r"[a-z0-9]+", (sentence or "").lower()))
    for part in segments(label) + segments(parent):
        word, _, number = part.rpartition("-") if "-" in part else (part, "", "")
        forms = {number} | {form for form, n in ORDINALS.items() if n == number} | {f"{number}{end}" for end in ("st", "nd", "rd", "th")} if number else set()
        if word in words and (not number or forms & words):
            return True
    return False


@F.pandas_udf(StringType())
def sentence_around(quotes: pd.Series, articles: pd.Series) -> pd.Series:
    return pd.Series([sentence_of(q, a) for q, a in zip(quotes, articles)], dtype=object)


@F.pandas_udf(BooleanType())
def quote_names_part(labels: pd.Series, parents: pd.Series, sentences_: pd.Series) -> pd.Series:
    return pd.Series([names_part(*x) for x in zip(labels, parents, sentences_)])
