"""Text: folding, phases, keyword tiers, HTML, scores of paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimforge.functions.numbers import bind

#: Phases in order, the terminal ones, and words for them.
PHASES = ("announced", "permitting", "construction", "operational")
TERMINAL = ("paused", "cancelled")
PHASE_WORDS = {
    "announced": "announced announce proposed proposal planned plan planning pre-construction preconstruction plans announcement".split() + ["early stage"],
    "permitting": "permitting permit permits zoning rezoning approval approved application active approvals".split() + ["permit filed", "permit review", "under review", "in review", "under study"],
    "construction": "construction constructing building built groundbreaking".split() + ["under construction", "broke ground", "in progress", "engineering and procurement", "partially in service - under construction"],
    "operational": "operational operating operation online in-service live energized complete completed commissioned done operations".split() + ["in operation", "in service"],
    "paused": "paused pause hold suspended halted stalled shelved".split() + ["on hold"],
    "cancelled": "cancelled canceled cancel withdrawn retracted abandoned scrapped terminated deactivated dead cancellation".split(),
}


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def norm_phase(raw: Column) -> Column:
    """The phase a text names: exactly, else by the words in it, terminal ones and long ones first; else null."""
    words = sorted(((w, p) for p, ws in PHASE_WORDS.items() for w in ws), key=lambda x: (x[1] not in TERMINAL, -len(x[0]), x[0]))

    def read(text: Column) -> Column:
        exact = F.lit(None).cast("string")
        for phase, names in PHASE_WORDS.items():
            exact = F.when(text.isin(*names), phase).otherwise(exact)
        inside = F.lit(None).cast("string")
        for word, phase in reversed(words):
            inside = F.when(text.rlike(r"\b" + word.replace("-", r"\-") + r"\b"), phase).otherwise(inside)
        return F.coalesce(exact, inside)

    return bind(F.lower(F.trim(F.regexp_replace(raw, r"\s+", " "))), read)


def haystack(text: Column) -> Column:
    """Lower case, marks to spaces, with a space at both ends so that terms match whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9$]+", " ")), F.lit(" "))


def first_term(hay: Column, terms: list[str]) -> Column:
    """The first of ``terms`` in the text, or null."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, F.concat(F.lit(" "), t, F.lit(" ")))), F.lit(1))


def keyword_filter(text: Column, exclude: list[str], topic: list[str], signal: list[str], risk: list[str], topic_implied: bool = False) -> Column:
    """``struct<keep boolean, reason string>``: an excluded term drops; a topic and a signal or risk keep."""
    def decide(found: Column) -> Column:
        out, sign, danger = found["out"], found["sign"], found["danger"]
        on_topic = F.lit(True) if topic_implied else found["about"].isNotNull()
        keep = out.isNull() & on_topic & (sign.isNotNull() | danger.isNotNull())
        reason = (
            F.when(out.isNotNull(), F.concat(F.lit("excluded: "), out)).when(~on_topic, "no topic")
            .when(sign.isNotNull(), F.concat(F.lit("signal: "), sign)).when(danger.isNotNull(), F.concat(F.lit("risk: "), danger)).otherwise("no signal")
        )
        return F.struct(keep.alias("keep"), reason.alias("reason"))

    def look(hay: Column) -> Column:
        tiers = {"out": exclude, "about": topic, "sign": signal, "danger": risk}
        return F.struct(*[first_term(hay, terms).alias(name) for name, terms in tiers.items()])

    # lambdas bind the folded text and what is found in it, so neither is worked out twice
    return F.transform(F.transform(F.array(haystack(text)), look), decide)[0]


def html_to_text(html: Column) -> Column:
    """Tags, comments and chrome off; block tags to line breaks; the common character references decoded.

    Expressions of the JVM only; see the training-data operators for a full extractor.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "nav", "footer", "header", "aside", "form"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|section|article)>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def truncate_head_tail(text: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """Whole if it fits; else 70 per cent head, the marker, and the tail, ``most`` characters in all."""
    room = most - len(marker)
    head = int(room * 0.7)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(room - head))))


def prose_length(text: Column, least: int = 60) -> Column:
    """Characters in lines of ``least`` or more."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.length(F.trim(x)))
    return F.aggregate(F.filter(lines, lambda n: n >= least), F.lit(0).cast("long"), lambda a, n: a + n)


def looks_english(text: Column) -> Column:
    """Ideographs, kana and hangul are a tenth of the letters at most; true without letters."""
    foreign = F.regexp_count(text, F.lit(r"[一-鿿぀-ヿ가-힯]"))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce((letters == 0) | (foreign <= 0.1 * letters), F.lit(True))


def count_terms(text: Column, terms: dict[str, float]) -> Column:
    """Weights of terms: the first hit in full, each more at three tenths."""
    total = F.lit(0.0)
    for term, weight in terms.items():
        n = F.regexp_count(F.lower(text), F.lit(rf"\b{term}\b"))
        total = total + F.when(n > 0, F.lit(float(weight)) * (1 + 0.3 * (n - 1))).otherwise(0.0)
    return total


def score_paragraph(text: Column, terms: dict[str, float], noise: str | None = None) -> Column:
    """Weighted hits, a share of it for noise, per 800 characters."""
    score = count_terms(text, terms)
    if noise:
        score = F.when(F.lower(text).rlike(noise), score * 0.15).otherwise(score)
    return score / F.greatest(F.lit(1.0), F.length(text) / 800)
