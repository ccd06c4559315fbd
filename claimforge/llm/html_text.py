"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides what it can by link density,
length and stop-word density, and by the containers a block is in: one made of links, or within a menu,
footer, advert, form and the like, whose prose no density tells from an article's, is boilerplate; a long
block with many stop words is text.  The second pass gives what is left, the short and the unclear, the
label of the nearest decided neighbours; within an article they are its text.  Blocks of text are joined in
page order; none is cut or left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für im ist mit nach nicht sich sie sind über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils la le les leur lui mais ne nous ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella era es esta este fue ha la las lo los más no o para pero por que se sin sobre su sus un una y".split()
)
#: Elements whose content isn't text, elements that end a block, elements without an end tag.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id and role that name boilerplate.
BAD_TAGS = frozenset("nav footer aside form button select option label fieldset menu dialog head".split())
BAD_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement adverts banner breadcrumb breadcrumbs captcha comment commentlist comments complementary consent contentinfo "
    "cookie cookies copyright dialog disqus dropdown foot footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination pager paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signin signup "
    "sitenav skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar topbar trending warning widget".split()
)
#: Words of a class that tell how a page is laid out ("has-sidebar", "no-header"), not what an element is.
LAYOUT = frozenset("has is layout no not with without wrap".split())
HEADER_WORDS = frozenset("header".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A block of so many words and such a share of stop words is text; of such a share of link text it is boilerplate.
MIN_WORDS, MIN_STOP, MAX_LINK = 12, 0.12, 0.5
#: On a page in another language a block of so many letters is text; languages that don't space words have few words.
MIN_LETTERS = 60

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, UNCLEAR = 1, 0, -1


def _hints(rest: str) -> tuple[set[str], set[str], bool]:
    """Words of class, id and role, the same tokens unsplit, and whether the element is hidden."""
    words: set[str] = set()
    whole: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(rest):
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            plain = value.replace(" ", "")
            hidden |= "display:none" in plain or "visibility:hidden" in plain
        else:
            for token in value.split():
                whole.add(token)
                parts = re.split(r"[^a-z]+", token)
                if not LAYOUT.intersection(parts):
                    words.update(parts)
    return words, whole, hidden


def _tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """The text before each tag with its name, whether it is an end tag, and its attributes; the last text has no tag."""
    at, end, before = 0, len(html), []
    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            before.append(html[at:])
            break
        before.append(html[at:tag.start()])
        at = tag.end()
        name, rest = (tag["name"] or tag["name2"] or "").lower(), tag["rest"] or tag["rest2"] or ""
        ends = bool(tag["end"] or tag["end2"])
        if name in RAW:
            if not ends and not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
        elif name:
            yield "".join(before), name, ends, rest
            before = []
    yield "".join(before), "", False, ""


def blocks(html: str) -> list[tuple[str, int, bool, bool, bool]]:
    """``text, characters of links, within boilerplate, within an article, a heading`` of each block.

    An article within boilerplate is boilerplate, unless the element around it may be one that was never closed (its name has
    more start tags than end tags on the page), or is a form, which may hold the whole page.  Publishing systems write topics
    into an article's class, so of that whole tokens count only.
    """
    found: list[tuple[str, int, bool, bool, bool]] = []
    open_: list[tuple[str, bool, bool, bool, int]] = []  # name, boilerplate, comments, article, closed boilerplate elements open before
    names: Counter[str] = Counter()
    around = 0
    bad = comments = article = heading = False
    parts: list[str] = []
    linked, link = 0, 0
    tags = list(_tags(html))
    balance: Counter[str] = Counter()
    for _, name, ends, _ in tags:
        balance[name] += -1 if ends else 1

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((text, linked, bad, article, heading))
        parts.clear()
        linked = 0

    for text, name, ends, rest in tags:
        if text:
            parts.append(text)
            if link:
                linked += len("".join(text.split()))
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            close()
            heading = name in HEADINGS and not ends
        if name == "a":
            link = 0 if ends else 1
        if name in VOID or not name:
            continue
        if ends:
            while names[name]:
                last, bad, comments, article, around = open_.pop()
                names[last] -= 1
                if last == name:
                    break
            continue
        if name == "p" and open_ and open_[-1][0] == "p":
            open_.pop()
            names["p"] -= 1
        words, whole, hidden = _hints(rest) if rest.strip() else (set(), set(), False)
        if name in ("html", "body"):
            words = set()
        if name in ("article", "main"):
            words &= whole
        own = hidden or name in BAD_TAGS or bool(words & BAD_WORDS) or (bool(words & HEADER_WORDS) or name == "header") and not article
        open_.append((name, bad, comments, article, around))
        names[name] += 1
        if name in ("article", "main", "body") and not own and not comments:
            bad = around > 0
            article |= name != "body" and not bad
            continue
        form = name in ("form", "fieldset") and not (hidden or words & BAD_WORDS)
        around += own and not form and balance[name] <= 0
        comments |= bool(words & COMMENT_WORDS)
        bad |= own
    close()
    return found


def labels(cut: list[tuple[str, int, bool, bool, bool]]) -> list[int]:
    """The two passes."""
    own = [_WORD.findall(text.lower()) for text, linked, bad, _, _ in cut if not bad and linked <= MAX_LINK * len("".join(text.split()))]
    # stop words tell something if an article is marked, or if the page's text shows one of their languages
    known = any(x[3] for x in cut) or sum(w in STOP_WORDS for x in own for w in x) >= MIN_STOP / 2 * sum(map(len, own))
    first = []
    for text, linked, bad, article, _ in cut:
        words = _WORD.findall(text.lower())
        stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if bad or linked > MAX_LINK * len("".join(text.split())):
            first.append(BAD)
        elif len(words) >= MIN_WORDS and stop >= MIN_STOP:
            first.append(GOOD)
        elif not known and sum(map(len, words)) >= MIN_LETTERS:
            first.append(GOOD)
        elif len(words) >= 2 * MIN_WORDS and stop < MIN_STOP / 2 and not article:
            first.append(BAD)
        else:
            first.append(UNCLEAR)
    decided = [x != UNCLEAR and not block[2] for x, block in zip(first, cut)]
    before, after = _nearest(decided), [len(cut) - 1 - k if k >= 0 else -1 for k in reversed(_nearest(decided[::-1]))]
    second = list(first)
    for k, x in enumerate(first):
        if x != UNCLEAR:
            continue
        if cut[k][3]:  # what an article holds, links and boilerplate aside, is its text
            second[k] = GOOD
            continue
        near = [(abs(k - j), first[j]) for j in (before[k], after[k]) if j >= 0]
        if not near:  # nothing else tells: text, unless the page holds boilerplate
            second[k] = BAD if BAD in first else GOOD
        elif len(near) == 2 and near[0][1] != near[1][1]:
            if cut[k][4]:
                second[k] = near[1][1]  # a heading belongs to what follows
            else:
                second[k] = near[0][1] if near[0][0] < near[1][0] else near[1][1] if near[1][0] < near[0][0] else BAD
        else:
            second[k] = near[0][1]
    return second


def _nearest(decided: list[bool]) -> list[int]:
    """The last decided block before each, or -1."""
    found, last = [], -1
    for k, x in enumerate(decided):
        found.append(last)
        last = k if x else last
    return found


def main_text(html: str | None) -> str:
    cut = blocks(html or "")
    return " ".join(block[0] for block, label in zip(cut, labels(cut)) if label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; a null or empty page has the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col)).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
