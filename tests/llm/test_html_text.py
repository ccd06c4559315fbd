import re
from html import unescape

import pytest

from claimforge.llm.html_text import extract, main_text

PARA = "This is the text of a page that has many of the words which are in it and it goes on for a while."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site of the day and the name</header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on the site and in the app to make it good for you and for us and them.</div><!-- ad -->
<div class="ad">Buy it.</div><article><h1>Title &amp; more</h1><p><b>Bold<br>line</b> x<i>y</i>.<p>{PARA}</p>Short.<div class=share>Share it</div>
<p>{PARA} a&nbsp;&lt;b&gt; &copy; 5 < 6</p><form>Name <input><button>Go</button></form></article>
<section id="comments"><article class="c"><p>{PARA}</p></article></section><aside>{PARA}</aside><footer>&copy; x</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == f"Title & more Bold line xy. {PARA} Short. {PARA} a <b> © 5 < 6"


def test_blocks_without_containers():
    html = f"<body><div>Home</div><div><a href=x>{PARA}</a></div><h2>On the page</h2><div>{PARA}</div><div>Yes.</div><div>{PARA}</div></body>"
    assert main_text(html) == f"On the page {PARA} Yes. {PARA}"


def test_other_languages_without_containers():
    for para, short in (("Это длинный абзац текста страницы на русском языке, " * 5, "Ещё раз."), ("这是一个没有空格的很长的中文段落它讲述了许多事情" * 5, "再见。")):
        para = para.strip()
        html = f"<body><div><a href=x>{para}</a></div><div>{para}</div><div>{short}</div><div>{para}</div></body>"
        assert main_text(html) == f"{para} {short} {para}"


def test_layout_classes_say_nothing():
    html = f'<body class="has-sidebar cookies header"><div class="content-sidebar-wrap no-footer"><div>{PARA}</div></div><div class="post-footer">{PARA}</div></body>'
    assert main_text(html) == PARA


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<") [:0] == main_text("<script>x") == ""
    assert main_text(f"<article><p>{PARA} x &am") == f"{PARA} x &am"
    assert main_text(f"<div class=ad>Buy<article><p>{PARA}</p></article>") == PARA
    assert main_text(f"<article><p>{PARA}<!-- never closed <p>x") == PARA
    assert main_text("<p>" * 20000 + f"<article>{PARA}<a title='never closed>") == PARA


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "v", "<article>" + f"<p>{PARA}</p>" * 3000, "y")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1, "u"] == (main_text(PAGE), len(main_text(PAGE))) and got[None, None] == ("", 0)
    assert got[3, "v"][0] == " ".join([PARA] * 3000)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_synthetic_pages(spark):
    """Their article element, tags off, is the text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row, got in zip(pages.orderBy("page_id").collect(), extract(pages).orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert got.text == " ".join(unescape(plain).split())


def test_articles_within_boilerplate():
    for page in (f'<aside class="related"><article><p>{PARA}</p></article></aside>', f'<div style="display:none"><main><p>{PARA}</p></main></div>',
                 f"<footer><article><p>{PARA}</p></article></footer>", f'<div class="ad"><div><article>{PARA}</article></div></div>'):
        assert main_text(f"<body><article><p>One. {PARA}</p></article>{page}</body>") == f"One. {PARA}"
    assert main_text(f"<body><nav>Menu<article><p>{PARA}</p></article></body>") == PARA


def test_many_blocks_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        assert main_text(f"<div>{PARA}</div><div>Yes.</div>" * n).count("Yes.") == n
        return time.process_time() - began

    took(500)
    assert took(16000) < 20 * took(2000)


PROSE = "The council of the town said on Monday that it will build a new bridge over the river, and that the work is to start in the spring of the next year."


@pytest.mark.parametrize("page", [
    "<form method=post action=/><div><article><h1>Title</h1><p>{}</p></article></div></form>",
    "<body><form id=aspnetForm><main><p>{}</p></main></form></body>",
    '<article class="post category-search"><p>{}</p></article>', '<article class="tag-banner hentry"><p>{}</p></article>', '<main class="category-social"><p>{}</p></main>',
])
def test_articles_in_forms_and_of_any_topic_are_kept(page):
    assert PROSE in main_text(page.format(PROSE))


def test_whole_tokens_of_an_article_still_tell_boilerplate():
    assert main_text(f'<article><p>{PROSE}</p></article><article class="comment"><p>{PROSE} I agree.</p></article>') == PROSE
    assert main_text(f'<article><p>{PROSE}</p></article><article class="teaser promo"><p>{PROSE}</p></article>') == PROSE


def test_hidden_by_visibility_and_a_line_without_tags():
    assert main_text(f'<p>{PROSE}</p><div style="visibility: hidden"><p>{PROSE} Not this.</p></div>') == PROSE
    assert main_text("Just a line") == "Just a line"
    assert main_text("<nav><a href=/>Home</a> <a href=/x>News</a></nav>Just a line") == ""


def test_deep_nesting_is_linear():
    import time

    began = time.perf_counter()
    assert main_text("<div>" * 20_000 + f"<article><p>{PROSE}</p></article>" * 200 + "</div>" * 20_000 + "</b>" * 50_000).count(PROSE) == 200
    main_text("<div class=notice>" * 5_000 + "<article>x" * 5_000)
    assert time.perf_counter() - began < 10
