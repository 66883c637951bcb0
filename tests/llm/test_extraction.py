import random
import re
from html import unescape
from itertools import product

import numpy as np

from bidweave.llm import extraction


def article(page):
    """The article of the generated pages, by their own layout."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(1, 8)
        gain = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(i, i + 1, rnd.uniform(0, 2)) for i in range(n - 1)] + [(0, n - 1, rnd.uniform(0, 2))] * (n > 2)
        cost = lambda y: sum(max(g, 0) * (not k) + max(-g, 0) * k for g, k in zip(gain, y)) + sum(w for i, j, w in edges if y[i] != y[j])
        assert abs(cost(extraction.minimum_cut(gain, edges)) - min(map(cost, product([False, True], repeat=n)))) < 1e-9


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = extraction.extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r["text"] == article(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><div class="topbar">Site <a href=x>Home</a></div>
<div id="cookie-banner"><p>We use cookies to make it better. Accept them all.</p></div><form><p>Search the site now.</p><button>Go</button></form>
<div class="wrap"><div class="story"><h2>Title here</h2><p>First &amp; long paragraph of the story, which says   something. It goes on.
<p>Second one, with a <a href=u>link</a> inside.&nbsp;Good &lt;b&gt;.<script>var t = "</p><p>not this";</script><!-- nor <p>this -->
<ul><li>item one is long enough<li>item two is long enough</ul></div>
<aside><h3>Related</h3><p>Another story that may interest you. Read on.</p></aside><section class="comments"><p>Bob: I do not agree with this article. It is wrong.</p></section></div>
<footer>&copy; 2020 All rights reserved by us."""


def test_parts_of_a_page():
    assert extraction.main_text(PAGE).split("\n") == [
        "Title here",
        "First & long paragraph of the story, which says something. It goes on.",
        "Second one, with a link inside. Good <b>.",
        "item one is long enough",
        "item two is long enough",
    ]


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "plain words, no markup at all; but a full sentence. And one more."), (4, "u", "<nav><a>x</a></nav>" * 3000), (5, "u", "<article>" + "<p>a b c. " * 20_000), (5, "u", "<script>never closed <p>x"), (6, "u", "a < b <3 <"), (7, "u", "<div " * 500)]
    table = spark.createDataFrame([(*r, 0, "t") for r in rows], "page_id long, url string, html string, n_chars long, text string")
    got = {(r["page_id"], r["n_chars"]) for r in extraction.extract(table).collect()}
    assert len(got) <= len(rows) and (5, 20_000 * 7 - 1) in got and {(1, 0), (2, 0), (None, 0)} <= got
    assert extraction.extract(table.where("false")).collect() == []
    assert np.array_equal(extraction.train(table.where("false")), extraction.DEFAULT)


def inside(article):
    return extraction.main_text(f"<body><nav><ul><li><a href=x>Home</a></ul></nav><article>{article}</article><footer>end</footer>")


def test_foreign_and_inert_elements():
    text = "A first paragraph of the story, long enough. It goes on."
    for icon in ('<svg class="i" />', "<math />", '<svg><path d="m"/><title>Icon</title></svg>', "<template><li>not this</template>", '<object data="x" />', "<svg><g>"):
        page = f"<body><div>{icon}<a href=x>Menu</a></div><article><p>{text}</p><svg viewBox='0'><text>no</text></svg></article>"
        assert extraction.main_text(page) == text, icon
    assert inside(f"<p>{text} Here <svg><title>t</title><path/></svg>too.</p>") == f"{text} Here too."
    assert inside(f"<p>{text} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == f"{text} So x=2 holds."
    assert inside(f"<div><svg><g></div><p>{text}</p>") == text
    assert inside(f"<p>{text}<object><p>old browser</object></p>") == text


def test_names_of_wrappers_do_not_lose_the_article():
    text = "\n".join(f"Paragraph {i} of the story is long enough to be read as such. It goes on for a while." for i in "abcd")
    body = "".join(f"<p>{p}</p>" for p in text.split("\n"))
    for name in ("post tag-news", "content has-sidebar", "social-studies", "legal-article", "page-with-side", "more-news"):
        page = f'<body><nav><a href=x>Home</a></nav><div class="{name}">{body}</div><footer>end</footer>'
        assert extraction.main_text(page) == text, name
    for name in ("sidebar", "social"):  # alone on the page: text and smoothness outweigh the name
        assert extraction.main_text(f'<nav><a href=x>Home</a></nav><div class="{name}"><div class="story">{body}</div></div>') == text
        assert extraction.main_text(f'<nav><a href=x>Home</a></nav><div class="{name}">{body}</div>') == text
    ad = '<div class="ad-box">Buy it now</div>'
    assert extraction.main_text(f"<article>{body}</article>{ad}") == text


STORY = "\n".join(f"Paragraph {i} of the story is long enough to be read as such. It goes on for a while." for i in "abcd")
STORY_HTML = "".join(f"<p>{p}</p>" for p in STORY.split("\n"))
REMARK = "I read this twice and still do not agree with a word of it. What does the author think of us?"


def weights(spark):
    return [extraction.DEFAULT, extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))]


def test_comments_sidebars_footers_and_notices_go(spark):
    around = "<body><nav><ul><li><a href=x>Home</a></ul></nav>%s<footer>end</footer>"
    foreign = [
        f'<div id="reader-comments"><p>{REMARK}</p><p>{REMARK}</p></div>', f'<ol><li class="comment-body"><p>{REMARK}</p></li><li class="comment-body"><p>{REMARK}</p></li></ol>',
        f'<div class="comment-content"><p>{REMARK}</p></div>', f'<div class="sidebar-content"><p>{REMARK}</p></div>', f'<div class="footer-text"><p>{REMARK}</p></div>', f'<div class="cookie-text"><p>{REMARK}</p></div>',
        f'<article class="comment-body"><p>{REMARK}</p></article>', f'<div class="post-comments"><p>{REMARK}</p></div>',
    ]
    for w in weights(spark):
        for part in foreign:
            for wrapped in (f"<article>{STORY_HTML}</article>{part}", f"{part}<article>{STORY_HTML}</article>", f'<div class="post-content">{STORY_HTML}</div>{part}', f"<article>{STORY_HTML}{part}</article>"):
                assert extraction.main_text(around % wrapped, w) == STORY, wrapped


def test_headlines_in_the_articles_own_header_stay(spark):
    for w in weights(spark):
        for shell in ("<article>%s</article>", "<main>%s</main>", "<div role=main>%s</div>"):
            page = "<body><header><h1>Name of the site</h1></header>" + shell % f"<header><h1>A headline of five words</h1></header>{STORY_HTML}"
            assert extraction.main_text(page, w) == "A headline of five words\n" + STORY
        named = f'<div class="entry"><div class="entry-header"><h1>A headline of five words</h1></div>{STORY_HTML}</div>'
        assert extraction.main_text(named, w) == "A headline of five words\n" + STORY


def test_the_cut_outweighs_a_wrong_element(spark):
    for w in weights(spark):
        wrong = f'<body><nav><a href=x>Home</a></nav><aside class="story">{STORY_HTML}</aside><footer>end</footer>'
        assert extraction.main_text(wrong, w) == STORY
        right = f'<body><article>{STORY_HTML}</article><aside><div class="content"><p>{REMARK}</p></div></aside>'
        assert extraction.main_text(right, w) == STORY
        assert extraction.main_text(f"<body><article>{STORY_HTML}<aside><p>{REMARK}</p></aside>{STORY_HTML}</article>", w) == STORY + "\n" + STORY


def test_names():
    assert all(extraction.names_mark(n) < 0 for n in ("comment-body", "reader-comments", "sidebar-content", "cookie_text", "post-footer", "page-header", "entry-content comment", "social"))
    assert all(extraction.names_mark(n) > 0 for n in ("content has-sidebar", "post tag-news", "legal-article", "main-content", "entry-header", "article_body", "post-12"))
    assert all(extraction.names_mark(n) == 0 for n in ("", "tag-news", "social-studies", "page-with-side", "more-news", "ad-free", "row"))
