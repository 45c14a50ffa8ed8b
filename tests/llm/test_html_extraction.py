import html
import random
import re
import time
from html.parser import HTMLParser

from motionlake.llm import html_extraction as H
from motionlake.llm.queries import op7_html_extraction


def expected(page):
    """Blocks of an article that holds only headings, paragraphs, bold text and line breaks."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    lines = [" ".join(html.unescape(re.sub("<br>", " ", x).replace("<b>", "")).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op7_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


def test_what_stands_around_an_article_goes():
    page = """<body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice"><p>We use cookies, many, many.</p></div>
    <main><article><header><h1>Title</h1></header><p>One, two &amp; three &#233;.<p>A &lt;b&gt; <a href=y>link</a> here<script>var t = "</p>";</script>
    <aside>aside</aside><form><input>send</form><div class="ad">buy</div><ul><li>first<li>second</ul><style>p{}</style><!-- <p>no</p> --></article>
    <section id="comments"><p>I liked this, very much, indeed.</p></section></main><footer>&copy; me</footer></body>"""
    assert H.main_text(page) == "Title\nOne, two & three é.\nA <b> link here\nfirst\nsecond"


def test_container_without_an_article():
    page = "<div class=top><a href=a>home</a> <a href=b>news</a></div><div class=content><h2>Head</h2><p>Text, with, commas and some length to it.</p><p>More text, again with commas.</p></div><div class=sidebar><p>x, y, z</p></div>"
    assert H.main_text(page) == "Head\nText, with, commas and some length to it.\nMore text, again with commas."


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<"), (4, "just text &amp; more"), (5, "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "<p>" + "long " * 60_000), (6, "<p>" + "long " * 60_000), (7, "<script>only"), (None, "</p></div><b>x"), (8, "<p>" + "<b>" * 4000 + "bold")]
    pages = spark.createDataFrame([(i, None, h, "clash", 1) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert [got[i] for i in (1, 2, 4, 5, 7, None, 8)] == ["", "", "just text & more", "deep", "", "x", "bold"]
    assert got[6] == " ".join(["long"] * 60_000)
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_titles_and_layout_classes_stay():
    page = """<body class="has-sidebar"><div id="page" class="site-content no-sidebar"><article><div class="entry-header"><h1>Title</h1></div>
    <p>One paragraph.</p><p title="the hidden gem">Kept para.</p><p hidden>gone</p><p style="display: none">gone too</p><div style="overflow: hidden"><p>Also kept.</p></div></article>
    <div class="main with-sidebar"><ol id=comments><li><article class="comment">Nice!</article></ol></div></div><div class="page-header">Site</div></body>"""
    assert H.main_text(page) == "Title\nOne paragraph.\nKept para.\nAlso kept."
    assert H.main_text('<div class="sidebar-layout sidebar"><main><p>All of it.</p></main></div>') == "All of it."


def test_generated_pages_without_an_article():
    """Containers of any name, among menus, notices and footers: every paragraph and heading stays, in order."""
    rng = random.Random(5)
    for _ in range(60):
        blocks = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice((3, 12, 40, 90)))) + rng.choice((".", ", so.", "!")) for _ in range(rng.randrange(6, 20))]
        body = "".join(rng.choice(("<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>")).format(b) for b in blocks)
        menu = "".join(f"<li><a href=/{k}>Menu entry {k}</a>" for k in range(9))
        page = f"""<html><body><div class="top-nav"><ul>{menu}</ul></div><div class="cookie-banner"><p>Cookies, yes, cookies.</p></div><div class="{rng.choice(("content", "x1", "story"))}">{body}</div>
        <div id="comments"><p>Reader says, well, no.</p></div><div class="footer"><ul>{menu}</ul></div></body></html>"""
        assert H.main_text(page) == "\n".join(blocks)


def test_parts_of_an_article_stay_whatever_their_names():
    body = """<h2 id="related-work">Related work</h2><h2 id="share-prices-fall">Prices</h2><p class="ad-hoc">Ad hoc</p><div class="foot-note">Note</div><div class="side-by-side">Side</div>
    <h3 class="widget-title">Widget</h3><p id="newsletter">Its id</p><p>Set <math><mi>x</mi><annotation>tex</annotation></math> to <span class="share">0</span></p><div class="comment-free">Free</div>"""
    kept = "Related work\nPrices\nAd hoc\nNote\nSide\nWidget\nIts id\nSet x to 0\nFree"
    around = """<div class="related-posts"><p>Other</p></div><div class="ad-slot-3">Buy</div><div class="shareButtons">Share</div><div id="comment-list"><p>I say</p></div><header><a href=x>Home</a> <a href=y>All</a></header>"""
    assert H.main_text(f"<nav>n</nav><article><header><p>Lead paragraph</p></header>{body}{around}</article>") == f"Lead paragraph\n{kept}"
    assert H.main_text(f"<main><header><h1>T</h1></header>{body}{around}</main>") == f"T\n{kept}"


class Plain(HTMLParser):
    """The blocks of a page's article by the standard parser and a list of what the page's maker knows to be around it."""

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.held = [], [], []

    def end_block(self):
        if text := " ".join("".join(self.held).split()):
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        else:
            self.end_block() if tag in H.BLOCKS else None
            self.stack.append((tag, dict(attrs).get("data-around") is not None))

    def handle_endtag(self, tag):
        self.end_block() if tag in H.BLOCKS else None
        self.stack.pop()

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(around or t in ("script", "style") for t, around in self.stack):
            self.held.append(data)


def test_generated_articles_against_a_plain_parser():
    rng = random.Random(11)
    names = ["", ' class="lead"', ' id="the-menu-of-the-day"', ' class="ad-hoc news"', ' class="footnote"', ' id="comments-on-the-law"']
    outside = ['<div class="ad" data-around=1>{}</div>', '<div class="related-links" data-around=1><ul><li><a href=x>{}</a></li></ul></div>', "<aside data-around=1><p>{}</p></aside>", "<form data-around=1>{}</form>", "<script>{}</script>", '<div class="comments" data-around=1><p>{}</p></div>']
    say = lambda: " ".join(rng.choice(("alpha", "b&amp;c", "d\n e", "<b>bold</b>", "<i>x</i>y", "f,<br>g", "&#233;t&eacute;", '<a href="q">link</a>')) for _ in range(rng.randrange(1, 40)))

    def block(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind > 4:
            return f"<div{rng.choice(names)}>{''.join(block(depth - 1) for _ in range(rng.randrange(1, 4)))}</div>"
        tag = ("p", "h2", "blockquote", "pre", "p")[kind]
        return f"<{tag}{rng.choice(names)}>{say()}</{tag}>" if rng.random() < 0.8 else rng.choice(outside).format("noise, noise")

    for _ in range(80):
        article = "".join(block(2) for _ in range(rng.randrange(1, 9)))
        page = f"<html><body><header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav><div class=wrap><article{rng.choice(names)}><header><h1>{say()}</h1></header>{article}</article></div><div class=sidebar><p>x, y</p></div><footer>f</footer></body></html>"
        plain = Plain()
        plain.feed(page)
        assert H.main_text(page) == "\n".join(plain.out), page


def test_time_is_linear_in_large_broken_pages():
    """Pages of about 5 MB."""
    for page in ("abcdefgh<!-- -->" * 310_000, "x<!y>" * 1_000_000, "<div>" * 400_000 + "<main></main>" * 200_000, "<article>" + "<header>" * 400_000 + "t", "<article>" + "<header><p>ab</p></header>" * 190_000):
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 25, page[:30]


def test_time_is_linear_in_broken_pages():
    n = 100_000
    pages = ["<a " * 1_700_000, '<a "' * 1_200_000, "<div>" * n + "</section>" * n, "<div>" + "<span>" * n + "<hr>" * n, "<b><div>" + "<span>" * n + "</b>" * n, "<p>" * n + "x", "<header>" * n + "<h1>t",
             "<script" * n, "<!--" * 1_000_000, "<li>" * n + "</p>" * n, "<div><p>" * (n // 2) + "</p></b>" * n, '<div class="' + "advert" * 500_000 + '">x', "<article>" * n + "x", '<a ">">' * n, "&amp" * n]
    for page in pages:
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 10, page[:30]
