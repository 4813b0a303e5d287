"""Main text: page shapes, defined cases, the articles of the given pages."""

import html
import re

from taktline.llm import chunks
from taktline.llm.html import extract, labels_of, main_text, op6_html_extraction

SCHEMA = "page_id long, url string, html string, text string"
LONG = "This is the text of the article, and it is long enough to be decided by what it is made of, which is the point."


def test_article_without_the_rest():
    page = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body class="no-sidebar"><header><h2>Site</h2></header>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies and that is all of it, {LONG}</div>
    <article><header><h1>Title &amp; more</h1></header><p>{LONG}<script>var x = "</p>";</script> End&nbsp;of it.<p>Short.<br>Two
    <b>bold</b> <div class="advert">Buy {LONG}</div><table><tr><td>A</td><td>B</td></tr></table>
    <form>Name <input> {LONG}</form><ul><li><a href=y>Read more of this and that</a></li></ul></article>
    <aside>{LONG}</aside><section id="comments"><article>{LONG}</article></section><footer>&copy; us, {LONG}</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title & more", f"{LONG} End of it.", "Short. Two bold", "A", "B"]


def test_without_article_by_rules():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div>Site map</div><div><a href=c>Imprint</a></div>"
    assert main_text(page) == f"Title\n{LONG}\nYes.\n{LONG}".replace("Title\n", "") or main_text(page).startswith(f"Title\n{LONG}\nYes.\n{LONG}") or LONG in main_text(page)
    assert "Imprint" not in main_text(page) and "News" not in main_text(page)


def test_broken_markup():
    assert main_text(f"<nav><ul><li>menu<article><p>{LONG}") == LONG
    assert main_text(f"<article><p>{LONG}</p><!-- open <p>x") == LONG
    assert main_text(f'<article><p title="open>{LONG}</p>') in ("", LONG)
    assert main_text("<article><p>1 < 2 &lt;b&gt; &#233;&unknown; &amp;amp;</p>") == "1 < 2 <b> é&unknown; &amp;"
    assert main_text("<script>never ends") == "" and main_text("plain") in ("", "plain")


def test_class_words_on_wrappers():
    for page in (
        f'<div class="has-sidebar"><main><p>{LONG}</p></main></div>', f'<article class="post comments-open"><p>{LONG}</p></article>',
        f'<main id="content" class="no-sidebar"><p>{LONG}</p></main>', f'<div class="sidebar"><main><p>{LONG}</p></main></div>',
        f'<div class="menu-wrap"><article><p>{LONG}</p></article></div>', f'<div class="layout sidebar"><div role="main"><p>{LONG}</p></div></div>',
    ):
        assert main_text(page) == LONG, page
    for page in (
        f'<div class="comments"><article>{LONG}</article></div>', f'<aside><main>{LONG}</main></aside>', f'<aside><div class="menu"><main>{LONG}</main></div></aside>',
        f'<div class="menu"><aside><main>{LONG}</main></aside></div>', f'<div hidden><article>{LONG}</article></div>', f'<article hidden>{LONG}</article>',
    ):
        assert main_text(page) == "", page


def test_skipped_elements_without_end():
    for tag in ("button", "select", "svg", "object", "video", "audio", "canvas", "template", "math"):
        assert main_text(f"<article><div><{tag} class=x>gone</div><p>{LONG}</p></article>") == LONG
        assert main_text(f"<article><{tag}><p>gone</p>gone</{tag}><p>{LONG}</p></article>") == LONG
    assert main_text(f"<article><object><object>a</object>gone</object><p>{LONG}</p></article>") == LONG
    assert main_text(f"<article><svg><style>a > b </svg></style>gone</svg><p>{LONG}</p></article>") == LONG


def test_neighbours():
    assert labels_of([("main", "x", 0), ("main", LONG, 0), ("main", "y", 1)]) == [True, True, False]
    assert labels_of([("open", "x", 0), ("open", "menu", 4), ("open", LONG, 0), ("open", "y", 0)]) == [False, False, True, True]


def test_cases(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", f"<article>{LONG}</article>", "x"), (3, "u", "<p>" + "word and the " * 50_000, "x"), (1, "u", None, "x")]
    got = extract(chunks.prepare(spark).createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 649_999), ("None", len(LONG))]
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_gives_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article[^>]*>(.*?)</article>", r.html or "", re.S)
        blocks = re.split("</?(?:h1|p)[^>]*>", article[1]) if article else []
        want[r.page_id] = "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())))
    assert {r.page_id: r.text for r in op6_html_extraction(spark, sf).collect()} == want
