import html
import re

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import extract, main_text, parse
from tessera.llm.registry import op1_html

P = "This is a sentence of the article that goes on for a while, with commas. " * 4
PAGES = [
    (f"<body><div class='sidebar'>{P}</div><div id=content><h1>Head</h1><p>{P}<p>{P}<a href=x>a link</a> more</div><div class=comments><p>{P}</p></div></body>", f"Head {P}{P}a link more"),
    (f"<html><body><header>top {P}</header><main><h2>A &amp; B</h2><ul><li>one<li>two</ul><p>x&nbsp;y\n z</p>{P}<form>{P}</form></main><footer>{P}</footer>", f"A & B one two x y z {P}"),
    (f"<div><ul>{'<li><a href=/q>some menu entry here</a></li>' * 30}</ul></div><div><p>{P}</p><p>{P}</p></div>", f"{P}{P}"),
    (f"<article><p>{P}</p><script>var a = '</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><aside>{P}</aside><p>5 < 6 &lt;b&gt;</p></article>", f"{P}5 < 6 <b>"),
    ("just words, no tags", "just words, no tags"),
    ("", ""),
    ("<body></body>", ""),
    ("<p>cut <b>of", "cut of"),
    (f"<article><p>{P}<br>next<p title='a > b'>quoted</p><img src=x alt='no'></article>", f"{P}next quoted"),
    (f"<article><div class='cookie-notice'>{P}</div><p>{P}", P),
    ("<p " + "a" * 1000, ""),
]


def article_of(page):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert main_text(page) == " ".join(text.split())


MANY, THIN = f"<p>{P}</p>" * 6, f"<ul>{'<li>x</li>' * 40}</ul>"
PARTS = [
    (f"<body><article>{MANY}</article><article><p>{P}</p></article>{THIN}</body>", P * 7),
    (f"<body><main><p>{P}</p><article>{MANY}</article></main></body>", P * 7),
    (f"<body><div>{MANY}</div><div><p>{P}</p></div>{THIN}</body>", P * 7),
]


@pytest.mark.parametrize("page,text", PARTS)
def test_all_parts_of_an_article(page, text):
    assert main_text(page) == " ".join(text.split())


def renamed(tag, attrs=""):
    return lambda page: page.replace("<article>", f"<{tag}{attrs}>").replace("</article>", f"</{tag}>")


VARIANTS = {
    "div": renamed("div"),
    "form": lambda page: page.replace("<body>", "<body><form>").replace("</body>", "</form></body>"),
    "side": renamed("div", ' class="side"'),
    "alert": renamed("div", ' class="post alert"'),
    "unknown": lambda page: renamed("div")(page).replace('class="ad"', 'class="x7"'),
    "section": lambda page: re.sub(r"<article>(<h1>.*?</h1>)(.*?)</article>", r"<div>\1<section>\2</section></div>", page, flags=re.DOTALL),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_articles_without_their_tags(spark, name):
    """Density alone finds the articles; a page may fail whose article is shorter than its advert."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    found = [main_text(VARIANTS[name](p)) == article_of(p) for p in pages]
    assert sum(found) >= 0.99 * len(pages)
    assert all(main_text(VARIANTS[name](p)) for p in pages if article_of(p))


ODD = [
    (f"<body><svg><p>{P}</p><p>{P}</p></body>", P * 2),  # elements without an end tag hide nothing
    (f"<body><select><option>x<p>{P}</p></body>", f"x {P}"),
    (f"<div><p>{P}</p><p>a <span class=ad>b <span>c</span> d</span> e {P}</p></div>", f"{P}a e {P}"),  # inline elements nest
    (f"<div><p>{P}</p><h2>Head</h2><p>{P}</p><ul><li>one</li><li>two</li></ul></div>", f"{P}Head {P}one two"),
    (f"<form action=x><p>{P}</p><p>{P}</p></form>", P * 2),
    ("<nav><a href=x>menu</a></nav><div class=cookie>Cookies</div>", "Cookies"),  # it holds most of the text
]


@pytest.mark.parametrize("page,text", ODD)
def test_nothing_is_lost(page, text):
    assert main_text(page) == " ".join(text.split())


def test_density_of_every_node():
    root = parse(f"<body><p>{'x' * 80} <em>{'y' * 20}</em></p><ul><li><a href=q>{'z' * 30}</a></li></ul></body>")
    nodes = {n.tag: n for n in html_text._measure(root.nodes()[0])}
    assert set(nodes) == {"body", "p", "em", "ul", "li", "a"} and all(n.chars for n in nodes.values())
    assert (nodes["p"].chars, nodes["p"].tags) == (100, 1) and nodes["ul"].link_chars == 30
    assert nodes["p"].density > nodes["em"].density > nodes["ul"].density
    body = nodes["body"]
    share = 30 / 130
    assert body.total == pytest.approx(sum(nodes[t].density for t in ("p", "ul"))) and nodes["p"].density == pytest.approx(html_text.density(100, 1, 0, 0, share))


def test_deep_and_long_pages():
    assert main_text("<div>" * 50000 + "x") == "x"
    assert main_text("<p>" + "word " * 200000) == ("word " * 200000).strip()
    assert main_text("<a " * 20000 + "\"'" * 20000) is not None


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "u", "t"), (1, None, "u", "t"), (None, "<p>x", None, "t")], "page_id long, html string, url string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(df).collect()) == [(0, "x"), (1, ""), (1, "")]
    assert extract(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    out = op1_html(spark, d).collect()
    assert len(out) == len(pages)
    for r in out:
        text = article_of(pages[r.page_id])
        assert (r.text, r.n_chars) == (text, len(text))
