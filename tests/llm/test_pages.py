from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from opskpi.llm.pages import Walk, main_text, site_paths
from tests.conftest import SF_SMALL

ARTICLE = "<article><h1>Title</h1><p>One <b>two</b>\n three.</p><p>Four</p></article>"


@pytest.mark.parametrize("page,text", [
    (ARTICLE, "Title\nOne two three.\nFour"),
    (f"<body><nav><ul><li>Menu</ul></nav><header><h1>Site</h1></header>{ARTICLE}<footer>&copy; x</footer>", "Title\nOne two three.\nFour"),
    (f"<div class='cookie-notice'>C</div><aside>s</aside><main>{ARTICLE}</main><div id=comments><article>c</article></div>",
     "Title\nOne two three.\nFour"),
    ("<article><header><h1>T</h1></header><p>x<div class=ad>Buy</div>y<form>f<input value=v></form></article>", "T\nx\ny"),
    ("<p>a&nbsp;&amp;&#x41;&eacute; &am", "a &Aé &am"),
    ("<p>one<br>two<br/>three", "one two three"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<script>if (a < b) { '<p>no</p>' }</script><style>p{}</style><p>yes<script>", "yes"),
    ("<!-- <p>no</p> --><p>yes</p><!-- cut <p>no", "yes"),
    ("a < b and c > d", "a < b and c > d"),
    ("<p>x<a href='cut", "x"),
    ("<p title=\"a>b\">x</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p>", "x"),
    ("<P>UP</P><DIV>x<SPAN>y</SPAN></DIV>", "UP\nxy"),
    ("<p><b>open<p>next</b>", "open\nnext"),
    ("<main><p>m</p></main><p>outside</p>", "m"),
    ("<article></article><p>body</p>", "body"),
    ("<article><p>p</p><section class='reader-comments'><article>c</article></section></article>", "p"),
    ("", ""),
    ("</p></div>x", "x"),
])
def test_main_text_of_one_page(page, text):
    assert Walk(page).text() == text


def site(n, host="h.example", article=False):
    body = "<article>{0}</article>" if article else "{0}"
    return [(i, f"https://{host}/p{i}", f"<body><div class=strip><span>Every page says this</span></div>"
             + body.format(f"<div class=story><p>Story {i} of {host}</p><p>Told once {i * 7}</p></div>")
             + "<div class=tail>Same end</div></body>") for i in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "?", 0) for r in rows], "page_id long, url string, html string, host string, salt int")
    return sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text(df.repartition(3)).collect()), key=repr)


def test_what_a_site_repeats_goes(spark):
    rows = site(20) + [(100, "https://few.example/a", "<div class=strip>Every page says this</div><p>x")]
    got = {r[0]: r for r in run(spark, rows)}
    assert all(got[i][2] == f"Story {i} of h.example\nTold once {i * 7}" for i in range(20))
    assert got[100][2] == "Every page says this\nx"
    assert all(r[3] == len(r[2]) for r in got.values())


def test_an_article_is_kept_however_often_it_stands(spark):
    rows = [(i, "https://h.example/", ARTICLE) for i in range(15)]
    assert {r[2] for r in run(spark, rows)} == {"Title\nOne two three.\nFour"}


def test_importance_is_entropy(spark):
    df = spark.createDataFrame(site(16), "page_id long, url string, html string").withColumn("host", F.lit("h"))
    values = sorted(round(r["importance"], 6) for r in site_paths(df).collect() if r["pages"] == 16)
    assert values[0] == 0 and values[-1] == 1


def test_defined_cases(spark):
    rows = [(1, None, ARTICLE), (2, "https://x.example/", None), (2, "https://x.example/", None), (None, "no url", "<p>a"),
            (3, "https://x.example/", ""), (4, "https://x.example/", "<p>" + "word " * 40_000)]
    got = run(spark, rows)
    assert (1, None, "Title\nOne two three.\nFour", 25) in got and got.count((2, "https://x.example/", "", 0)) == 2
    assert (None, "no url", "a", 1) in got and any(r[0] == 4 and r[3] == 199_999 for r in got)
    assert run(spark, []) == []


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for r in pages.collect():
        inside = r["html"].split("<article>", 1)[1].split("</article>")[0]
        assert got[r["page_id"]].split("\n")[0][:20] in inside.replace("&amp;", "&").replace("&quot;", '"')
        assert "track(" not in got[r["page_id"]] and "©" not in got[r["page_id"]]


@pytest.mark.parametrize("part", [
    "<h2 id='ad-hoc-queries'>A</h2>", "<section id='related-work'><h2>R</h2><p>r</p></section>", "<div id=social-history>s</div>",
    "<section id='search-algorithms'><p>b</p></section>", "<h3 id=menu-planning>m</h3>", "<p class=notice>n</p>",
    "<section class='notice'>n</section>", "<div class='share-prices'><p>up</p></div>", "<section id=comments>in code</section>",
])
def test_slug_names_inside_an_article_are_prose(part):
    inside = Walk(f"<article>{part}</article>").text()
    assert inside and inside == Walk("<article>" + re.sub(r" (id|class)=('[^']*'|[\w-]+)", "", part) + "</article>").text()


@pytest.mark.parametrize("part", ["<div class='box ads'>x</div>", "<div id=newsletter><p>x</p></div>",
                                  "<section class=comments><p>x</p></section>", "<aside>x</aside>", "<article class=comment>x</article>"])
def test_furniture_inside_an_article_goes(part):
    assert Walk(f"<article><p>p</p>{part}</article>").text() == "p"


def test_named_containers_in_articles_need_the_style_tree(spark):
    rows = [(i, f"https://h.example/p{i}", f"<article><p>Own {i}</p><div class='share-bar'><p>Share this</p></div>"
             f"<div id=menu-planning><ul><li>Dish {i}</li></ul></div><section id=related-work><h2>Related work</h2><p>Cites {i}"
             "</p></section></article>") for i in range(20)]
    assert all(r[2] == f"Own {r[0]}\nDish {r[0]}\nRelated work\nCites {r[0]}" for r in run(spark, rows))


@pytest.mark.parametrize(("page", "text"), [
    ("<div class='layout with-sidebar'><article><p>Story one</p></article></div>", "Story one"),
    ("<form id='aspnetForm'><main><article><p>A b</p></article></main></form>", "A b"),
    ("<div class='page no-banner'><main><p>X</p></main></div>", "X"),
    ("<div id='social-network-story'><p>tale</p></div>", "tale"),
    ("<body><div class='sidebar'><article><p>only article</p></article></div><p>stray</p></body>", "only article"),
    ("<div class='related-posts'><article>teaser</article></div><main><p>The long story is here.</p></main>", "The long story is here."),
    ("<aside><article>side</article></aside><article>main one</article>", "main one"),
    ("<nav><p>menu</p></nav><div class='cookie-banner'>We use</div><p>text</p>", "text"),
    ("<div class='article-comments'><article class=comment>Nice!</article></div><article>Own</article>", "Own"),
])
def test_no_ancestor_loses_an_article(page, text):
    assert Walk(page).text() == text


def test_given_pages_whole(spark):
    """Whole texts against the library's parser: the blocks of the article, without other markup."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks, self.run = False, [], ""

        def flush(self):
            if self.run.split():
                self.blocks.append(" ".join(self.run.split()))
            self.run = ""

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag == "br":
                self.run += " "
            elif tag in ("article", "p", "h1", "h2", "h3"):
                self.flush()

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1", "h2", "h3"):
                self.flush()
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            self.run += data if self.inside else ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) > 200
    for r in rows:
        want = Article()
        want.feed(r["html"])
        want.flush()
        assert got[r["page_id"]] == "\n".join(want.blocks)
