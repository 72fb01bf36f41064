"""Page extraction against pages whose text is known."""

from __future__ import annotations

import html
import re

import pytest

from tidemark.llm import pages

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><header>Site</header><div class="cookie-notice">Accept</div>
<div class="wrap page-%d"><article class="post"><h1>Big &amp;  <b>title</b></h1><p>One
 two&nbsp;<i>three</i><br>four<p><b>Five<br><p>Six</b> &#x41;&lt;</p><ul><li>seven<li>eight</ul>
<div class="ad">Buy</div><form>Name <input name=q></form><!-- no > --><aside>Side</aside>
<span class="advert">Buy more</span>nine 3 < 4 <table><tr><td>c1<td>c2</table>
<section id="comments"><p>First!</p></section></article><div class="sidebar">S</div></div><footer>&copy;</footer></body></html>"""
WANT = "Big & title\nOne two three four\nFive\nSix A<\nseven\neight\nnine 3 < 4\nc1\nc2"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_known_page(spark):
    rows = [(i, "http://h.example/1", FULL % i) for i in range(6)] + [(90, None, None), (91, "odd", ""), (92, "http://h.example/2", "plain text only")]
    rows += [(93, "http://h.example/3", (FULL % 7)[:-400]), (None, "http://h.example/4", FULL % 8)]
    docs = frame(spark, rows).selectExpr("*", "'clash' AS text", "1 AS path", "2 AS host")
    got = {r["page_id"]: r for r in pages.main_texts(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == WANT for i in [*range(6), None])
    assert got[90]["text"] == "" and got[90]["n_chars"] == 0 and got[91]["text"] == ""
    assert got[92]["text"] == "plain text only"
    assert WANT.startswith(got[93]["text"]) and got[93]["text"].startswith("Big & title")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_host_outvotes_a_page(spark):
    """One page's longest container is an unmarked list of links; its host's other pages say where the text is."""
    usual = '<body><div class="text">%s</div><div class="x">a few links</div></body>'
    odd = '<body><div class="text">short own text</div><div class="x">%s</div></body>' % ("links and more links " * 20)
    rows = [(i, "https://News.example:80/p", usual % ("words of the article " * 9)) for i in range(5)]
    rows += [(5, "https://news.example/p", odd), (6, "https://other.example/p", odd)]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert got[5] == "short own text" and got[6].startswith("links")


def test_odd_markup():
    one = lambda x: pages.text_at(pages.blocks_of(x), None)
    assert one("<p>a</p></div></b><p>b") == "a\nb"
    assert one("<script>never closed <p>x") == "" and one("<p>x<!-- open") == "x"
    assert one("a <b attr='>'>b</b> c <3 d") == "a b c <3 d"
    assert one("<div><p>x <em>y</p> z</div>") == "x y\nz"
    assert one("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") != ""
    assert one("v <span class=ad>x<p>y</p>z</span>w") == "v\nw"
    assert one("&lt;p&gt; &bogus; &#128512;") == "<p> &bogus; \U0001f600"


def test_hidden_is_an_attribute():
    """Only an attribute named hidden or a style without display hides; the word in a class or style does not."""
    one = lambda x: pages.text_at(pages.blocks_of(x), None)
    for shown in ('style="overflow:hidden"', 'class="content overflow-hidden"', "data-state='hidden'", 'aria-hidden="false"', "title='is hidden here'"):
        assert one(f"<article {shown}><p>text</p></article>") == "text", shown
        assert one(f"<div {shown}><p>text</p></div>") == "text", shown
    for unseen in ("hidden", 'hidden=""', 'class="a" hidden', "HIDDEN class=a", 'style="color:red; display : none"', "style=display:none"):
        assert one(f"<article>x<section {unseen}><p>text</p></section></article>") == "x", unseen


ARTICLE = "<p>" + "words of the article " * 9 + "</p>"
KEPT = [
    '<div class="content-sidebar-wrap"><main><article>%s</article></main></div>', '<div id="page" class="site header-fixed"><article>%s</article></div>',
    '<div class="layout sidebar-right"><div class="post">%s</div></div>', '<article><div class="side-by-side">%s</div></article>',
    '<article><section id="discussion">%s</section></article>', '<article><section id="related-work">%s</section></article>',
    '<article><div class="notice-board">%s</div></article>', '<div class="page-header"><article>%s</article></div>',
    '<article><div class="side">%s</div></article>', '<article class="post comments-open">%s</article>', '<div class="post-header">%s</div>',
]
LEFT_OUT = [
    '<article>%s<article class="comment"><p>First!</p></article></article>', '<article>%s</article><article class="comment depth-1"><p>First!</p></article>',
    '<article>%s<div id="postComments"><p>First!</p></div></article>', '<article>%s<div class="commentlist2"><p>First!</p></div></article>',
    '<article>%s<ins class="adsbygoogle">Buy</ins></article>', '<article>%s<div class="cookieBanner"><p>Accept</p></div></article>',
    '<article>%s<div class="sidebarLeft"><p>More</p></div></article>', '<article>%s<div class="related-posts"><p>More</p></div></article>',
    '<div class="post">%s</div><div class="widget-area"><p>More</p></div>', '<article>%s<div role="navigation"><p>More</p></div></article>',
    '<article>%s</article><div class="comments"><article><p>First!</p></article></div>',
]


@pytest.mark.parametrize("box", KEPT + LEFT_OUT)
def test_words_in_names(spark, box):
    """A name marks an aside word by word, and not what holds the article."""
    rows = [(i, f"http://h{i % 2}.example/", "<body><div class=menu>Menu</div>" + box % ARTICLE.replace("words", f"words {i}") + "</body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert got == {i: " ".join([f"words {i} of the article"] * 9) for i in range(4)}


def test_a_host_says_which_box_is_no_aside(spark):
    """Where most pages have most of their text in a box that is marked, it is lifted on all of them; a long sidebar is not."""
    rows, want = [], {}
    for i in range(9):
        article = " ".join(f"own{i} words" for _ in range(3 if i == 8 else 60))
        extra = " ".join(f"side{i}" for _ in range(400 if i == 7 else 9))
        rows.append((i, "http://a.example/", f'<body><div class="sidebar">{article}</div><p>{"x " * 20}</p></body>'))
        rows.append((100 + i, "http://b.example/", f'<body><div class="post">{article}</div><div class="sidebar">{extra}</div></body>'))
        want[i] = want[100 + i] = article
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert got == want


def test_ids_stay_exact(spark):
    rows = [(9007199254740993, "u", "<p>a"), (None, "u", "<p>b"), (-1, None, "<p>c")]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert got == {9007199254740993: "a", None: "b", -1: "c"}
    text = spark.createDataFrame([("k-1", "u", "<p>a")], "page_id string, url string, html string")
    assert pages.main_texts(text).first()["page_id"] == "k-1"


def test_votes_and_widening_against_plain(spark):
    """Paths, lifted boxes and parents per host, counted page by page, on pages in wrapper classes."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(60):
        host = rng.choice("abc")
        wrap = {"a": "layout sidebar-right", "b": "site header-fixed", "c": "content-sidebar-wrap"}[host]
        main = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(30, 90)))
        head = f"<h1>Title {i}</h1>"
        rows.append((i, f"http://{host}.example/{i}", f'<body><div class="menu">Home</div><div class="{wrap}">{head}<div class="text"><p>{main}</p></div></div><div class="footer">end</div></body>'))
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    hosts = {}
    for _, url, page in rows:
        hosts.setdefault(url.split("/")[2], []).append(pages.blocks_of(page))
    for i, url, page in rows:
        own = hosts[url.split("/")[2]]
        shares = [pages.asides_of(b) for b in own]
        lifted = {p for s in shares for p in s if sum(1 if t[p] >= 0.5 else -1 for t in shares if p in t) > 0}
        score = {}
        for b in own:
            mine = pages.scores_of(pages.without_asides(b, lifted))
            for path, s in mine.items():
                score[path] = score.get(path, 0) + round(s / max(mine.values()), 6)
        best = max(score, key=lambda p: (round(score[p], 3), p))
        blocks = pages.without_asides(pages.blocks_of(page), lifted)
        inside = [[t for n, t in blocks if any(x.path == p for x in n.around())] for p in (best, pages.parent_of(best))]
        assert got[i] == "\n".join(inside[1] if len(inside[0]) < len(inside[1]) else inside[0])
        assert got[i].startswith(f"Title {i}\nw")


def test_article_in_sibling_containers(spark):
    """A headline and parts beside the longest container belong to the article; links and what all pages have alike do not."""
    inner = '<div class="post"><h1><a href="/">Title %d</a></h1><div class="intro"><p>%s</p></div><div class="text"><p>%s</p></div></div>'
    intro, body = "intro %d words " * 20, "body %d words " * 100
    post = lambda i: inner % (i, (intro % ((i,) * 20)).strip(), (body % ((i,) * 100)).strip())
    want = lambda i: "\n".join([f"Title {i}", (intro % ((i,) * 20)).strip(), (body % ((i,) * 100)).strip()])
    linked = "<body><div class=w-1/2>%s<div class=x><p><a href=/1>one</a> <a href=/2>other</a></p></div></div></body>"
    alike = "<body><div class=wrap>%s<div class=x><p>The same words below every page.</p></div></div></body>"
    rows = [(i, "http://a.example/", linked % post(i)) for i in range(5)] + [(10 + i, "http://b.example/", alike % post(10 + i)) for i in range(5)]
    rows += [(20, "http://c.example/", linked % post(20))]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert got == {r[0]: want(r[0]) for r in rows}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sample_pages(spark, folder):
    import os

    if not os.path.isdir(folder):
        pytest.skip("sample tables not present")
    wanted = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        art = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", art)]
        wanted[r["page_id"]] = "\n".join(x for x in parts if x)
    got = {r["page_id"]: r["text"] for r in pages.op8_main_text(spark, folder).collect()}
    assert got == wanted


def test_empty(spark):
    assert pages.main_texts(frame(spark, [(1, "", "")]).where("page_id < 0")).collect() == []
