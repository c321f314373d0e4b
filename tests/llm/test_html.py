"""Main text by wrapper induction."""

from __future__ import annotations

import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from framelore.llm import html_main

DATA = "/root/testdata/sf0.01"
COLUMNS = "page_id long, url string, html string, host string, key string, text string"


def texts(spark, rows, **options):
    """page_id -> text; the input has columns named like the output's and the operator's own."""
    found = html_main.extract(spark.createDataFrame([(*r, "h", "k", "t") for r in rows], COLUMNS), **options)
    assert found.columns == ["page_id", "url", "text"]
    return {r["page_id"]: r["text"] for r in found.collect()}


PAGE = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><div class="cookie-notice">we use</div>%s<aside>side</aside><div id="comments"><p>me too</p></div><footer>&copy; x</footer></body></html>'


def test_main_text(spark):
    rows = [(1, "http://a.example/1", PAGE % "<article><h1>Head &amp; <b>bo</b>ld</h1><p>One<p>two  &eacute;<br>three<div class='ad'>buy</div><form><input>go</form></article>"), (2, None, None), (3, "x", ""), (4, "http://a.example/4", "plain <p>text"), (5, "http://a.example/5", PAGE % "<main><p>only main</p></main>")]
    rows += [(10 + i, f"http://b.example/{i}", f"<body><div class='top'>Always the same</div><div class='box'><p>Story {i} is new</p></div></body>") for i in range(12)]
    got = texts(spark, rows)
    assert got[1] == "Head & bold One two é three" and got[2] == got[3] == "" and got[4] == "plain text" and got[5] == "only main"
    assert all(got[10 + i] == f"Story {i} is new" for i in range(12))
    joined = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), max_bytes=0).collect()}
    assert joined == got
    assert texts(spark, rows, max_bytes=0) == got


class Article(HTMLParser):
    """The text of the article element, read by another parser."""

    def __init__(self, text):
        super().__init__()
        self.inside, self.out = 0, []
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out.append(" " if tag != "b" else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out.append(" " if tag != "b" else "")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_by_brute_force_and_under_other_names(spark):
    """Every page of the table has its main text in an article element; without that name and with other classes the wrappers find the same text."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    want = {i: " ".join("".join(Article(t or "").out).split()) for i, _, t in rows}
    assert sum(map(bool, want.values())) > 240
    assert texts(spark, rows) == want
    other = lambda t: re.sub(r'class="', 'class="q', re.sub(r"<(/?)article", r"<\1div", t))
    assert all("article" not in other(t) for _, _, t in rows[:5])
    assert texts(spark, [(i, u, t and other(t)) for i, u, t in rows]) == want


def story(i, n=6):
    draw = random.Random(i)
    return [" ".join(f"w{draw.randrange(10_000)}" for _ in range(12)) for _ in range(n + i % 3)]


def page(i, body):
    return f"<html><body>{body}</body></html>".replace("STORY", "".join(f"<p>{t}</p>" for t in story(i)))


NOTICE = "This long notice says the same on every page. " * 20


@pytest.mark.parametrize("body", [
    "<article><h1>T</h1>STORY<div class='x1'>Write to us and get a letter each week</div><span>Tell others</span></article>",
    "<div>Home News Sport</div><div>STORY</div><div>All texts belong to us</div>",
    f"<div><div>{NOTICE}</div>STORY</div>",
    "<section>" * 60 + "<div class='a'>Always here</div><div class='b'>STORY</div>" + "</section>" * 60,
    "<article><h1>T</h1>STORY<p>Write to us and get a letter each week</p></article>",
    f"<article><p>Shared first words</p><div><div>STORY</div><div><p>{NOTICE}</p></div></div></article>",
], ids=["in an article", "siblings without a class", "long", "deep", "a paragraph", "longer than the text"])
def test_what_all_pages_share_is_template(spark, body):
    rows = [(i, f"http://t.example/{i}", page(i, body)) for i in range(20)]
    rows[0] = (0, "http://t.example/0", page(0, body.replace("STORY", "STORY<p>only here</p>").replace("Home News", "Start")))
    for order in (rows, rows[::-1]):
        got = texts(spark, order)
        for i in range(1, 20):
            kept = re.sub(r"^T ", "", got[i])
            assert kept == " ".join(story(i)), (i, got[i][:200])


@pytest.mark.parametrize("body", ["<header><h1>Head</h1></header><div>STORY</div>", "<p>Head</p><blockquote>STORY</blockquote>", "<p>Head</p><div>STORY</div>", "<h2>Head</h2><section>STORY</section>", "<p>Head</p><ul><li>STORY</li></ul>"])
def test_the_region_holds_what_stands_beside_the_text(spark, body):
    """Titles, leads, quotes and lists within the article are of it, however it is divided; what stands beside the article is not."""
    rows = [(i, f"http://r.example/{i}", page(i, f"<header>Site {i * 7}</header><div>Buy {i * 13} now</div><article>{body.replace('Head', f'Head {i}')}</article><div>See {i * 3} more</div>")) for i in range(8)]
    got = texts(spark, rows)
    assert all(got[i] == " ".join([f"Head {i}", *story(i)]) for i in range(8)), got[1][:200]


def test_copies_of_an_article_are_no_template(spark):
    """Pages of one host with one article, menus and footers apart, and one that differs from it in a word."""
    draw = random.Random(2)
    around = lambda: " ".join(f"m{draw.randrange(1000)}" for _ in range(5))
    body = lambda: f"<nav>{around()}</nav><div>{around()}</div><article><h1>Head</h1>STORY</article><footer>{around()}</footer>"
    rows = [(i, f"http://c.example/{i}", page(7, body())) for i in range(40)] + [(50, "http://c.example/50", page(7, body()).replace(story(7)[2], story(7)[2] + " changed"))]
    got = texts(spark, rows)
    assert all(got[i] == " ".join(["Head", *story(7)]) for i in range(40)) and got[50].endswith(" ".join(story(7)[3:])) and "changed" in got[50]


def test_rows(spark):
    rows = [(1, "http://a.example/1", page(1, "STORY")), (1, "http://a.example/1", page(1, "STORY")), (None, None, page(2, "STORY")), (3, "no host", None), (4, None, "")]
    found = html_main.extract(spark.createDataFrame([(*r, "h", "k", "t") for r in rows], COLUMNS)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == sorted([(1, " ".join(story(1))), (1, " ".join(story(1))), (0, " ".join(story(2))), (3, ""), (4, "")])
    assert texts(spark, []) == {}
    long = page(1, "STORY" * 2000)
    assert texts(spark, [(1, "http://a.example", long)])[1] == " ".join(story(1) * 2000)


def test_merged_trees_hold_every_page():
    """Whatever the order, every node of every page has its place, and repeated nodes are those whose number differs."""
    bodies = ["<div class=a>x</div><p>x</p><p>y</p><div class=b><ul><li>1<li>2</ul></div>", "<p>x</p><div class=b><ul><li>1<li>2<li>3</ul></div>", "<div class=a>x</div><p>x</p><p>y</p>", "<div class=b><ul><li>1<li>2</ul></div><p>z</p>"]
    pages = [html_main.Page(f"<body>{b}</body>") for b in bodies]
    draw = random.Random(1)
    for _ in range(10):
        draw.shuffle(pages)
        whole = html_main.tree(pages[0])
        for p in pages[1:]:
            whole = html_main.merge(whole, html_main.tree(p), {})
        told = html_main.dump(whole)
        assert html_main.dump(html_main.load(told)) == told
        for p in pages:
            assert -1 not in html_main.numbers(html_main.tree(p), html_main.load(told), len(p.label))
        assert '["li",0,[]]' in told and told.count('"ul"') == 1


def test_simple_tree_matching_by_brute_force():
    def draw_tree(draw, deep):
        return [draw.choice("abc"), [draw_tree(draw, deep - 1) for _ in range(draw.randrange(4))] if deep else []]

    def best(a, b):
        if a[0] != b[0]:
            return 0

        def lists(x, y):
            if not x or not y:
                return 0
            return max(lists(x[1:], y), lists(x, y[1:]), best(x[0], y[0]) + lists(x[1:], y[1:]))

        return 1 + lists(a[1], b[1])

    def runs(t):  # each child a run of its own
        return [t[0], [[0, [runs(k)]] for k in t[1]], 0, 0]

    draw = random.Random(3)
    for _ in range(200):
        a, b = draw_tree(draw, 3), draw_tree(draw, 3)
        b[0] = a[0]
        x, y = runs(a), runs(b)
        assert html_main.score(x, y, {}) == best(a, b)


@pytest.mark.parametrize("told", ["<a \"" * 250_000, "<b>x</p>" * 120_000, "<div>" * 100_000 + "x", "<a x=\"y " * 100_000, "<a b=\"' " * 60_000 + ">" + "<a b=\">'" * 60_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<" * 500_000, "<a " + "= " * 300_000], ids=range(8))
def test_odd_pages_take_linear_time(told):
    start = time.process_time()
    html_main.parse(told[: len(told) // 4])
    middle = time.process_time()
    html_main.parse(told)
    assert time.process_time() - middle < 12 * (middle - start) + 0.5  # four times the text
