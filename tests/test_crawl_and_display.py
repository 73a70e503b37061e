"""The bounded crawl against a plain search, and markdown as HTML."""

import random

from marlstone.functions import display
from marlstone.operators import crawl


def test_frontier_equals_breadth_first_search(spark):
    r = random.Random(6)
    urls = [f"https://x.example/advice/{i}" for i in range(80)]
    out = {u: r.sample(urls, r.randint(0, 4)) for u in urls}
    pages = [(u, "<main>" + "".join(f'<a href="{v}#a">v</a>' for v in vs) + '<a href="https://y.example/advice/1">y</a></main>') for u, vs in out.items()] + [("https://x.example/none", None)]
    links = crawl.page_links(spark.createDataFrame(pages, "url string, html string"), {"x.example"})
    seeds = spark.createDataFrame([(urls[0] + "/",), (urls[1],), ("",)], "url string")
    got = {x.url: x.level for x in crawl.frontier(seeds, links, depth=3).collect()}
    level = {urls[0]: 0, urls[1]: 0}
    newest = list(level)
    for n in (1, 2, 3):
        newest = [v for v in dict.fromkeys(v for u in newest for v in out[u]) if v not in level]
        level.update(dict.fromkeys(newest, n))
    assert got == level
    few = crawl.frontier(seeds, links, depth=3, most_pages=3).collect()
    assert len(few) == 3 and {x.url for x in few if x.level == 0} == {urls[0], urls[1]}
    assert crawl.frontier(seeds.where("false"), links).count() == 0


def test_within_limit(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)], "n int, score double")
    got = crawl.within_limit(df, "n", "score", 7.0, 4).collect()
    assert [(x.n, x.place) for x in got] == [(7, 1), (8, 2), (9, 3), (17, 4)]


def test_shown():
    text = "# A *b*\n- one\n- [two](u)\n1. x\n> q\n\nplain <b> `c`\n---\n[two](u) [two](u)"
    want = '<h1>A <em>b</em></h1><ul><li>one</li><li><a href="u" rel="noopener">two</a></li></ul><ol><li>x</li></ol><blockquote><p>q</p></blockquote><p>plain &lt;b&gt; <code>c</code></p><hr /><p><a href="u" rel="noopener">two</a> two</p>'
    assert display.shown(text) == want and display.shown(None) is None and display.shown("") == ""


def test_shown_drafts(spark):
    df = spark.createDataFrame([("a", "# t", "x"), ("b", None, "x")], "id string, draft string, k string")
    assert {tuple(r) for r in display.with_shown(df, text="draft", key="id").collect()} == {("a", "<h1>t</h1>"), ("b", None)}
