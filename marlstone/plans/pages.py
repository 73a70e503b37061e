"""Queries over fetched pages and stored files. No table holds markup or files, so a few are written out here, and their results as SQL values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.text import canonical_url, host
from marlstone.operators import crawl, html
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.session import ensure_checkpoint_dir, ship_package
from marlstone.sources import files

_GOOD = "A check takes ten days. Ask the office if it takes more."
SITE = "https://a.example"
#: (url, html): a main part with noise and capitals, a page of blocks only, an article with links, one without markup, one that is empty, one not fetched.
PAGES = [
    (f"{SITE}/1", f"<body><nav>Home</nav><main><h2>Checks</h2><p>{_GOOD}</p><p>Subscribe now. It is free.</p></main><p>Keep the slip. It names the office.</p></body>"),
    (f"{SITE}/2", f"<div class='Page-Content'><p>{_GOOD}</p><li>READ THIS NOW. IT IS LOUD.</li><p>Bring a card. Sign it there.</p><p>Wait a week. Then call.</p></div>"),
    (f"{SITE}/3", "<article><a href='/advice/x#top'>x</a><a href='/advice/x'>x</a><a href='guidance/y/'>y</a><a href='/shop/z'>z</a><a href='mailto:a@b'>m</a><a href='https://b.example/report/w'>w</a></article>"),
    (f"{SITE}/4", "Plain words. No markup at all."), (f"{SITE}/5", ""), (f"{SITE}/6", None),
]


def _pages(spark):
    ship_package(spark)
    return spark.createDataFrame(PAGES, "url string, html string")


def _rows(rows: list[tuple], names: str) -> str:
    one = lambda v: "null" if v is None else S.q(v) if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as v({names})"


LINES = [
    (1, "Checks", "semantic_paragraph"), (1, _GOOD, "kept"), (1, "Subscribe now. It is free.", "noise_phrase"), (1, _GOOD, "fallback"), (1, "Keep the slip. It names the office.", "fallback"),
    (2, _GOOD, "kept"), (2, "READ THIS NOW. IT IS LOUD.", "semantic_paragraph"), (2, "Bring a card. Sign it there.", "kept"), (2, "Wait a week. Then call.", "kept"),
    *((3, x, "semantic_paragraph") for x in "xxyzmw"), (4, "Plain words. No markup at all.", "kept"), (4, "Plain words. No markup at all.", "fallback"),
]


@register("page_stages", _rows([(f"{SITE}/{n}", x, s) for n, x, s in LINES], "url, text, stage"))
def page_stages(spark, folder):
    """Every line of each page, kept or rejected with the reason, with further lines of the whole page where few are kept."""
    return html.page_lines(_pages(spark)).select("url", "text", "stage")


@register("page_bodies", _rows([(f"{SITE}/1", f"{_GOOD}\n{_GOOD}\nKeep the slip. It names the office."), (f"{SITE}/2", f"{_GOOD}\nBring a card. Sign it there.\nWait a week. Then call."), (f"{SITE}/4", "Plain words. No markup at all.\nPlain words. No markup at all.")], "url, text"))
def page_bodies(spark, folder):
    return html.page_texts(html.page_lines(_pages(spark)))


@register("page_links", _rows([(f"{SITE}/3", 0, f"{SITE}/advice/x"), (f"{SITE}/3", 1, f"{SITE}/guidance/y")], "url, place, link"))
def page_links(spark, folder):
    """The links worth following: of an allowed host, on a path of advice, each once."""
    return crawl.page_links(_pages(spark), {"a.example"}).select("url", "place", "link")


SITEMAPS = [("a", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.example/advice/1#x </loc></url><url><loc>https://a.example/shop/2</loc></url><url><loc>https://c.example/report/3/</loc></url></urlset>'), ("b", "<urlset/>")]


@register("sitemap_links", _rows([("a", "https://a.example/advice/1")], "site, link"))
def sitemap_links(spark, folder):
    """Addresses of a sitemap under the rules for links."""
    s = spark.createDataFrame(SITEMAPS, "site string, xml string")
    link = s.select("site", F.explode(html.sitemap_urls("xml")).alias("raw")).select("site", canonical_url(F.trim("raw")).alias("link"))
    return link.where((host(F.col("link")) == "a.example") & F.concat("link", F.lit("/")).rlike("(?i)/(?:guidance|advice|decision|report)/")).distinct()


#: (page, pages it links to), the pages that were fetched, and chunks that each gives.
WEB = {"s": "abc", "a": "sd", "b": "de", "c": "", "d": "f", "e": "a", "f": "g"}
GOAL = 3


def _reach(depth: int) -> dict[str, int]:
    level, newest = {"s": 0}, ["s"]
    for n in range(1, depth + 1):
        newest = [y for y in dict.fromkeys(z for x in newest for z in WEB.get(x, "")) if y not in level]
        level.update(dict.fromkeys(newest, n))
    return level


@register("crawl_levels", """
with recursive l(a, b) as (values {0}), r(url, level) as (select 's', 0 union all select distinct l.b, r.level + 1 from r join l on l.a = r.url where r.level < 3)
select 'https://w.example/' || url as url, min(level) as level from r group by url""".replace("{0}", ", ".join(f"({S.q(x)}, {S.q(y)})" for x, ys in WEB.items() for y in ys)))
def crawl_levels(spark, folder):
    """Pages within three links of a seed, each at its least level; every page once."""
    at = lambda x: f"https://w.example/{x}"
    links = spark.createDataFrame([(at(x), at(y)) for x, ys in WEB.items() for y in ys], "url string, link string")
    return crawl.frontier(spark.createDataFrame([(at("s"),)], "url string"), links, depth=3)


@register("crawl_exits", """
with v(n, url, chunks, error) as (values (1, 'a', 2, null), (2, 'b', 0, '403'), (3, 'c', 2, null), (4, 'd', 5, null)), r as (select *, coalesce(sum(chunks) over (order by n rows between unbounded preceding and 1 preceding), 0) as before from v)
select count(*) as tried, sum(chunks)::bigint as chunks, count(error) as errors, case when sum(chunks) >= 3 then 'target_chunk_threshold_reached' else 'frontier_empty' end as reason from r where before < 3""")
def crawl_exits(spark, folder):
    """Why a crawl ends: it stops at the page with which enough chunks are found. One crawl's pages, in order."""
    v = spark.createDataFrame([("x", 1, "a", 2, None), ("x", 2, "b", 0, "403"), ("x", 3, "c", 2, None), ("x", 4, "d", 5, None)], "crawl string, n int, url string, chunks int, error string")
    return crawl.ended(v, "crawl", "n", "chunks", GOAL).groupBy("crawl").agg(
        F.count(F.lit(1)).alias("tried"), F.sum("chunks").alias("chunks"), F.count("error").alias("errors"), F.when(F.sum("chunks") >= GOAL, "target_chunk_threshold_reached").otherwise("frontier_empty").alias("reason")).drop("crawl")


@register("first_scraped", "select n, place::bigint as place from (values (1, 1), (2, 2)) as v(n, place)")
def first_scraped(spark, folder):
    """The first two pages, in order, that gave text."""
    v = spark.createDataFrame([(n, h) for n, (_, h) in enumerate(PAGES, 1)], "n int, html string")
    got = v.select("n", F.when(F.col("html") != "", 1.0).otherwise(0.0).alias("score"))
    return crawl.within_limit(got, "n", "score", 1.0, 2).select("n", "place")


#: Lines of a file of records: good ones, a blank, a broken one, a number and a list.
RECORDS = ['{"key": "a", "sha1": "1"}', "", '{"key": "b"', "7", "[1]", ' {"key": "c", "sha1": null, "more": 1}']


@register("stored_records", _rows([("a", "1"), ("c", None)], "key, sha1"))
def stored_records(spark, folder):
    """Records read back from lines of which some are broken."""
    to = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marlstone-records-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in RECORDS], "value string").coalesce(1).write.text(to)
    return files.read_jsonl(spark, to, files.STATE)


@register("stored_state", "select 'source_state' as name, count(*) as pages, count(distinct sha1) as texts from source_state union all select 'missing', 0, 0")
def stored_state(spark, folder):
    """The state of all pages written and read back, and a state that was never written."""
    from marlstone.sources.tables import read_table

    to = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marlstone-state-{uuid.uuid4().hex}"
    files.write_state(read_table(spark, folder, "source_state").select(F.col("source_url").alias("key"), "sha1"), to)
    n = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("pages"), F.countDistinct("sha1").alias("texts"))
    return n(files.read_state(spark, to), "source_state").unionAll(n(files.read_state(spark, to + "-none"), "missing"))


METADATA = '[{"file_stem": "a", "title": "One", "authority_score": 7}, {"file_stem": "", "title": "x"}, {"file_stem": "a", "title": "Two"}, {"file_stem": "b", "jurisdiction": "NZ", "authority_score": 0.25, "approved": true}]'


@register("stored_metadata", "select * from (values ('a', 'Two', 0.5::double, 'AU', false), ('b', null, 0.25::double, 'NZ', true)) as v(file_stem, title, authority_score, jurisdiction, approved)")
def stored_metadata(spark, folder):
    """Metadata of files by stem: the last record of a stem wins, with defaults."""
    to = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marlstone-metadata-{uuid.uuid4().hex}"
    spark.createDataFrame([(METADATA,)], "value string").coalesce(1).write.text(to)
    return files.read_metadata(spark, to).select("file_stem", "title", "authority_score", "jurisdiction", "approved")
