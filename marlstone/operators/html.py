"""Text, links and rejected lines of HTML pages, by the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import filters as P
from marlstone.functions.text import cleaned

# Elements without content, elements that blocks of text stand in, and those that never close.
DROPPED = {"script", "style", "noscript", "header", "footer", "nav", "form"}
BLOCKS = {"h1", "h2", "h3", "h4", "p", "li", "blockquote"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Fixed value: paths of pages that are worth following.
FOLLOWED = re.compile(r"/(guidance|advice|decision|report)/", re.I)


class _Tree(HTMLParser):
    """A tolerant tree of [tag, attributes, children]; text nodes are strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and any(x[0] == "p" for x in self.open[1:]):
            self.handle_endtag("p")
        if tag == "li" and self.open[-1][0] == "li":
            self.handle_endtag("li")
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tree_of(html: str | None) -> list:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def walk(node: list) -> Iterator[list]:
    """Elements below ``node`` in document order, without dropped ones; no recursion, so depth doesn't matter."""
    todo = [x for x in reversed(node[2]) if isinstance(x, list)]
    while todo:
        x = todo.pop()
        if x[0] not in DROPPED:
            yield x
            todo += [y for y in reversed(x[2]) if isinstance(y, list)]


def strings(node: list) -> list[str]:
    out, todo = [], list(reversed(node[2]))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif x[0] not in DROPPED:
            todo += reversed(x[2])
    return out


def content_root(root: list) -> list:
    """main, else article, else a div whose class speaks of content or body, else the body or the whole."""
    all_ = list(walk(root))
    for wanted in (lambda x: x[0] == "main", lambda x: x[0] == "article", lambda x: x[0] == "div" and "content" in (x[1].get("class") or "").lower(), lambda x: x[0] == "div" and "body" in (x[1].get("class") or "").lower(), lambda x: x[0] == "body"):
        for x in all_:
            if wanted(x):
                return x
    return root


def block_lines(html: str | None) -> tuple[list[str], list[str]]:
    """Lines of the content root's blocks (its text lines if it has no blocks), and all text lines of the page."""
    root = tree_of(html)
    main = content_root(root)
    blocks = [" ".join(strings(x)) for x in walk(main) if x[0] in BLOCKS]
    return (blocks or strings(main)), strings(root)


def sub_links(html: str | None, base: str, hosts: set[str], limit: int = 10) -> list[str]:
    """Addresses of the content root's links on allowed hosts and worthwhile paths, each once, in order."""
    out: dict[str, None] = {}
    for x in walk(content_root(tree_of(html))):
        href = (x[1].get("href") or "").strip() if x[0] == "a" else ""
        if href and not href.lower().startswith(("#", "mailto:", "javascript:")):
            url = urljoin(base, href).split("#")[0].strip().rstrip("/")
            if urlparse(url).netloc.lower() in hosts and FOLLOWED.search(urlparse(url).path + "/"):
                out.setdefault(url)
    return list(out)[:limit]


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [block_lines(h) for h in b.column(1).to_pylist()]
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], kind)], ["url", "blocks", "page"])


def page_lines(pages: DataFrame, *, url: str = "url", html: str = "html", fallback_below: int = 3) -> DataFrame:
    """(url, line_no, text, stage): the lines of each page, kept or rejected, parsed in Python and judged in the JVM.

    Stages: kept, noise_phrase, semantic_paragraph, and fallback for lines of the whole page that pass where fewer than
    ``fallback_below`` block lines do. Null and empty pages give nothing.
    """
    parsed = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where("html is not null").mapInArrow(_line_batches, "url string, blocks array<string>, page array<string>")
    own = lambda c: F.filter(F.transform(c, lambda x: cleaned(F.replace(x, F.lit("\xa0"), F.lit(" ")))), lambda x: x != "")
    good = lambda x: ~P.has_noise(x) & P.is_semantic(x)
    lines = parsed.select("url", own(F.col("blocks")).alias("blocks"), own(F.col("page")).alias("page"))
    few = F.size(F.filter("blocks", good)) < fallback_below
    more = F.when(few, F.filter("page", good)).otherwise(F.array().cast("array<string>"))
    at = lines.select("url", F.size("blocks").alias("n"), F.posexplode(F.concat("blocks", more)).alias("line_no", "text"))
    stage = F.when(F.col("line_no") >= F.col("n"), "fallback").when(P.has_noise(F.col("text")), "noise_phrase").when(~P.is_semantic(F.col("text")), "semantic_paragraph").otherwise("kept")
    return at.select("url", "line_no", "text", stage.alias("stage"))


def page_texts(lines: DataFrame) -> DataFrame:
    """(url, text): kept and fallback lines of each page in order; a page's lines are few."""
    kept = lines.where("stage in ('kept', 'fallback')")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("url").agg(cleaned(text).alias("text"))


def sitemap_urls(xml: str):
    """Column of the addresses in a sitemap's column ``xml``."""
    return F.xpath(F.col(xml), F.lit('//*[local-name()="loc"]/text()'))
