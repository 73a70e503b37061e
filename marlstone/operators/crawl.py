"""A bounded crawl over fetched pages, level by level."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.text import canonical_url
from marlstone.operators.html import sub_links
from marlstone.session import written


def page_links(pages: DataFrame, hosts: set[str], *, url: str = "url", html: str = "html", most: int = 10) -> DataFrame:
    """(url, link, place): up to ``most`` followed links of each page, parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sub_links(h, u, hosts, most) if u and h else [] for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], ["url", "links"])

    parsed = pages.select(canonical_url(F.col(url)).alias("url"), F.col(html).alias("html")).mapInArrow(run, "url string, links array<string>")
    return parsed.select("url", F.posexplode("links").alias("place", "link"))


def frontier(seeds: DataFrame, links: DataFrame, *, depth: int = 2, most_pages: int | None = None) -> DataFrame:
    """(url, level): pages reached from ``seeds`` (url) within ``depth`` links, each at its least level.

    A level is one join of the newest pages with the links and one anti join with all pages seen; levels are written,
    so lineage doesn't grow. With ``most_pages`` the loop ends after the level that reaches the number, and the first pages
    in order of level and address stay.
    """
    known = written(seeds.select(canonical_url(F.col("url")).alias("url"), F.lit(0).alias("level")).where("url <> ''").distinct(), "level")
    newest, n = known, known.count()
    for level in range(1, depth + 1):
        if most_pages is not None and n >= most_pages:
            break
        met = newest.join(links, "url").select(F.col("link").alias("url")).distinct()
        fresh = written(met.join(known, "url", "left_anti").withColumn("level", F.lit(level)), "level")
        added = fresh.count()
        if not added:
            break
        known, newest, n = known.unionAll(fresh), fresh, n + added
    return known if most_pages is None else known.orderBy("level", "url").limit(most_pages)


def within_limit(found: DataFrame, order: str, score: str, least: float, most: int) -> DataFrame:
    """Rows with a score of ``least`` or more, in order, until ``most`` are approved; the best are picked before they meet."""
    ok = found.where(F.col(score) >= least).orderBy(order).limit(most)
    return ok.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)).cast("bigint"))  # at most ``most`` rows


def ended(pages: DataFrame, crawl: str, order: str, chunks: str, goal: int) -> DataFrame:
    """The pages that a crawl tries before it ends: those before which fewer than ``goal`` chunks were found. A crawl's pages are bounded by its own limits."""
    before = F.coalesce(F.sum(chunks).over(W.partitionBy(crawl).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("_before", before).where(F.col("_before") < goal).drop("_before")
