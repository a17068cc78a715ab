"""Links between stored pages(page_id, url, html) and a level-by-level crawl over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.shared import stored


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, url): each link with its resolved URL."""
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(T.links(F.col("html"))).alias("pos", "href"))
    return rows.select("page_id", "pos", "href", T.resolved_url(F.col("base"), F.col("href")).alias("url"))


def containing(pages: DataFrame, word: str) -> DataFrame:
    """Pages whose source holds the word, case-sensitive."""
    return pages.where(F.contains("html", F.lit(word))).select("page_id", "url")


def frontier(pages: DataFrame) -> DataFrame:
    """(url, first_page): linked URLs that are no stored page."""
    found = page_links(pages).groupBy("url").agg(F.min("page_id").alias("first_page"))
    return found.join(pages.select("url").distinct(), "url", "left_anti")


def crawl(pages: DataFrame, seed: str, max_pages: int, word: str | None = None) -> DataFrame:
    """(level, ord, page_id, url, found): breadth first from the seed, each URL once, first in first out, max_pages at most.

    ord counts the pages of a level that are stored. A loop over levels, each a join of the frontier with the
    stored pages, written to the shared folder.
    """
    spark = pages.sparkSession
    links = page_links(pages)
    found = F.contains("html", F.lit(word)) if word is not None else F.lit(False)
    level, ready = 0, spark.createDataFrame([(seed, (0, 0))], "url string, at struct<ord: long, pos: int>")
    visited, got, out = ready.select("url"), 0, None
    while got < max_pages:
        here = ready.join(pages, "url").groupBy("url").agg(F.min("at").alias("at"), F.min("page_id").alias("page_id"), F.min_by(found, "page_id").alias("found"))
        rows = here.orderBy("at").limit(max_pages - got)
        # The window orders no more rows than the budget has.
        rows = rows.select(F.lit(level).alias("level"), (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("ord"), "page_id", "url", "found")
        rows = stored(rows, "pages")
        out = rows if out is None else out.unionByName(rows)
        n = rows.count()
        got += n
        if not n:
            break
        new = rows.select("page_id", "ord").join(links, "page_id").groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at")).join(visited, "url", "left_anti")
        ready = stored(new, "ready")
        visited = visited.unionByName(ready.select("url"))
        level += 1
    return out
