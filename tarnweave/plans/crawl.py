"""Crawl over a snapshot table of fetched pages (url, status, content_type, html): breadth first, one level a round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions import html as H
from tarnweave.functions import urls as U
from tarnweave.session import BROADCAST_ROWS, cut, cut_counted, ship

MAX_BYTES = 2_000_000


@dataclass
class Crawl:
    """`pages(id, url, text)`, `url_edges(source_url, target_url)` with duplicates, `url_ids(url, id)`, `visited(url, depth)`."""

    pages: DataFrame
    url_edges: DataFrame
    url_ids: DataFrame
    visited: DataFrame

    def edges(self, dedup: bool = False) -> DataFrame:
        return map_edges(self.url_edges, self.url_ids, dedup)

    def statistics(self) -> DataFrame:
        """One row: visited, indexed, urls, edges."""
        parts = [self.visited, self.pages, self.url_ids, self.url_edges]
        out = None
        for name, p in zip(("visited", "indexed", "urls", "edges"), parts, strict=True):
            one = p.agg(F.count(F.lit(1)).alias(name))
            out = one if out is None else out.crossJoin(one)
        return out


def acceptable(snapshot: DataFrame) -> DataFrame:
    """Responses worth parsing: status 200, HTML, not above MAX_BYTES bytes."""
    return snapshot.where((F.col("status") == 200) & F.lower("content_type").contains("text/html") & (F.octet_length("html") <= MAX_BYTES))


def wanted_language(lang, target: str | None):
    """Pages of unknown language pass; `target` is a prefix."""
    return F.lit(True) if not target else lang.isNull() | lang.startswith(target.lower())


def map_edges(url_edges: DataFrame, url_ids: DataFrame, dedup: bool = False) -> DataFrame:
    """URL edges as `src, dst`; edges with an unknown end drop out."""
    s = url_ids.select(F.col("url").alias("source_url"), F.col("id").alias("src"))
    t = url_ids.select(F.col("url").alias("target_url"), F.col("id").alias("dst"))
    out = url_edges.join(s, "source_url").join(t, "target_url").select("src", "dst")
    return out.dropDuplicates() if dedup else out


def assign_ids(urls: DataFrame) -> DataFrame:
    """`url, id` from `url, depth`: dense, by the depth at which a URL was first seen, then by URL.

    Two levels, so that no single task sorts all URLs: places inside ranges of (depth, url), shifted by range sizes.
    """
    first = urls.groupBy("url").agg(F.min("depth").alias("depth"))
    parts = cut(first.repartitionByRange(F.col("depth"), F.col("url")).withColumn("part", F.spark_partition_id()))
    shift = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("depth", "url"))
    return parts.withColumn("place", place).join(F.broadcast(shift), "part").select("url", (F.col("place") - 1 + F.col("before")).cast("long").alias("id"))


def crawl(snapshot: DataFrame, start_url: str, max_pages: int = 100, target_lang: str | None = None) -> Crawl:
    """Follows links of the start URL's base domain; `max_pages` bounds the visited URLs, failures included.

    Links are those left after boilerplate is taken out of a page. Targets become nodes even if never visited. Ids
    and the order of visits are by depth, then URL, so that two runs agree. `snapshot` holds one row per normalised
    URL; a URL without row is a failed fetch.
    """
    start_url = (start_url or "").strip()
    if not start_url.startswith("http"):
        raise ValueError("the start URL must begin with http")
    spark = snapshot.sparkSession
    ship(spark)
    start = spark.range(1).select(U.normalize_url(F.lit(start_url)).alias("url"))
    base = start.select(U.base_domain(U.netloc(F.col("url"))).alias("b")).first()["b"]
    frontier, visited, depth, budget = cut(start), None, 0, max_pages
    pages, links = [], []
    while budget > 0:
        level, seen = cut_counted(frontier.orderBy("url").limit(budget).withColumn("depth", F.lit(depth)))
        if not seen["rows"]:
            break
        budget -= seen["rows"]
        visited = level if visited is None else cut(visited.unionByName(level))
        urls = level.select("url")
        found = acceptable(snapshot.join(F.broadcast(urls) if seen["rows"] <= BROADCAST_ROWS else urls, "url")).withColumn("p", H.parsed(F.col("html")))
        found = cut(found.where(wanted_language(F.col("p.lang"), target_lang)).select("url", F.col("p.text").alias("text"), F.col("p.hrefs").alias("hrefs")))
        out = found.select(F.col("url").alias("source_url"), F.explode("hrefs").alias("href")).select("source_url", U.resolve_link(F.col("source_url"), F.col("href")).alias("u"))
        out = out.where(F.col("u").isNotNull() & ~U.rejected_scheme(F.col("u")) & U.same_domain(F.col("u"), F.lit(base))).select("source_url", U.normalize_url(F.col("u")).alias("target_url"))
        out = cut(out)
        pages.append(found.select("url", "text", F.lit(depth).alias("depth")))
        links.append(out.withColumn("depth", F.lit(depth + 1)))
        left = frontier.join(level, "url", "left_anti")
        frontier = cut(left.unionByName(out.select(F.col("target_url").alias("url"))).distinct().join(visited, "url", "left_anti"))
        depth += 1
    all_pages, all_links = pages[0], links[0]
    for p, x in zip(pages[1:], links[1:], strict=True):
        all_pages, all_links = all_pages.unionByName(p), all_links.unionByName(x)
    known = all_pages.select("url", "depth").unionByName(all_links.select(F.col("target_url").alias("url"), "depth"))
    ids = cut(assign_ids(known))
    return Crawl(all_pages.join(ids, "url").select("id", "url", "text"), all_links.select("source_url", "target_url"), ids, visited)
