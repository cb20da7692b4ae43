"""Whole flows: corpus build, rank of a site, search over page and rank tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators import index, merge, search
from tarnweave.operators.pagerank import pagerank, top_ranks
from tarnweave.plans.crawl import Crawl, crawl
from tarnweave.session import cut
from tarnweave.sources import sinks


@dataclass
class SearchTables:
    pages: DataFrame
    ranks: DataFrame
    index: index.Index

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        return search.hybrid_search(self.index, self.pages, self.ranks, query, top_k)


def search_tables(pages: DataFrame, scores: DataFrame) -> SearchTables:
    """Deduplicated pages, min-max scaled ranks and a text index keyed by URL."""
    merged = cut(merge.longest_page(pages))
    ranks = search.scaled_ranks(merge.best_score(scores))
    return SearchTables(merged, ranks, index.build(merged, "url"))


def rank_site(snapshot: DataFrame, url: str, max_pages: int = 30, top_k: int = 20, lang: str | None = None) -> dict[str, DataFrame]:
    """Crawl from `url` and rank: tables pages(node_id, url, rank, score), nodes, edges, counts."""
    found = crawl(snapshot, url, max_pages, lang)
    edges = cut(found.edges())
    if edges.isEmpty():
        raise ValueError("no edges found")
    top = top_ranks(pagerank(edges).ranks, top_k).join(found.url_ids, "id", "left")
    ranked = top.select(F.col("id").alias("node_id"), F.coalesce("url", F.concat(F.lit("node-"), F.col("id").cast("string"))).alias("url"), F.col("place").alias("rank"), F.col("rank").alias("score")).orderBy("rank")
    return {"pages": ranked, "nodes": found.url_ids, "edges": edges, "counts": found.statistics()}


def rank_envelope(site: dict[str, DataFrame], start_url: str) -> DataFrame:
    """One row for what `rank_site` gives: start_url, page_count, edge_count, pages by rank, nodes, edges. Sites of a request's size only: they are gathered in one row."""
    edges = site["edges"].withColumnsRenamed({"src": "from", "dst": "to"})
    gathered = [site[name].agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)) for name, columns in (("pages", ("rank", "node_id", "url", "score")), ("nodes", ("id", "url")))]
    gathered.append(edges.agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("edges")))
    counts = site["counts"].select(F.col("indexed").alias("page_count"))
    out = counts
    for part in gathered:
        out = out.crossJoin(part)
    return out.select(F.lit(start_url).alias("start_url"), "page_count", F.size("edges").alias("edge_count"), "pages", "nodes", "edges")


def file_envelope(top: DataFrame) -> DataFrame:
    """One row with `top`, what `rank_file` gives, best first, ties by node; null and an `error` if there is none."""
    rows = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "node", "score"))).alias("t"))
    return rows.select(F.when(F.size("t") > 0, F.transform("t", lambda x: F.struct(x.node.alias("node"), x.score.alias("score")))).alias("top"), F.when(F.size("t") == 0, F.lit("no edges")).alias("error"))


def rank_file(edges: DataFrame, top_k: int = 10) -> DataFrame:
    """`node, score` of the best nodes of an edge list."""
    return top_ranks(pagerank(edges).ranks, top_k).select(F.col("id").alias("node"), F.col("rank").alias("score"))


def build_corpus(snapshot: DataFrame, url: str, out: str, *, max_pages: int = 200, damping: float = 0.85, tol: float = 1e-8, max_iter: int = 100, top_k: int = 100_000, lang: str | None = None) -> DataFrame:
    """Crawl, rank over distinct edges, keep ranks of indexed pages, write pages, edges and ranks below `out`. Returns the sum of kept scores."""
    found: Crawl = crawl(snapshot, url, max_pages, lang)
    edges = cut(found.edges(dedup=True))
    sinks.write_json(found.pages.orderBy("id"), f"{out}/pages.json")
    sinks.write_edges(edges, f"{out}/edges.txt")
    ranks = top_ranks(pagerank(edges, damping=damping, tol=tol, max_iter=max_iter).ranks, top_k).select("id", F.col("rank").alias("score"))
    kept = cut(merge.join_ranks(ranks, found.pages))
    if kept.isEmpty():
        raise ValueError("no rank belongs to a page")
    sinks.write_pagerank(kept, f"{out}/pagerank.json")
    return kept.agg(F.sum("score").alias("score_sum"))


def status(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row of counts for a health check."""
    return pages.agg(F.count(F.lit(1)).alias("pages")).crossJoin(ranks.agg(F.count(F.lit(1)).alias("ranks")))
