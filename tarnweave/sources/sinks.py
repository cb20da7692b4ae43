"""Writers: edge lists, page and rank files, JSON envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str, dedup: bool = False) -> None:
    """`src dst` a line; rows without an end are left out; with `dedup` each edge once."""
    rows = edges.where("src is not null and dst is not null")
    if dedup:
        rows = rows.dropDuplicates(["src", "dst"])
    rows.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)


def write_edge_csv(edges: DataFrame, path: str) -> None:
    """`source,target_id` with header: the source's URL and the target's id."""
    edges.select("source", "target_id").write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    rows.write.option("ignoreNullFields", False).json(path)


def write_pagerank(ranks: DataFrame, path: str) -> None:
    """`id, url, score`, best first."""
    write_json(ranks.select("id", "url", "score").orderBy(F.desc("score"), "id"), path)


def search_envelope(results: DataFrame, query: str) -> DataFrame:
    """One row: query, count, results in order. Top-k results only, at most 50."""
    rows = results.orderBy(F.desc("combined_score"), "url").agg(F.collect_list(F.struct("combined_score", "url", "snippet", "tfidf_score", "pagerank_score")).alias("r"))
    ordered = F.sort_array("r", False)
    return rows.select(F.lit(query).alias("query"), F.size("r").alias("count"), F.transform(ordered, lambda x: F.struct(x.url.alias("url"), x.snippet.alias("snippet"), x.tfidf_score.alias("tfidf_score"), x.pagerank_score.alias("pagerank_score"), x.combined_score.alias("combined_score"))).alias("results"))
