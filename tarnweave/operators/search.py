"""Top-k search: TF-IDF cosine, and a hybrid with link authority."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import text as T
from tarnweave.operators.index import Index

OVERFETCH = 3
TEXT_SHARE = 0.8


def query_terms(index: Index, query: str) -> DataFrame:
    """`term, qw`, known terms only. A query's terms are few, so they are literals."""
    freq = Counter(T.tokenize_query(query))
    spark = index.terms.sparkSession
    if not freq:
        return index.terms.where("false").select("term", F.lit(0.0).alias("qw"))
    rows = spark.createDataFrame(sorted(freq.items()), "term string, freq long")
    return index.terms.where(F.col("term").isin(sorted(freq))).join(F.broadcast(rows), "term").select("term", (F.col("freq") * F.col("idf")).alias("qw"))


def cosine_scores(index: Index, query: str, include_zero: bool = False) -> DataFrame:
    """`doc_id, score` of documents that share a known term with the query; with `include_zero` of all indexed documents, if any query term is known."""
    q = query_terms(index, query)
    hit = index.postings.where(F.col("term").isin(sorted(set(T.tokenize_query(query))))) if T.tokenize_query(query) else index.postings.where("false")
    dots = hit.join(F.broadcast(q), "term").groupBy("doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"))
    q_norm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm")).where("q_norm is not null")
    scored = index.docs.join(dots, "doc_id", "left" if include_zero else "inner").crossJoin(F.broadcast(q_norm))
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0) * F.when(F.col("q_norm") > 0, F.col("q_norm")).otherwise(1.0)
    return scored.select("doc_id", (F.coalesce("dot", F.lit(0.0)) / norm).alias("score"))


def tfidf_search(index: Index, query: str, top_k: int = 10, include_zero: bool = False) -> DataFrame:
    """`doc_id, score`, best first; scores equal at 9 decimals are ordered by id."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    rounded = cosine_scores(index, query, include_zero).withColumn("score", F.round("score", 9))
    return rounded.orderBy(F.desc("score"), "doc_id").limit(top_k)


def scaled_ranks(scores: DataFrame) -> DataFrame:
    """`url, raw, norm` with norm min-max scaled over all URLs."""
    span = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return scores.crossJoin(F.broadcast(span)).select("url", F.col("score").alias("raw"), T.min_max(F.col("score"), F.col("low"), F.col("high")).alias("norm"))


def hybrid_search(index: Index, pages: DataFrame, ranks: DataFrame, query: str, top_k: int = 10, text_share: float = TEXT_SHARE) -> DataFrame:
    """`url, snippet, tfidf_score, pagerank_score, combined_score` of the best pages.

    `index` is over `pages(url, text)` with the URL as document; `ranks(url, raw, norm)`. The 3 * top_k best by text
    are re-ranked by share * text + (1 - share) * norm; a page without rank counts 0. Texts are read for the final
    rows only.
    """
    if not query:
        raise ValueError("empty query")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    found = tfidf_search(index, query, OVERFETCH * top_k).withColumnRenamed("doc_id", "url")
    both = ranks.join(F.broadcast(found), "url", "right").select("url", F.col("score").alias("tfidf_score"), F.coalesce("raw", F.lit(0.0)).alias("pagerank_score"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    both = both.withColumn("combined_score", F.round(text_share * F.col("tfidf_score") + (1 - text_share) * F.col("norm"), 9))
    best = both.orderBy(F.desc("combined_score"), "url").limit(top_k)
    return pages.select("url", "text").join(F.broadcast(best), "url").select("url", T.snippet(F.col("text"), query).alias("snippet"), "tfidf_score", F.round("pagerank_score", 12).alias("pagerank_score"), "combined_score").orderBy(F.desc("combined_score"), "url")
