"""Merging of page and score tables: one row per page, reconciliation, renormalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.urls import normalize_url
from tarnweave.session import sized


def longest_page(pages: DataFrame, id_col: str = "id") -> DataFrame:
    """One row `url, id, text` per normalised URL: the longest text, the least id among equals; null texts are ''. Rows without URL are dropped.

    Only texts of URLs that stand on several rows are shuffled; all others pass through.
    """
    rows = pages.where("url is not null").select(normalize_url(F.col("url")).alias("url"), F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    several = sized(rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url"))
    best = rows.join(several, "url", "left_semi").groupBy("url").agg(F.max_by(F.struct("id", "text"), F.struct(F.length("text"), -F.col("id"))).alias("b")).select("url", "b.id", "b.text")
    return rows.join(several, "url", "left_anti").select("url", "id", "text").unionByName(best)


def best_score(scores: DataFrame) -> DataFrame:
    """`url, score`: the greatest score per normalised URL; null scores count 0."""
    rows = scores.where("url is not null").select(normalize_url(F.col("url")).alias("url"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.groupBy("url").agg(F.max("score").alias("score"))


def join_ranks(ranks: DataFrame, pages: DataFrame) -> DataFrame:
    """`id, url, score`: ranks of known pages, rescaled to sum 1 (as they are if their sum is not positive)."""
    last = pages.groupBy("id").agg(F.max("url").alias("url"))
    kept = ranks.join(last, "id").select("id", "url", "score")
    total = kept.agg(F.sum("score").alias("total"))
    return kept.crossJoin(F.broadcast(total)).select("id", "url", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(F.col("score")).alias("score"))


def dropped_ranks(ranks: DataFrame, pages: DataFrame) -> DataFrame:
    """Ranks whose node is no page."""
    return ranks.join(pages.select("id").distinct(), "id", "left_anti")


def reconcile_ids(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """`id, missing_from` for ids that stand in one of the tables only."""
    a, b = pages.select("id").where("id is not null").distinct(), ranks.select("id").where("id is not null").distinct()
    return a.join(b, "id", "left_anti").withColumn("missing_from", F.lit("ranks")).unionByName(b.join(a, "id", "left_anti").withColumn("missing_from", F.lit("pages")))
