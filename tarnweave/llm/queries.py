"""Queries of the operators in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm import body, contamination, distinctive_terms, encode, language, near_duplicates, repeated_lines, residue, score_fusion, stuffing
from tarnweave.session import cut

SCORES = {"tfidf_score": 1.0, "pagerank_score": 1.0, "combined_score": 1.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return repeated_lines.repeated_lines(pages, repeated_lines.line_templates(pages))


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.slot_templates(_table(spark, sf_dir, "pages")).select("site", "template", "pages")


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = repeated_lines.repeated_lines(pages, repeated_lines.line_templates(pages))
    return repeated_lines.remove_lines(pages, found).select("id", "text")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fusion.fused_scores(_table(spark, sf_dir, "search_results"), "query_id", "node_id", SCORES, at="served_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fusion.top_fused(_fused(spark, sf_dir), "query_id", "node_id", 3).select("query_id", "node_id")


def p2_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "node_id", F.round("fused", 9).alias("fused"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms.distinctive_terms(_table(spark, sf_dir, "pages"), min_tf=4, min_df=2, max_df=12).select("id", "term")


def p3_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distinctive_terms.distinctive_terms(_table(spark, sf_dir, "pages"))
    return out.select("id", "term", F.round("weight", 9).alias("weight"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.expand_pairs(*near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "pages")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its class of exact copies and the number of the class's links to other texts."""
    members, links = near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "pages"))
    links = cut(links)
    ends = links.select(F.col("class_a").alias("class")).unionByName(links.select(F.col("class_b").alias("class")))
    return members.join(ends.groupBy("class").agg(F.count(F.lit(1)).alias("links")), "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(_table(spark, sf_dir, "pages")).select("id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(_table(spark, sf_dir, "pages"))
    return found.where("line_no >= 0 or label is null or label <> lang").select("id", "line_no", "lang")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(_table(spark, sf_dir, "pages"), skip_residue=False)
    return found.select("id", "line_no", "lang", F.round("confidence", 6).alias("confidence"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.furniture_lines(_table(spark, sf_dir, "pages")).select("id", "line_no")


def p7_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.main_body(_table(spark, sf_dir, "pages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id").distinct()


def p9_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), max_subs=2)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_documents(_table(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_templates, p1_cleaned, p2_found, p2_fused, p3_found, p3_weights, p4_found, p4_classes, p5_found, p6_found, p6_languages, p7_found, p7_bodies, p8_ids, p9_found, p9_tolerant, p10_found)}
