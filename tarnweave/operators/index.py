"""TF-IDF index: postings, terms and documents as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import text as T
from tarnweave.session import cut, sized


@dataclass
class Index:
    """`postings(term, doc_id, tf, weight)`, `terms(term, df, idf)`, `docs(doc_id, n_tokens, norm)`."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame

    def save(self, path: str, buckets: int = 64) -> None:
        """Parquet, postings clustered by term, so that a query reads few row groups."""
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.sort("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "docs")))


def term_freq(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, term, tf`; documents without tokens give no rows."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.tokenize(F.col(text_col))).alias("term"))
    return tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_len(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_tokens` of documents with at least one token."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(T.tokenize(F.col(text_col))).cast("long").alias("n_tokens")).where("n_tokens > 0")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Documents without tokens are not indexed and don't count; weight is raw tf times idf.

    Texts are split once: counts per document and term are written, everything else derives from them.
    """
    tf = cut(term_freq(docs, id_col, text_col))
    n = tf.agg(F.count_distinct("doc_id").alias("n"))
    terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", T.idf(F.col("df"), F.col("n")).alias("idf"))
    terms = sized(terms)
    postings = tf.join(terms, "term").select("term", "doc_id", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    docs_out = postings.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return Index(postings, terms, docs_out)
