"""Problem 3: how distinctive each term is for its record.

A term's weight is its contribution to the relative entropy between the record's Dirichlet-smoothed term
distribution and the collection's: p(t|d) * ln(p(t|d) / p(t|C)), p(t|d) = (tf + mu * p(t|C)) / (n_d + mu).

Statistics: each Python task adds up df and cf of its records and emits one row per distinct term (flushed at a
bounded size), so only partial sums are shuffled. Weights: term statistics small by count are broadcast; otherwise
the frequent terms (at most AVG_TERMS * 1000 of them can stand in a thousandth of the records) are broadcast
and the rare ones joined by a shuffle, so that no frequent term makes a skewed partition.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.arrow import map_batches
from tarnweave.session import BROADCAST_ROWS, cut

MU = 500.0
#: Distinct terms that a task holds before it emits its partial counts.
FLUSH = 400_000
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and underscores, lower-cased after the split; [] for null."""
    if not text:
        return []
    if text.isascii() or not ("İ" in text or "Σ" in text):
        return _TOKEN.findall(text.lower())
    return [t.lower() for t in _TOKEN.findall(text)]


def term_statistics(records: DataFrame, text_col: str = "text") -> DataFrame:
    """`term, df, cf` over all records; null and empty texts hold no terms."""

    def partial(batches):
        df, cf = Counter(), Counter()
        for (texts,) in batches:
            for t in texts:
                toks = tokens(t)
                cf.update(toks)
                df.update(set(toks))
            if len(df) > FLUSH:
                yield [list(df), list(df.values()), [cf[k] for k in df]]
                df, cf = Counter(), Counter()
        if df:
            yield [list(df), list(df.values()), [cf[k] for k in df]]

    parts = map_batches(records.select(text_col), partial, {"term": "string", "df": "long", "cf": "long"})
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def postings(records: DataFrame, min_tf: int = 1, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`id, term, tf, n` for terms that stand at least `min_tf` times; n is the record's number of tokens."""

    def count(batches):
        for ids, texts in batches:
            out_id, out_term, out_tf, out_n = [], [], [], []
            for i, t in zip(ids, texts, strict=True):
                toks = tokens(t)
                for term, tf in Counter(toks).items():
                    if tf >= min_tf:
                        out_id.append(i)
                        out_term.append(term)
                        out_tf.append(tf)
                        out_n.append(len(toks))
            yield [out_id, out_term, out_tf, out_n]

    return map_batches(records.select(F.col(id_col).cast("long"), text_col), count, {"id": "long", "term": "string", "tf": "long", "n": "long"})


def distinctive_terms(records: DataFrame, *, min_tf: int = 1, min_df: int = 2, max_df: int | None = None, mu: float = MU, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`id, term, tf, df, weight` of every term with tf >= min_tf and min_df <= df <= max_df.

    Counts cover all records, whatever the cutoffs. Null and empty texts give no rows; a repeated row is a record of
    its own and raises df; null ids are kept. Other columns are ignored; an empty table gives no rows.
    """
    stats = cut(term_statistics(records, text_col))
    total = stats.agg(F.sum("cf").alias("total"))
    kept = stats.where((F.col("df") >= min_df) & ((F.col("df") <= max_df) if max_df else F.lit(True)))
    posts = postings(records, min_tf, id_col, text_col)
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = posts.join(F.broadcast(kept), "term")
    else:
        often = records.count() // 1000 + 1
        heavy = F.broadcast(kept.where(F.col("df") > often).select("term", F.col("df").alias("hdf"), F.col("cf").alias("hcf")))
        light = kept.where(F.col("df") <= often).withColumnRenamed("term", "lterm")
        joined = posts.join(heavy, "term", "left")
        # terms already matched get keys that match nothing, spread over many partitions
        joined = joined.withColumn("lkey", F.when(F.col("hdf").isNull(), F.col("term")).otherwise(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("id", "term"), F.lit(4096)).cast("string"))))
        joined = joined.join(light, F.col("lkey") == F.col("lterm"), "left").withColumns({"df": F.coalesce("hdf", "df"), "cf": F.coalesce("hcf", "cf")}).where("df is not null")
    joined = joined.crossJoin(F.broadcast(total))
    p_c = F.col("cf") / F.col("total")
    p_d = (F.col("tf") + mu * p_c) / (F.col("n") + mu)
    return joined.select("id", "term", "tf", "df", (p_d * F.log(p_d / p_c)).alias("weight"))
