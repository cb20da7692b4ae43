"""PageRank: one loop for the L1 dialect (renormalised) and the L-infinity dialect of hand-made graphs.

Transition weights are computed once and kept partitioned by source. One job per iteration writes the new ranks to
the shared folder and, on the way, observes their change and the dangling mass the next iteration needs; the ranks before the last
are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.operators import graph
from tarnweave.session import cut_counted, discard


@dataclass
class Result:
    ranks: DataFrame
    iterations: int
    deltas: list[tuple[float, float]] = field(default_factory=list)  # L1, L-infinity


def pagerank(
    edges: DataFrame, *, n: int | None = None, damping: float = 0.85, tol: float = 1e-8, max_iter: int = 100, norm: str = "l1", dangling: str = "distribute", normalize: bool = True, dedup: bool = False
) -> Result:
    """Ranks `id, rank` of nodes 0..n-1 (default: up to the greatest id).

    `norm` l1 stops when the summed change is below `tol`, linf when no node changes by more than `tol`, both after
    the new ranks were adopted. `dangling` distribute spreads the mass of nodes without out-links evenly; leak
    loses it. Edges with a null end are ignored; negative ids raise. No edges and no `n`: no rows.
    """
    if norm not in ("l1", "linf") or dangling not in ("distribute", "leak"):
        raise ValueError("norm is l1 or linf, dangling is distribute or leak")
    spark = edges.sparkSession
    edges = graph.clean_edges(edges)
    ends = edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).first()
    if ends["low"] is not None and ends["low"] < 0:
        raise ValueError("negative node id")
    if dedup:
        edges = graph.distinct_edges(edges)
    if n is None:
        n = 0 if ends["high"] is None else ends["high"] + 1
    if n == 0:
        return Result(spark.range(0).select("id", F.lit(0.0).alias("rank")), 0)
    weights = graph.transition_matrix(edges).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    loose = graph.dangling_nodes(edges, n).withColumn("loose", F.lit(True))
    ranks = graph.nodes(spark, n).join(loose, "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("loose", F.lit(False)).alias("loose"))
    mass = F.sum(F.when(F.col("loose"), F.col("rank")).otherwise(0.0))
    ranks, seen = cut_counted(ranks, mass=mass)
    out, written = Result(ranks, 0), ranks
    try:
        for it in range(max_iter):
            # contributions and the nodes themselves meet in one aggregation: one shuffle, combined before it
            flow = weights.join(ranks.select(F.col("id").alias("src"), "rank"), "src").select(F.col("dst").alias("id"), (F.col("weight") * F.col("rank")).alias("y"), F.lit(None).cast("double").alias("old"), F.lit(None).cast("boolean").alias("loose"))
            both = flow.unionByName(ranks.select("id", F.lit(0.0).alias("y"), F.col("rank").alias("old"), "loose"))
            sums = both.groupBy("id").agg(F.sum("y").alias("y"), F.max("old").alias("old"), F.max("loose").alias("loose")).where("old is not null")
            spread = seen["mass"] / n if dangling == "distribute" else 0.0
            new = damping * (F.col("y") + spread) + (1 - damping) / n
            step = sums.select("id", new.alias("rank"), "loose", F.abs(new - F.col("old")).alias("change"))
            step, seen = cut_counted(step, mass=mass, l1=F.sum("change"), linf=F.max("change"), total=F.sum("rank"))
            discard(written)
            written, ranks = step, step.drop("change")
            out.deltas.append((seen["l1"], seen["linf"]))
            out.iterations = it + 1
            if (norm == "l1" and seen["l1"] < tol) or (norm == "linf" and not seen["linf"] > tol):
                break
    finally:
        weights.unpersist()
    if normalize and out.iterations and seen["total"] > 0:
        ranks = ranks.withColumn("rank", F.col("rank") / seen["total"])
    out.ranks = ranks.select("id", "rank")
    return out


def top_ranks(ranks: DataFrame, k: int) -> DataFrame:
    """The k best nodes with their place from 1; ties by id."""
    best = ranks.orderBy(F.desc("rank"), "id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "id")))


def rank_report(edges: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """Text lines of a report: nodes, edges, dangling nodes, then the top k (all, if there are fewer) at 10 decimals."""
    edges = graph.clean_edges(edges)
    # The layout that readers of such reports expect.
    head = ["Graph summary:", "  N (nodes) : {nodes}", "  M (edges) : {edges}", "  Dangling nodes: {dangling}", "", "Top {k} nodes by PageRank:"]
    s = graph.summary(edges).withColumn("k", F.least(F.lit(k), "nodes"))
    values = [F.lit(line) for line in head]
    for name in ("nodes", "edges", "dangling", "k"):
        values = [F.replace(v, F.lit("{" + name + "}"), F.col(name).cast("string")) for v in values]
    s = s.select(F.posexplode(F.array(*values)).alias("o", "value"))
    top = top_ranks(ranks, k).select((F.col("place") + len(head)).alias("o"), F.format_string("  node %d : %.10f", "id", "rank").alias("value"))
    return s.unionByName(top).coalesce(1).sortWithinPartitions("o").select("value")
