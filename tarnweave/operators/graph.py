"""Directed multigraphs as edge tables: degrees, transition weights, summaries, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """`src, dst` as bigint without rows that lack an end; duplicates and self-loops stay."""
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")


def rejected_edges(edges: DataFrame) -> DataFrame:
    """Edges with a negative end."""
    return edges.where("src < 0 or dst < 0")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def edge_multiplicity(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("multiplicity"))


def node_count(edges: DataFrame) -> int:
    """Nodes are dense: 0 to the greatest id; 0 for an empty table."""
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
    return 0 if top is None else top + 1


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).toDF("id")


def dangling_nodes(edges: DataFrame, n: int) -> DataFrame:
    """Nodes without out-links, gap ids included."""
    return nodes(edges.sparkSession, n).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def in_degree_prefix_sum(edges: DataFrame, n: int, blocks: int = 1024) -> DataFrame:
    """`id, in_degree, row_offset`: number of edges that point to a smaller id.

    Two levels: running sums inside each of at most `blocks` ranges of ids, shifted by the sums of the ranges before;
    only those sums meet in one task.
    """
    width = max(1, -(-n // blocks))
    degrees = nodes(edges.sparkSession, n).join(in_degree(edges).withColumnRenamed("dst", "id"), "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.floor(F.col("id") / width).alias("block"))
    sums = degrees.groupBy("block").agg(F.sum("in_degree").alias("s"))
    shifts = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("shift"))
    inside = F.sum("in_degree").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    running = degrees.withColumn("inside", inside - F.col("in_degree"))
    return running.join(F.broadcast(shifts), "block").select("id", "in_degree", (F.col("inside") + F.col("shift")).alias("row_offset"))


def transition_matrix(edges: DataFrame) -> DataFrame:
    """`src, dst, weight`: share of the source's out-links, parallel edges added up."""
    counted = edge_multiplicity(edges)
    degrees = counted.groupBy("src").agg(F.sum("multiplicity").alias("out_degree"))  # from the counts, so that edges are shuffled once
    return counted.join(degrees, "src").select("src", "dst", (F.col("multiplicity") / F.col("out_degree")).alias("weight"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges with multiplicity, dangling nodes."""
    agg = edges.agg(F.max(F.greatest("src", "dst")).alias("m"), F.count(F.lit(1)).alias("edges"))
    sources = edges.select("src").distinct().agg(F.count(F.lit(1)).alias("sources"))
    n = F.coalesce(F.col("m") + 1, F.lit(0))
    return agg.crossJoin(F.broadcast(sources)).select(n.alias("nodes"), "edges", (n - F.col("sources")).alias("dangling"))


def adjacency_matrix(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form `src, dst, linked` (0 or 1) over all pairs of the given nodes; for small, hand-made graphs."""
    pairs = node_ids.select(F.col("id").alias("src")).crossJoin(node_ids.select(F.col("id").alias("dst")))
    links = distinct_edges(edges).withColumn("one", F.lit(1))
    return pairs.join(links, ["src", "dst"], "left").select("src", "dst", F.coalesce("one", F.lit(0)).alias("linked"))


def adjacency_rows(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """`src, row`: the 0/1 row of each node, columns in the order of the ids."""
    cells = adjacency_matrix(node_ids, edges).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "linked"))).alias("c"))
    return cells.select("src", F.col("c.linked").alias("row"))


# Editing of hand-made graphs: nodes(id, name), edges(src, dst), string ids.


def add_node(node_rows: DataFrame, name: str) -> DataFrame:
    """Adds a node named `name` (trimmed; blank names add nothing) under the greatest numeric id + 1."""
    if not name.strip():
        return node_rows
    fresh = node_rows.agg((F.coalesce(F.max(F.expr("try_cast(id as bigint)")), F.lit(-1)) + 1).cast("string").alias("id"))
    return node_rows.unionByName(fresh.withColumn("name", F.lit(name.strip())))


def remove_node(node_rows: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Without the node and all edges at it."""
    return node_rows.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def add_edge(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Duplicates are allowed; blank ends and self-loops add nothing."""
    if not src or not dst or src == dst:
        return edges
    return edges.unionByName(edges.sparkSession.range(1).select(F.lit(src).alias("src"), F.lit(dst).alias("dst")))


def remove_edge(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Removes all copies."""
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def valid_edges(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are known nodes."""
    return edges.join(node_ids.select(F.col("id").alias("src")), "src", "left_semi").join(node_ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def labelled(ranks: DataFrame, node_rows: DataFrame) -> DataFrame:
    """`id, name, score, size` for display; unknown nodes are called `Node <id>`."""
    named = ranks.join(node_rows.select("id", "name"), "id", "left")
    return named.select("id", F.coalesce("name", F.concat(F.lit("Node "), F.col("id").cast("string"))).alias("name"), F.coalesce("rank", F.lit(0.0)).alias("score"), (F.coalesce("rank", F.lit(0.0)) * 400 + 10).alias("size"))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """`m` distinct edges without self-loops among `n` nodes; ValueError if there aren't as many."""
    if m > n * (n - 1):
        raise ValueError(f"{n} nodes have no {m} distinct edges")
    if m > n * (n - 1) // 4:  # dense: number all possible edges and take m in a random order
        every = spark.range(n * (n - 1)).select((F.col("id") / (n - 1)).cast("long").alias("src"), (F.col("id") % (n - 1)).alias("k"))
        every = every.select("src", (F.col("k") + (F.col("k") >= F.col("src")).cast("long")).alias("dst"))
        return every.withColumn("o", F.xxhash64("src", "dst", F.lit(seed))).orderBy("o", "src", "dst").limit(m).drop("o")
    draw = spark.range(2 * m + 100).select((F.abs(F.xxhash64("id", F.lit(2 * seed))) % n).alias("src"), (F.abs(F.xxhash64("id", F.lit(2 * seed + 1))) % n).alias("dst"))
    return draw.where("src <> dst").dropDuplicates(["src", "dst"]).withColumn("o", F.xxhash64("src", "dst", F.lit(seed))).orderBy("o", "src", "dst").limit(m).drop("o")
