"""Problem 2: one ranking from scores of different scales.

Each score is standardised within its group by median and median absolute deviation, the deviation taken on the value's
own side of the median (scores are skewed), squashed to (0, 1) by a
logistic function, and the bounded values are combined by a weighted geometric mean.

Medians come from mergeable quantile sketches (bounded memory, combined before the shuffle), so a group that holds
a third of all rows is never gathered in a task; the top-k window keeps only k rows per partition and group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.session import sized

#: Rank error of a median is at most (rows of the group) / ACCURACY: none for groups up to this size.
ACCURACY = 10_000
#: Makes the deviation of normal data equal to its standard deviation.
MAD_SCALE = 1.4826


def latest_rows(rows: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Per key the row with the latest `at`; among equals the greatest values, so that the result is defined."""
    best = F.max(F.struct(F.col(at).alias("_at"), *(F.col(v) for v in values))).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.{v}").alias(v) for v in values))


def _median(x: Column) -> Column:
    """Mean of the lower and the upper median; NaN counts as null."""
    x = F.nanvl(x, F.lit(None).cast("double"))
    return (F.percentile_approx(x, 0.5, ACCURACY) - F.percentile_approx(-x, 0.5, ACCURACY)) / 2


def fused_scores(rows: DataFrame, group: str, item: str, weights: Mapping[str, float], at: str | None = None, slope: float = 1.0) -> DataFrame:
    """`group, item, fused` with fused in (0, 1], higher is better.

    `weights` maps score columns to weights >= 0. Each item counts once per group (by its latest row if `at` is
    given). A null or NaN score is left out of the mean of its item; an item without any score gets null. A value equal
    to the median gets 0.5, so a score that is the same for all says nothing. Rows with null group or item form a group or item of their own. Repeated rows and
    extra columns change nothing; an empty table gives no rows.
    """
    scores = list(weights)
    cells = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(at) if at else F.lit(0)).alias("t"), *(F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(f"s{k}") for k, s in enumerate(scores)))
    cells = latest_rows(cells, ["g", "i"], "t", [f"s{k}" for k in range(len(scores))])
    mid = sized(cells.groupBy("g").agg(*(_median(F.col(f"s{k}")).alias(f"m{k}") for k in range(len(scores)))).withColumnRenamed("g", "mg"))
    near = cells.join(mid, F.col("g").eqNullSafe(F.col("mg"))).drop("mg")
    off = [F.col(f"s{k}") - F.col(f"m{k}") for k in range(len(scores))]
    sides = [(f"u{k}", F.when(x > 0, x)) for k, x in enumerate(off)] + [(f"d{k}", F.when(x < 0, -x)) for k, x in enumerate(off)]
    mads = near.groupBy("g").agg(*(_median(x).alias(name) for name, x in sides), *(F.first(f"m{k}").alias(f"m{k}") for k in range(len(scores))))
    mads = sized(mads.withColumnRenamed("g", "mg"))
    out = cells.join(mads, F.col("g").eqNullSafe(F.col("mg"))).drop("mg")
    num, den = F.lit(0.0), F.lit(0.0)
    for k, s in enumerate(scores):
        off = F.col(f"s{k}") - F.col(f"m{k}")
        scale = F.when(off > 0, F.col(f"u{k}")).when(off < 0, F.col(f"d{k}")) * MAD_SCALE
        z = F.coalesce(off / scale, F.lit(0.0)) * slope
        log_squash = F.when(z < -30, z).otherwise(-F.log1p(F.exp(-z)))
        there = F.col(f"s{k}").isNotNull()
        num += F.when(there, log_squash * weights[s]).otherwise(0.0)
        den += F.when(there, F.lit(float(weights[s]))).otherwise(0.0)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.when(den > 0, F.exp(num / den)).alias("fused"))


def top_fused(fused: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k best items of each group; ties by item, items without a score never."""
    order = Window.partitionBy(group).orderBy(F.desc("fused"), F.asc(item))
    return fused.where("fused is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
