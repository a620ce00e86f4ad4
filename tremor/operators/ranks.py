"""Exact order statistics and quantiles without one task per group.

A group may hold a third of all rows, so no task may sort a whole group.  Equal
values collapse first.  The distinct values are then range-partitioned by
(group, value) and numbered by partition: sums per partition, a row per group
and partition, tell which partition holds a wanted rank, and only those are
ranked inside, each by itself.  One plan at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.session import materialize


def order_statistic(df: DataFrame, group: list[str], value: str, rank: Column, out: str = "value") -> DataFrame:
    """(group, n, rank, out): the ``rank``-th smallest ``value`` (1-based) of
    each group, null when the rank is outside 1..n.

    ``rank`` is an expression over ``n``, the group's row count.
    """
    stats = order_statistics(df, group, value, {"rank": rank})
    return stats.drop("which").withColumnRenamed("value", out)


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """As above for several ranks: rows (group, n, which, rank, value)."""
    # A value shared by a third of the rows is one row with a count from here.
    counted = (df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c")))
    # Written, so that a value's partition is fixed whatever is computed again.
    placed = materialize(counted.repartitionByRange(*group, "_v").withColumn("_p", F.spark_partition_id()), "ranks")
    parts = placed.groupBy(*group, "_p").agg(F.sum("_c").alias("_m"))
    order = Window.partitionBy(*group).orderBy("_p")
    before = F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_lo", before)
    sizes = parts.groupBy(*group).agg(F.sum("_m").alias("n"))
    wanted = sizes.select(*group, "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("which"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])).alias("w"))
    wanted = wanted.select(*group, "n", "w.which", "w.rank")
    keys = [*group, "which"]
    holding = (wanted.join(parts, group).where((F.col("rank") > F.col("_lo")) & (F.col("rank") <= F.col("_lo") + F.col("_m")))
               .select(*keys, "rank", "_p", "_lo"))
    run = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_lo") + F.sum("_c").over(run)
    found = (placed.join(holding, [*group, "_p"]).withColumn("_upto", upto)
             .where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_c") < F.col("rank")))
             .select(*keys, F.col("_v").alias("value")))
    # A row per group and rank, of measured size: joins back to the rows then
    # broadcast it where it is small, and never the rows.
    return materialize(wanted.join(found, keys, "left"), "ranks")


def quantiles(df: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per fraction."""
    n = F.col("n")
    ranks: dict[str, Column] = {}
    for name, q in fractions.items():
        pos = (n - 1) * F.lit(q)
        ranks[f"{name}|lo"] = F.floor(pos) + 1
        ranks[f"{name}|hi"] = F.least(F.floor(pos) + 2, n)
    stats = order_statistics(df, group, value, ranks)
    cols = []
    for name, q in fractions.items():
        pos = (F.max("n") - 1) * F.lit(q)
        lo = F.max(F.when(F.col("which") == f"{name}|lo", F.col("value")))
        hi = F.max(F.when(F.col("which") == f"{name}|hi", F.col("value")))
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return stats.groupBy(*group).agg(*cols)
