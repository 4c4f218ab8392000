"""Global order without gathering all rows in one task: range partitions, then offsets of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import cut


def sorted_places(df: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows, range-partitioned and sorted by ``keys``, with _part and _place (from 0, within the partition)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return cut(laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))


def global_rank(df: DataFrame, *keys: Column | str, name: str = "rank") -> DataFrame:
    """``name``: 1, 2, ... over all rows in the order of ``keys``, which must be total.

    Only the sizes of the partitions, one row for each, meet in one place.
    """
    placed = sorted_places(df, *keys)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row for each partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def carried_forward(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` in rows of the group up to this one, in the order of ``order`` (unique in a group).

    A group may span partitions: each takes over what the ones before it ended with.
    """
    placed = sorted_places(df, F.col(group), F.col(order))
    within = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.filter(F.col(value).isNotNull()).groupBy(group, "_part").agg(F.max_by(value, order).alias("_end"))
    starts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).join(ends, [group, "_part"], "left")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    taken = starts.select(group, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_taken"))
    last = F.last(F.col(value), ignorenulls=True).over(within)
    return placed.withColumn("_own", last).join(taken, [group, "_part"], "left").withColumn(name, F.coalesce("_own", "_taken")).drop("_own", "_taken", "_part", "_place")
