"""Top-k reports and exact global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.session import ensure_checkpoints


def top_items(rx: DataFrame, n: int, by: str = "quantity") -> DataFrame:
    """Items with the largest total; ties by id (a distributed top-k, no full sort)."""
    return (
        rx.groupBy("medicine_id")
        .agg(F.sum(by).alias("total"), F.count("*").alias("count"))
        .orderBy(F.desc("total"), F.asc("medicine_id"))
        .limit(n)
    )


def most_frequent_item(rx: DataFrame) -> DataFrame:
    return (
        rx.groupBy("medicine_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("medicine_id")).limit(1)
    )


def live_top(totals: DataFrame, n: int = 10) -> DataFrame:
    """Leaderboard of the live table: total, count and average to two decimals."""
    return (
        totals.select(
            "medicine_id",
            F.col("total_quantity").alias("total"),
            "count",
            F.round(F.col("total_quantity") / F.col("count"), 2).alias("avg"),
        )
        .orderBy(F.desc("total"), F.asc("medicine_id"))
        .limit(n)
    )


def by_priority(recommendations: DataFrame) -> DataFrame:
    return recommendations.orderBy(F.desc("priority"), F.asc("medicine_id"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle, so hot groups send k rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], k: int = 30) -> DataFrame:
    return first_per_group(df, keys, order, k)


def time_sorted(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy("timestamp", *ties)


def global_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Exact zero-based position of every row in a total order, without a one-task window.

    The rows are range partitioned and sorted, numbered inside their partition
    and written to the checkpoint folder once, so that the partition sizes and
    the rows that use them come from the same layout even if an executor is lost.
    Offsets are a prefix sum over one row per partition.
    """
    ensure_checkpoints(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        "_part",
        (F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")).alias("_offset"),
    )
    lookup = offsets.agg(F.map_from_entries(F.collect_list(F.struct("_part", "_offset")))).scalar()
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, lookup[part] + inside).drop("_id")


def ordered_split(df: DataFrame, order: list[Column], test_size: float = 0.2) -> DataFrame:
    """First ``int(n * (1 - test_size))`` rows by order are train, the rest test."""
    numbered = global_position(df, order)
    total = numbered.agg(F.count("*")).scalar()
    cut = F.floor(total * F.lit(1 - test_size))
    return numbered.withColumn("split", F.when(F.col("position") < cut, "train").otherwise("test"))


def priority_batches(orders: DataFrame, batch_size: int = 100, ties: list[Column] | None = None) -> DataFrame:
    """Batches of ``batch_size`` orders, highest priority first."""
    order = [F.desc("priority"), *(ties or [F.asc("order_id")])]
    return global_position(orders, order).withColumn(
        "batch", F.floor(F.col("position") / F.lit(batch_size)).cast("bigint")
    )
