"""Join patterns that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.params import Params


def hot_keys(df: DataFrame, key: str, one_in: int = 1000) -> DataFrame:
    """(key, share) of the keys that own at least 1/one_in of all rows; by counting, at most ``one_in`` of them."""
    counts = df.select(key).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * one_in >= total).select(key, (F.col("_n") / total).alias("share"))


def skew_safe_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Fact-to-dimension equi join whose hot keys don't meet in one task.

    The adaptive planner splits the large partitions of a shuffled join from what it has measured, so
    the plain join is enough where nothing is known. Where :func:`hot_keys` were found before (once, for several
    joins), their fact rows get a salt from a hash of the row, as many salts as the key's share of the
    partitions, and only their dimension rows are repeated.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep every fact row on one side")
    if hot is None:
        return facts.join(dim, key, how)
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("share") * tasks)).cast("int")
    known = F.broadcast(hot.select(key, salts.alias("_salts")))  # at most one_in rows
    plain = [name for name, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]
    own = F.pmod(F.xxhash64(*plain), F.coalesce("_salts", F.lit(1))).cast("int")
    left = facts.join(known, key, "left").withColumn("_salt", own).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = dim.join(known, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def spread_by_item(rows: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Item-level rows over all cores before a costly per-row step.

    Such rows are few bytes but much work each, so a fixed partition count is
    asked for; the adaptive planner would merge them by size into a few tasks.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores), key)


def with_catalog(facts: DataFrame, medicines: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Fact rows with their catalog columns (prescriptions or orders with items)."""
    return skew_safe_join(facts, medicines, key)


def with_forecast(medicines: DataFrame, forecasts: DataFrame, required: bool = True) -> DataFrame:
    """Items with their forecast; items without one are skipped or kept with NULLs."""
    return medicines.join(forecasts, "medicine_id", "inner" if required else "left")


def only_forecast(medicines: DataFrame, forecasts: DataFrame) -> DataFrame:
    return medicines.join(forecasts.select("medicine_id"), "medicine_id", "left_semi")


def days_of_supply(
    medicines: DataFrame, mean_demand: DataFrame, default_days: float = 30.0
) -> DataFrame:
    """Stock over mean demand; items without a forecast use ``default_days``."""
    joined = medicines.join(mean_demand, "medicine_id", "left")
    rate = F.greatest(F.col("mean_demand"), F.lit(1.0))
    return joined.withColumn(
        "days_of_supply",
        F.when(F.col("mean_demand").isNull(), F.lit(default_days)).otherwise(F.col("current_inventory") / rate),
    )


def without_ordered(recommendations: DataFrame, placed: DataFrame) -> DataFrame:
    """Recommendations whose item has not been ordered."""
    return recommendations.join(placed.select("medicine_id"), "medicine_id", "left_anti")


def align_shares(left: DataFrame, right: DataFrame, on: str, outer: bool) -> DataFrame:
    """Two share tables ``(on, share)`` side by side as ``share_a`` and ``share_b``.

    ``outer`` fills values missing on one side with zero; otherwise only common values stay.
    """
    a = left.select(on, F.col("share").alias("share_a"))
    b = right.select(on, F.col("share").alias("share_b"))
    if not outer:
        return a.join(b, on)
    return a.join(b, on, "full").select(
        on, F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b")
    )


def pick_by_interval(
    draws: DataFrame, intervals: DataFrame, draw: str, total: Column, buckets: Column
) -> DataFrame:
    """Range join ``lo <= draw < hi`` turned into a hash join on a bucketed axis.

    The axis ``[0, total)`` is cut into ``buckets`` equal cells. An interval is
    repeated once per cell it touches, which adds at most ``buckets`` rows over
    all intervals, and a draw belongs to one cell, so a value that owns a third
    of the axis is spread over a third of the cells.
    ``intervals`` has columns ``value, lo, hi`` and covers the axis without overlap.
    """
    width = F.greatest(F.ceil(total / buckets), F.lit(1)).cast("bigint")
    cells = intervals.withColumn(
        "_cell",
        F.explode(
            F.sequence(F.floor(F.col("lo") / width).cast("bigint"), F.floor((F.col("hi") - 1) / width).cast("bigint"))
        ),
    )
    placed = draws.withColumn("_cell", F.floor(F.col(draw) / width).cast("bigint"))
    return (
        placed.join(cells, "_cell")
        .filter((F.col(draw) >= F.col("lo")) & (F.col(draw) < F.col("hi")))
        .drop("_cell", "lo", "hi")
    )


def pad_components(forecasts: DataFrame, horizon: int) -> DataFrame:
    """Component forecasts on a common grid of ``horizon`` days, short ones padded with their last value.

    ``forecasts`` has ``medicine_id, model, h, forecast``. Each component is a
    vector of at most ``horizon`` numbers, so the grid is made by exploding the
    gap after its last day instead of joining a grid.
    """
    ends = forecasts.groupBy("medicine_id", "model").agg(
        F.max("h").alias("_last"), F.max_by("forecast", "h").alias("forecast")
    )
    tail = ends.filter(F.col("_last") < horizon - 1).select(
        "medicine_id",
        "model",
        F.explode(F.sequence(F.col("_last") + 1, F.lit(horizon - 1).cast("bigint"))).alias("h"),
        "forecast",
    )
    body = forecasts.filter(F.col("h") < horizon).select("medicine_id", "model", "h", "forecast")
    return body.unionByName(tail)


def reward_table(demand: DataFrame, params: Params = Params()) -> DataFrame:
    """Expected one-step reward of every (stock level, order size) pair per group.

    ``demand`` has ``group, demand, n``. The reward depends on the pair only through
    stock + order, apart from the fixed and holding terms, so expected shortage is computed
    once per reachable level instead of once per pair, and both grids are generated by
    exploding fixed-length sequences: nothing is cross joined.
    """
    step, top = params.policy_step, params.policy_max_stock + params.policy_max_order
    levels = demand.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(step))))
    short = levels.groupBy("group", "level").agg(
        (
            F.sum(F.col("n") * F.greatest(F.lit(0.0), F.col("demand") - F.col("level"))) / F.sum("n")
        ).alias("shortage")
    )
    fixed = F.when(F.col("action") > 0, params.order_cost).otherwise(0.0)
    first = F.greatest(F.lit(0), F.col("level") - F.lit(params.policy_max_order))
    last = F.least(F.lit(params.policy_max_stock), F.col("level"))
    return (
        short.withColumn("state", F.explode(F.sequence(first, last, F.lit(step))))
        .withColumn("action", F.col("level") - F.col("state"))
        .select(
            "group",
            "state",
            "action",
            (
                -F.lit(params.holding_cost) * F.col("level") / 2.0 - fixed - F.lit(params.shortage_cost) * F.col("shortage")
            ).alias("reward"),
        )
    )
