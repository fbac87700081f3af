"""Grouped summaries. Each is one partial/final aggregate, so a hot key is combined map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import draws
from replenish.params import Params


def item_summary(rx: DataFrame, order_by: str = "timestamp") -> DataFrame:
    """Per item: first name and category (earliest row, then smallest), total, mean and count."""
    first = F.min(F.struct(order_by, "medicine_name", "category"))
    return (
        rx.groupBy("medicine_id")
        .agg(
            first.alias("_first"),
            F.sum("quantity").alias("total_dispensed"),
            F.avg("quantity").alias("avg_quantity"),
            F.count("*").alias("prescription_count"),
        )
        .select("*", "_first.medicine_name", "_first.category")
        .drop("_first")
    )


def derived_stock(summary: DataFrame, params: Params = Params()) -> DataFrame:
    """Stock on hand = total x uniform(0.3, 0.8) truncated; reorder point = 30 x average quantity."""
    share = F.lit(0.3) + F.lit(0.5) * draws.uniform(params.seed, F.lit("stock"), F.col("medicine_id"))
    return summary.withColumn(
        "current_inventory", F.floor(F.col("total_dispensed") * share).cast("double")
    ).withColumn("reorder_point", F.col("avg_quantity") * 30)


def daily_demand(rx: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Demand per item and calendar day. From here on a hot item is at most one row per day."""
    return rx.groupBy(key, F.to_date("timestamp").alias("date")).agg(F.sum("quantity").alias("demand"))


def running_totals(rx: DataFrame) -> DataFrame:
    """Totals per item as the live table shows them (same plan in batch and in update-mode streaming)."""
    return (
        rx.groupBy("medicine_id")
        .agg(F.sum("quantity").alias("total_quantity"), F.count("*").alias("count"))
        .withColumn("avg_per_rx", F.round(F.col("total_quantity") / F.col("count"), 2))
    )


def histogram(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def histogram_map(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """value -> count map per key, for columns of a small fixed domain such as the hour."""
    long = histogram(df, column, *keys)
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), F.col("n")))))
    return long.groupBy(*keys).agg(entries.alias(f"{column}_distribution"))


def quality_metrics(rx: DataFrame, catalog_size: int | Column) -> DataFrame:
    """One row of data-quality figures and the utility score."""
    size = catalog_size if isinstance(catalog_size, Column) else F.lit(catalog_size)
    hours = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 3600e6
    base = rx.agg(
        F.count("*").alias("total_prescriptions"),
        F.count_distinct("medicine_id").alias("unique_medicines"),
        F.avg("quantity").alias("avg_quantity"),
        F.avg(F.col("is_emergency").cast("int")).alias("emergency_rate"),
        hours.alias("temporal_coverage"),
    )
    coverage = F.lit(0.15) * (F.col("unique_medicines") / size)
    volume = F.lit(0.10) * F.least(F.lit(1.0), F.col("total_prescriptions") / 1000)
    return base.withColumn("utility_score", F.least(F.lit(0.95), F.lit(0.7) + coverage + volume))


def table_counts(**frames: DataFrame) -> DataFrame:
    out = None
    for name, df in frames.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def fill_rate(rx: DataFrame, *keys: str) -> DataFrame:
    """Share of filled prescriptions; an unknown flag counts as filled, no rows give 0."""
    filled = F.coalesce(F.col("filled"), F.lit(True)).cast("int")
    return rx.groupBy(*keys).agg(
        (F.coalesce(F.sum(filled), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("fill_rate"),
        F.count("*").alias("total"),
    )


def value_share(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Normalised value counts. The total comes from the counts as a scalar, not from a global window."""
    counts = df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def numeric_marginals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, min and max of several columns in one pass, one row per column."""
    aggs = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def modal_category(df: DataFrame) -> DataFrame:
    """Most frequent category per item, smallest on ties; counted before the per-item pick."""
    counts = df.groupBy("medicine_id", "category").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("category")))
    return counts.groupBy("medicine_id").agg(best["category"].alias("category"))


def order_report(orders: DataFrame) -> DataFrame:
    """Orders and value per status plus the grand total (status NULL), in one pass."""
    return orders.rollup("status").agg(F.count("*").alias("orders"), F.sum("total_cost").alias("total_value"))


def consolidate(orders: DataFrame) -> DataFrame:
    """One order per item: summed quantity and cost, highest priority, other fields of the first order."""
    first = F.min(F.struct("created_at", "order_id", "unit_cost", "urgency", "status"))
    return (
        orders.groupBy("medicine_id")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum(F.coalesce("total_cost", F.lit(0.0))).alias("total_cost"),
            F.max(F.coalesce("priority", F.lit(0.0))).alias("priority"),
            first.alias("_first"),
        )
        .select("medicine_id", "quantity", "total_cost", "priority", "_first.*")
    )


def execution_summary(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def analytics_summary(rx: DataFrame, stock: DataFrame, orders: DataFrame) -> DataFrame:
    """Dashboard totals from the data: one row, three independent scalar aggregates."""
    history = rx.agg(
        F.count("*").alias("total_prescriptions"),
        (F.count("*") / F.count_distinct(F.to_date("timestamp"))).alias("avg_daily_prescriptions"),
    )
    value = stock.agg(
        F.struct(
            F.count("*").alias("items"), F.sum(F.col("current_inventory") * F.col("unit_price")).alias("value")
        )
    ).scalar()
    pending = orders.agg(F.count_if(F.col("status").isin("PENDING", "APPROVED"))).scalar()
    return history.withColumn("_v", value).select(
        F.col("_v.items").alias("total_medicines"),
        "total_prescriptions",
        "avg_daily_prescriptions",
        F.col("_v.value").alias("inventory_value"),
        pending.alias("pending_orders"),
    )


def top_categories(rx: DataFrame, medicines: DataFrame, n: int = 3) -> DataFrame:
    """Categories by prescriptions: counted per item before the catalog join."""
    per_item = rx.groupBy("medicine_id").agg(F.count("*").alias("n"))
    return (
        per_item.join(medicines.select("medicine_id", "category"), "medicine_id")
        .groupBy("category")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.asc("category"))
        .limit(n)
    )


def forecast_stats(forecasts: DataFrame, *keys: str) -> DataFrame:
    return forecasts.groupBy(*keys).agg(
        F.avg("forecast").alias("mean_forecast"),
        F.sum("forecast").alias("total_forecast"),
        F.avg("uncertainty").alias("mean_uncertainty"),
    )


def performance_metrics(rx: DataFrame, params: Params = Params()) -> DataFrame:
    """Fill rate and mean event rate against their targets, in the metrics table's layout."""
    seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    filled = F.coalesce(F.col("filled"), F.lit(True)).cast("int")
    one = rx.agg(F.avg(filled).alias("fill"), F.try_divide(F.count("*"), seconds).alias("rate"))
    rows = F.array(
        F.struct(
            F.lit("fill_rate").alias("metric_type"),
            F.col("fill").alias("metric_value"),
            F.lit(params.target_fill_rate).alias("target_value"),
            F.lit("ratio").alias("unit"),
        ),
        F.struct(
            F.lit("throughput").alias("metric_type"),
            F.col("rate").alias("metric_value"),
            F.lit(params.min_throughput).alias("target_value"),
            F.lit("events/s").alias("unit"),
        ),
    )
    return one.select(F.inline(rows))
