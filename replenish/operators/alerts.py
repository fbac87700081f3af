"""Stock alerts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.operators.projections import low_stock, severity

ALERT_COLUMNS = ["alert_type", "medicine_id", "message", "severity", "created_at"]


def raise_low_stock(stock: DataFrame, when: Column, style: str = "graded") -> DataFrame:
    """One alert per item below its reorder point.

    ``graded`` alerts say how many units are left and are high or medium;
    ``warning`` alerts carry the fixed severity and text of the event path.
    """
    low = low_stock(stock)
    if style == "graded":
        level = severity(F.col("current_inventory"), F.col("reorder_point"))
        text = S.low_stock_text(F.col("medicine_name"), F.col("current_inventory"))
    else:
        level = F.lit("WARNING")
        text = S.low_stock_text(F.col("medicine_name"), F.col("current_inventory"), "plain")
    return (
        low.withColumn("alert_type", F.lit("LOW_STOCK"))
        .withColumn("severity", level)
        .withColumn("message", text)
        .withColumn("created_at", when)
    )


def new_alerts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose item and type have no alert yet."""
    seen = existing.select("medicine_id", "alert_type")
    return candidates.join(seen, ["medicine_id", "alert_type"], "left_anti")


def sweep(stock: DataFrame, existing: DataFrame, when: Column) -> DataFrame:
    """Periodic low-stock pass: the alert table after adding what is not yet in it."""
    fresh = new_alerts(raise_low_stock(stock, when), existing).select(*ALERT_COLUMNS)
    return fresh.unionByName(existing.select(*ALERT_COLUMNS))


def order_placed(orders: DataFrame, when: Column) -> DataFrame:
    """Informational alert per order, with the ordered units truncated as text."""
    return orders.select(
        F.lit("ORDER_PLACED").alias("alert_type"),
        "medicine_id",
        F.concat(F.lit("Order placed: "), F.col("quantity").cast("bigint").cast("string"), F.lit(" units")).alias(
            "message"
        ),
        F.lit("info").alias("severity"),
        when.alias("created_at"),
    )


def recent_alerts(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """Newest unresolved alerts; ties by item."""
    return (
        alerts.filter(~F.col("is_resolved")).orderBy(F.desc("created_at"), F.asc("medicine_id")).limit(limit)
    )


def resolve(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Alerts with resolution requests ``(medicine_id, alert_type, resolved_at)`` applied."""
    asked = resolutions.select("medicine_id", "alert_type", "resolved_at")
    return alerts.join(asked, ["medicine_id", "alert_type"], "left").withColumn(
        "is_resolved", F.col("is_resolved") | F.col("resolved_at").isNotNull()
    )
