"""Adapters from the star-schema tables to this library's logical inputs.

Every adapter is a lazy projection (plus the joins it cannot avoid), so column
pruning and filters still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.operators.joins import skew_safe_join

SHELF_LIFE_DAYS = (180, 365, 730, 1095)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def medicines(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    lives = F.array(*[F.lit(v) for v in SHELF_LIFE_DAYS])
    return p.select(
        F.col("p_partkey").alias("medicine_id"),
        F.col("p_name").alias("medicine_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
        F.element_at(lives, (F.col("p_partkey") % 4).cast("int") + 1).alias("shelf_life_days"),
        F.col("p_brand").alias("storage_type"),
    )


def dispensing(spark: SparkSession, folder: str) -> DataFrame:
    """Prescription history with what one fact table holds (no join)."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.concat_ws("-", F.lit("RX"), F.col("l_orderkey"), F.col("l_linenumber")).alias("prescription_id"),
        F.col("l_partkey").alias("medicine_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_orderkey").alias("basket_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("location"),
        F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No").alias("insurance"),
    )


def prescriptions(spark: SparkSession, folder: str) -> DataFrame:
    """History with the patient-level columns, which live on the order header."""
    head = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("basket_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_emergency"),
        (F.lit(1) + F.col("o_custkey") % 90).alias("patient_age"),
    )
    return skew_safe_join(dispensing(spark, folder), head, "basket_id")


def stream_columns(ev: DataFrame, key: str | Column = "event_type") -> DataFrame:
    """Events as prescriptions; works on a batch or a streaming frame."""
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("event_id").alias("prescription_id"),
        (F.col(key) if isinstance(key, str) else key).alias("medicine_id"),
        F.col("value").alias("quantity"),
        ts.alias("timestamp"),
        F.col("event_type").alias("category"),
        (F.col("event_type") == "error").alias("is_emergency"),
        F.concat(F.lit("Store"), (F.lit(1) + F.col("user_id") % 3).cast("string")).alias("location"),
        F.get_json_object("props", "$.k").cast("bigint").alias("patient_age"),
        F.hour(ts).cast("bigint").alias("hour_of_day"),
        F.when(F.col("event_type") == "purchase", "Yes").otherwise("No").alias("insurance"),
    )


def event_history(spark: SparkSession, folder: str, key: str | Column = "event_type") -> DataFrame:
    return stream_columns(table(spark, folder, "events"), key)


def orders_with_items(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase-order lines: one per history line, priced from the catalog."""
    states = {"O": "PENDING", "P": "APPROVED"}
    head = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("basket_id"),
        F.when(F.col("o_orderstatus") == "O", states["O"])
        .when(F.col("o_orderstatus") == "P", states["P"])
        .otherwise("DELIVERED")
        .alias("status"),
        ((F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")) / 5.0).alias("priority"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH")
        .when(F.col("o_orderpriority") == "5-LOW", "LOW")
        .otherwise("NORMAL")
        .alias("urgency"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    lines = dispensing(spark, folder).select("medicine_id", "quantity", "basket_id", "line")
    price = medicines(spark, folder).select("medicine_id", F.col("unit_price").alias("unit_cost"))
    return (
        skew_safe_join(skew_safe_join(lines, head, "basket_id"), price, "medicine_id")
        .withColumn("order_id", F.concat_ws("-", F.lit("PO"), F.col("basket_id"), F.col("line")))
        .withColumn("total_cost", F.col("quantity") * F.col("unit_cost"))
    )


def stock_levels(spark: SparkSession, folder: str) -> DataFrame:
    """One row per item: history totals, stock on hand and reorder point, plus catalog columns."""
    totals = dispensing(spark, folder).groupBy("medicine_id").agg(
        F.sum("quantity").alias("total_dispensed"),
        F.avg("quantity").alias("avg_quantity"),
        F.count("*").alias("prescription_count"),
        F.max("timestamp").alias("last_dispensed"),
    )
    return totals.join(medicines(spark, folder), "medicine_id").select(
        "*",
        F.floor(F.col("total_dispensed") * (F.lit(30) + F.col("medicine_id") % 51) / 100.0)
        .cast("double")
        .alias("current_inventory"),
        (F.col("avg_quantity") * 30).alias("reorder_point"),
    )


def low_stock_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert rows that the stock table implies, some of them already resolved."""
    from replenish.operators.alerts import raise_low_stock

    alerts = raise_low_stock(stock_levels(spark, folder), F.col("last_dispensed"))
    return alerts.withColumn("is_resolved", F.col("shelf_life_days") == SHELF_LIFE_DAYS[0])
