"""Purchase orders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.params import Params

OK_MESSAGE = "Order validated successfully"


def first_failure(params: Params = Params()) -> Column:
    """Message of the first violated rule, NULL when the order is valid. Required fields are checked first."""
    quantity, value = F.col("quantity"), F.col("quantity") * F.col("unit_cost")
    missing = [
        F.when(F.col(c).isNull(), F.lit(f"Missing required field: {c}")) for c in ("medicine_id", "quantity", "unit_cost")
    ]
    rules = [
        (quantity < params.min_order_qty, f"Order quantity below minimum: {params.min_order_qty:g}"),
        (quantity > params.max_order_qty, f"Order quantity exceeds maximum: {params.max_order_qty:g}"),
        (value < params.min_order_value, f"Order value below minimum: ${params.min_order_value:g}"),
        (value > params.max_order_value, f"Order value exceeds maximum: ${params.max_order_value:g}"),
    ]
    return F.coalesce(*missing, *[F.when(test, F.lit(text)) for test, text in rules])


def validate(orders: DataFrame, params: Params = Params()) -> DataFrame:
    failure = first_failure(params)
    return orders.withColumn("is_valid", failure.isNull()).withColumn("message", F.coalesce(failure, F.lit(OK_MESSAGE)))


def select_supplier(urgency: Column) -> Column:
    return F.when(urgency == "HIGH", "Supplier_A").when(urgency == "NORMAL", "Supplier_B").otherwise("Supplier_C")


def purchase_orders(recommendations: DataFrame, created_at: Column, params: Params = Params()) -> DataFrame:
    """One PENDING order per recommendation; missing optional fields get their defaults."""

    def default(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)) if name in recommendations.columns else F.lit(value)

    made = recommendations.withColumn("_at", created_at)
    return made.select(
        S.event_id("PO", F.col("_at"), F.col("medicine_id"), F.col("order_quantity")).alias("order_id"),
        "medicine_id",
        F.col("order_quantity").alias("quantity"),
        default("unit_cost", 0.0).alias("unit_cost"),
        (F.col("order_quantity") * default("unit_cost", 0.0)).alias("total_cost"),
        default("priority", 0.5).alias("priority"),
        default("urgency", "NORMAL").alias("urgency"),
        F.lit("PENDING").alias("status"),
        (F.col("_at") + F.make_dt_interval(F.lit(params.lead_time))).alias("expected_delivery_date"),
        select_supplier(default("urgency", "NORMAL")).alias("supplier"),
        default("rationale", "").alias("rationale"),
        F.col("_at").alias("created_at"),
        F.lit("system").alias("created_by"),
    )


def order_rows(requests: DataFrame, created_at: Column) -> DataFrame:
    """Order rows as the order table stores them: PENDING, cost from quantity, delivery in seven days."""
    cost = F.coalesce(F.col("unit_cost"), F.lit(0.0))
    return requests.withColumn("_at", created_at).select(
        S.event_id("ORD", F.col("_at"), F.col("order_id")).alias("order_id"),
        "medicine_id",
        "quantity",
        F.lit("PENDING").alias("status"),
        cost.alias("unit_cost"),
        (F.col("quantity") * cost).alias("total_cost"),
        (F.col("_at") + F.make_dt_interval(F.lit(7))).alias("expected_delivery_date"),
        F.col("_at").alias("created_at"),
    )


def execute(orders: DataFrame, executed_at: Column, params: Params = Params()) -> DataFrame:
    """Valid orders become APPROVED with a time; the others keep their status and carry the error."""
    checked = validate(orders, params)
    ok = F.col("is_valid")
    return (
        checked.withColumn("success", ok)
        .withColumn("status", F.when(ok, "APPROVED").otherwise(F.col("status")))
        .withColumn("approved_at", F.when(ok, executed_at))
        .withColumn("error", F.when(~ok, F.col("message")))
        .withColumn("message", F.when(ok, "Order executed successfully"))
        .drop("is_valid")
    )


def cancel(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per cancel request ``(order_id)``; only PENDING and APPROVED orders can be cancelled."""
    found = requests.join(orders.select("order_id", "status"), "order_id", "left")
    open_ = F.col("status").isin("PENDING", "APPROVED")
    label = F.concat(F.lit("Order "), F.col("order_id"))
    text = (
        F.when(F.col("status").isNull(), F.concat(label, F.lit(" not found")))
        .when(open_, F.concat(label, F.lit(" cancelled successfully")))
        .otherwise(F.concat(label, F.lit(" cannot be cancelled (status: "), F.col("status"), F.lit(")")))
    )
    return found.select(
        "order_id",
        F.coalesce(open_, F.lit(False)).alias("success"),
        text.alias("message"),
        F.when(open_, "CANCELLED").otherwise(F.col("status")).alias("status"),
    )


def track(orders: DataFrame, requests: DataFrame) -> DataFrame:
    details = orders.select("order_id", "status", "medicine_id", "quantity")
    return requests.join(details, "order_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("NOT_FOUND"))
    )


def erp_payload(orders: DataFrame) -> DataFrame:
    """Orders under the field names and defaults of the resource-planning interface."""

    def default(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)) if name in orders.columns else F.lit(value)

    return orders.select(
        F.col("order_id").alias("external_order_id"),
        F.col("medicine_id").alias("item_code"),
        "quantity",
        default("unit_cost", 0.0).alias("unit_price"),
        default("total_cost", 0.0).alias("total_amount"),
        default("urgency", "NORMAL").alias("priority"),
        default("supplier", "").alias("supplier_code"),
        default("rationale", "").alias("notes"),
        F.col("created_at"),
    )


def sync_summary(requested: DataFrame, extract: DataFrame) -> DataFrame:
    """How many requested items a stock extract covers."""
    known = extract.select("medicine_id", F.lit(True).alias("_found"))
    return requested.join(known, "medicine_id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_found")).alias("successful"),
        F.count_if(F.col("_found").isNull()).alias("failed"),
    )
