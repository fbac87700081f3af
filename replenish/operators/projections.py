"""Filters, validations and per-row features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.params import Params

REQUIRED_HISTORY = ("prescription_id", "medicine_id", "medicine_name", "category", "quantity", "timestamp")


def missing_columns(df: DataFrame, required: Iterable[str] = REQUIRED_HISTORY) -> list[str]:
    return [c for c in required if c not in df.columns]


def dataset_check(df: DataFrame, required: Iterable[str] = REQUIRED_HISTORY) -> DataFrame:
    """One row: is every required column present, which are not, rows, distinct items."""
    missing = missing_columns(df, required)
    items = F.count_distinct("medicine_id") if "medicine_id" in df.columns else F.lit(None).cast("bigint")
    return df.agg(
        F.lit(not missing).alias("ok"),
        F.lit(", ".join(missing)).alias("missing"),
        F.count("*").alias("rows"),
        items.alias("items"),
    )


def missing_fields(required: Iterable[str]) -> Column:
    """Array of the required fields that are null in this row."""
    names = list(required)
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]))
    return F.array_except(F.array(*[F.lit(c) for c in names]), present)


def validate_record(df: DataFrame, required: Iterable[str]) -> DataFrame:
    absent = missing_fields(required)
    return df.withColumn("ok", F.size(absent) == 0).withColumn(
        "message",
        F.when(F.size(absent) == 0, F.lit("Valid")).otherwise(
            F.concat(F.lit("Missing fields: "), F.concat_ws(", ", absent))
        ),
    )


def low_stock(stock: DataFrame) -> DataFrame:
    return stock.filter(F.col("current_inventory") < F.col("reorder_point"))


def stock_ratio(current: Column, reorder_point: Column) -> Column:
    return current / F.coalesce(F.nullif(reorder_point, F.lit(0.0)), F.lit(100.0))


def stock_status(current: Column, reorder_point: Column) -> Column:
    ratio = stock_ratio(current, reorder_point)
    return F.when(ratio < 0.5, "Critical").when(ratio < 1, "Low").otherwise("Good")


def severity(current: Column, reorder_point: Column) -> Column:
    return F.when(current < reorder_point * 0.5, "high").otherwise("medium")


def select_items(df: DataFrame, ids: DataFrame | list | None, key: str = "medicine_id") -> DataFrame:
    """Rows of the listed items; an empty list keeps everything, a frame of ids is semi joined."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids))) if ids else df


def search_medicines(medicines: DataFrame, text: str = "", category: str = "") -> DataFrame:
    out = medicines
    if text:
        out = out.filter(F.contains(F.lower("medicine_name"), F.lit(text.lower())))
    if category:
        out = out.filter(F.col("category") == category)
    return out


def pending_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin("PENDING", "APPROVED"))


def unresolved(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("is_resolved"))


def prescription_features(df: DataFrame) -> DataFrame:
    age = F.coalesce(F.col("patient_age"), F.lit(0))
    return df.select(
        "prescription_id",
        F.coalesce(F.col("quantity"), F.lit(0.0)).alias("quantity"),
        F.coalesce(F.col("is_emergency"), F.lit(False)).cast("int").alias("is_emergency"),
        F.coalesce(F.col("insurance") == "Yes", F.lit(False)).cast("int").alias("has_insurance"),
        S.age_category(age).alias("age_category"),
    )


def usable_series(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """Flags per series, from ``n`` days and population ``std`` of the zero-filled daily demand."""
    varied = F.col("std") >= params.min_series_std
    sequences = F.col("n") - params.lookback
    return (
        stats.withColumn("trend_ok", varied & (F.col("n") >= params.min_series_days))
        .withColumn(
            "ar_ok", varied & (F.col("n") >= 3 * params.lookback) & (sequences >= params.min_sequences)
        )
        .withColumn(
            "additive_ok", (F.col("n") >= params.min_series_days) & (F.col("positive_days") >= 2)
        )
    )


def history_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Prescriptions of a closed date range (for export)."""
    return df.filter(
        (F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") <= F.lit(end).cast("timestamp"))
    )


def recent_history(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest row of the whole history."""
    newest = df.agg(F.max("timestamp")).scalar()
    return df.filter(F.col("timestamp") >= newest - F.make_dt_interval(F.lit(days)))
