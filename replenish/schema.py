"""Explicit schemas of the logical tables (no inference on reads)."""

from pyspark.sql import types as T


_KINDS = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema from ``name TYPE`` pairs, usable before a session exists."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


MEDICINES = _struct(
    "id BIGINT, medicine_name STRING, category STRING, current_stock INT, reorder_point INT, "
    "unit_price DOUBLE, is_active BOOLEAN, created_at TIMESTAMP"
)
CATALOG = _struct(
    "medicine_id STRING, medicine_name STRING, category STRING, unit_price DOUBLE, "
    "shelf_life_days INT, storage_type STRING, pack_size INT, base_demand DOUBLE, "
    "demand_variance DOUBLE, seasonality_factor DOUBLE"
)
PRESCRIPTIONS = _struct(
    "prescription_id STRING, timestamp TIMESTAMP, medicine_id STRING, medicine_name STRING, "
    "category STRING, quantity INT, patient_age INT, is_emergency BOOLEAN, insurance STRING, "
    "location STRING, day_of_week STRING, hour_of_day INT"
)
ORDERS = _struct(
    "order_id STRING, medicine_id STRING, quantity DOUBLE, status STRING, priority STRING, "
    "unit_cost DOUBLE, total_cost DOUBLE, supplier STRING, expected_delivery_date TIMESTAMP, "
    "actual_delivery_date TIMESTAMP, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "created_by STRING"
)
OPTIMIZATION_RESULTS = _struct(
    "medicine_id STRING, optimization_type STRING, current_inventory DOUBLE, safety_stock DOUBLE, "
    "reorder_point DOUBLE, economic_order_quantity DOUBLE, optimal_order_quantity DOUBLE, "
    "total_expected_cost DOUBLE, priority DOUBLE, urgency STRING, rationale STRING, "
    "is_executed BOOLEAN, timestamp TIMESTAMP"
)
ALERTS = _struct(
    "alert_type STRING, medicine_id STRING, severity STRING, message STRING, "
    "is_resolved BOOLEAN, created_at TIMESTAMP"
)
PERFORMANCE_METRICS = _struct(
    "metric_type STRING, metric_value DOUBLE, target_value DOUBLE, unit STRING, timestamp TIMESTAMP"
)
FORECASTS = _struct(
    "medicine_id STRING, forecast_date DATE, forecast_quantity DOUBLE, lower_bound DOUBLE, "
    "upper_bound DOUBLE, model_type STRING, confidence_level DOUBLE, created_at TIMESTAMP"
)
INVENTORY_TRANSACTIONS = _struct(
    "transaction_id STRING, medicine_id STRING, transaction_type STRING, quantity_change DOUBLE, "
    "inventory_before DOUBLE, inventory_after DOUBLE, reference_id STRING, timestamp TIMESTAMP"
)
