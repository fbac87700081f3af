"""Sources, projections, scalars, aggregates, top-k and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from replenish.functions import draws
from replenish.functions import scalars as S
from replenish.operators import aggregates as A
from replenish.operators import alerts as AL
from replenish.operators import inventory as I
from replenish.operators import joins as J
from replenish.operators import projections as P
from replenish.operators import ranking as R
from replenish.operators import orders as O
from replenish.params import Params
from replenish.plans import inputs  # noqa: F401
from replenish.plans.registry import query
from replenish.plans.tidy import big, day, r, sql_ts, ts
from replenish.session import scratch_path
from replenish.sources import history as H
from replenish.sources import interchange as X
from replenish.sources import tables as T

# ---------------------------------------------------------------- sources and sinks


@query(
    "src1_history_csv",
    f"SELECT count(*) AS n, {sql_ts('min(ts)')} AS first_ts, {sql_ts('max(ts)')} AS last_ts, sum(quantity) AS total FROM disp",
    ("disp",),
)
def src1(spark, d):
    """History written as CSV, read back under the explicit schema, profiled."""
    path = scratch_path(spark, "history-csv")
    rx = T.dispensing(spark, d).select("prescription_id", "timestamp", "medicine_id", "quantity")
    H.write_history_csv(rx, path)
    back = H.read_history_csv(spark, path, rx.schema)
    return back.filter(F.col(H.CORRUPT).isNull()).agg(
        F.count("*").alias("n"),
        ts(F.min("timestamp"), "first_ts"),
        ts(F.max("timestamp"), "last_ts"),
        F.sum("quantity").alias("total"),
    )


@query(
    "src2_history_by_day",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, round(sum(quantity), 4) AS total FROM ev GROUP BY 1",
    ("ev",),
)
def src2(spark, d):
    """History written partitioned by day; the report reads the partition column."""
    path = scratch_path(spark, "history")
    H.write_history(T.event_history(spark, d), path)
    back = H.read_history(spark, path)
    return back.groupBy(day("date")).agg(F.count("*").alias("n"), F.sum("quantity").alias("total")).withColumn("total", r("total"))


@query(
    "src5_prescription_rows",
    f"""SELECT CAST(prescription_id AS VARCHAR) AS prescription_id, medicine_id, quantity, coalesce(patient_age, 0) AS patient_age,
        coalesce(is_emergency, false) AS is_emergency, 'No' AS insurance, coalesce(location, 'Store1') AS location, {sql_ts('ts')} AS "timestamp"
        FROM (SELECT * REPLACE (CASE WHEN category <> 'view' THEN patient_age END AS patient_age,
                                CASE WHEN category <> 'click' THEN is_emergency END AS is_emergency,
                                CASE WHEN location <> 'Store2' THEN location END AS location) FROM ev)""",
    ("ev",),
)
def src5(spark, d):
    raw = T.event_history(spark, d)
    sparse = raw.select(
        "prescription_id", "medicine_id", "quantity", "timestamp",
        F.when(F.col("category") != "view", F.col("patient_age")).alias("patient_age"),
        F.when(F.col("category") != "click", F.col("is_emergency")).alias("is_emergency"),
        F.when(F.col("location") != "Store2", F.col("location")).alias("location"),
    )
    return H.prescription_rows(sparse).withColumn("timestamp", ts("timestamp"))


@query("src6_medicine_rows", "SELECT medicine_id, medicine_name, category, unit_price FROM med", ("med",))
def src6(spark, d):
    return H.medicine_rows(T.medicines(spark, d))


@query(
    "src7_point_lookup",
    "SELECT medicine_id, medicine_name, category, unit_price FROM med WHERE medicine_id = (SELECT max(medicine_id) FROM med)",
    ("med",),
)
def src7(spark, d):
    m = T.medicines(spark, d)
    newest = m.agg(F.max("medicine_id").alias("k")).first()["k"]
    return H.medicine_rows(H.lookup(m, "medicine_id", newest))


@query(
    "src9_edi_export",
    """SELECT order_id || '|' || line || '|' || quantity AS row_key, md5(
       'ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *' || strftime(created_at, '%y%m%d') || '*' ||
       strftime(created_at, '%H%M') || '*U*00401*000000001*0*P*>~' || chr(10) ||
       'GS*PO*SENDER*RECEIVER*' || strftime(created_at, '%Y%m%d') || '*' || strftime(created_at, '%H%M') || '*1*X*004010~' || chr(10) ||
       'ST*850*0001~' || chr(10) || 'BEG*00*SA*' || order_id || '**' || strftime(created_at, '%Y%m%d') || '~' || chr(10) ||
       'REF*DP*PHARMACY~' || chr(10) || 'PER*BD*Pharmacy Manager*TE*000-000-0000~' || chr(10) ||
       'PO1*1*' || quantity || '*EA*' || unit_cost || '**VP*' || medicine_id || '~' || chr(10) || 'CTT*1~' || chr(10) ||
       'SE*7*0001~' || chr(10) || 'GE*1*1~' || chr(10) || 'IEA*1*000000001~') AS message_md5 FROM ord""",
    ("ord",),
)
def src9(spark, d):
    o = T.orders_with_items(spark, d)
    return o.select(
        F.concat_ws("|", "order_id", "line", F.col("quantity").cast("string")).alias("row_key"),
        F.md5(X.edi_850(o)).alias("message_md5"),
    )


@query(
    "src10_edi_import",
    "SELECT order_id, quantity, unit_cost, CAST(medicine_id AS VARCHAR) AS medicine_id FROM ord",
    ("ord",),
)
def src10(spark, d):
    """Orders exported as interchange text files and parsed back."""
    path = scratch_path(spark, "edi")
    X.export_edi(T.orders_with_items(spark, d), path)
    return X.parse_edi(X.read_edi(spark, path))


@query(
    "src10_edi_lines",
    "SELECT 'PO-' || split_part(order_id, '-', 2) AS order_id, quantity, unit_cost, CAST(medicine_id AS VARCHAR) AS medicine_id FROM ord",
    ("ord",),
)
def src10_lines(spark, d):
    """Whole baskets as messages of several lines, read back line by line."""
    path = scratch_path(spark, "edi-lines")
    lines = T.orders_with_items(spark, d).withColumn("order_id", F.concat_ws("-", F.lit("PO"), F.col("basket_id")))
    X.write_messages(X.edi_850_of_lines(lines), path)
    return X.parse_edi(X.read_edi(spark, path))


@query(
    "src11_json_round_trip",
    f"SELECT prescription_id, medicine_id, quantity, {sql_ts('ts')} AS \"timestamp\", is_emergency, location FROM ev",
    ("ev",),
)
def src11(spark, d):
    """Events exported as JSON files and imported under their schema."""
    path = scratch_path(spark, "json")
    rx = T.event_history(spark, d).select("prescription_id", "medicine_id", "quantity", "timestamp", "is_emergency", "location")
    X.export_json(rx, path)
    return X.import_json(spark, path, rx.schema).withColumn("timestamp", ts("timestamp"))


@query(
    "src11_json_column",
    "SELECT prescription_id, category, location FROM ev",
    ("ev",),
)
def src11_column(spark, d):
    rx = T.event_history(spark, d).select("prescription_id", "category", "location")
    return X.from_json(X.as_json(rx), rx.schema)


@query(
    "src12_export_range",
    f"""SELECT prescription_id, medicine_id, quantity, {sql_ts('ts')} AS "timestamp" FROM ev
        WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    ("ev",),
)
def src12(spark, d):
    path = scratch_path(spark, "export")
    rx = T.event_history(spark, d).select("prescription_id", "medicine_id", "quantity", "timestamp")
    H.export_history(rx, "2024-01-10", "2024-01-20", "csv", path)
    return H.read_history_csv(spark, path, rx.schema).drop(H.CORRUPT).withColumn("timestamp", ts("timestamp"))


# ---------------------------------------------------------------- projections and filters


@query(
    "prj1_dataset_check",
    """SELECT false AS ok, 'medicine_name, category' AS missing, count(*) AS rows, count(DISTINCT medicine_id) AS items FROM disp""",
    ("disp",),
)
def prj1(spark, d):
    return P.dataset_check(T.dispensing(spark, d))


@query(
    "prj2_validate_record",
    """SELECT prescription_id, m IS NULL AS ok, coalesce('Missing fields: ' || m, 'Valid') AS message FROM (
       SELECT prescription_id, nullif(concat_ws(', ', CASE WHEN category = 'signup' THEN 'medicine_id' END,
              CASE WHEN quantity < 5 THEN 'quantity' END, CASE WHEN patient_age > 90 THEN 'patient_age' END), '') AS m FROM ev)""",
    ("ev",),
)
def prj2(spark, d):
    rx = T.event_history(spark, d).select(
        "prescription_id",
        F.when(F.col("category") != "signup", F.col("medicine_id")).alias("medicine_id"),
        F.when(F.col("quantity") >= 5, F.col("quantity")).alias("quantity"),
        F.when(F.col("patient_age") <= 90, F.col("patient_age")).alias("patient_age"),
    )
    return P.validate_record(rx, ["medicine_id", "quantity", "patient_age"]).select("prescription_id", "ok", "message")


@query(
    "prj3_low_stock",
    """SELECT medicine_id, medicine_name, current_inventory, round(reorder_point, 4) AS reorder_point FROM stock
       WHERE current_inventory < reorder_point""",
    ("stock",),
)
def prj3(spark, d):
    return P.low_stock(T.stock_levels(spark, d)).select("medicine_id", "medicine_name", "current_inventory", r("reorder_point"))


@query(
    "prj4_stock_status",
    """SELECT medicine_id, round(x, 4) AS ratio, CASE WHEN x < 0.5 THEN 'Critical' WHEN x < 1 THEN 'Low' ELSE 'Good' END AS status
       FROM (SELECT medicine_id, current_inventory / coalesce(nullif(reorder_point, 0), 100) AS x FROM stock)""",
    ("stock",),
)
def prj4(spark, d):
    inv, rop = F.col("current_inventory"), F.col("reorder_point")
    return T.stock_levels(spark, d).select(
        "medicine_id", r(P.stock_ratio(inv, rop), name="ratio"), P.stock_status(inv, rop).alias("status")
    )


@query(
    "prj5_severity",
    "SELECT medicine_id, CASE WHEN current_inventory < 0.5 * reorder_point THEN 'high' ELSE 'medium' END AS severity FROM stock",
    ("stock",),
)
def prj5(spark, d):
    return T.stock_levels(spark, d).select("medicine_id", P.severity(F.col("current_inventory"), F.col("reorder_point")).alias("severity"))


@query(
    "prj6_selected_items",
    """SELECT medicine_id, medicine_name FROM med WHERE medicine_id IN (SELECT medicine_id FROM disp WHERE quantity = 50)""",
    ("med", "disp"),
)
def prj6(spark, d):
    """Items that were ever dispensed in the largest pack: an id frame, semi joined."""
    ids = T.dispensing(spark, d).filter("quantity = 50").select("medicine_id")
    return P.select_items(T.medicines(spark, d), ids).select("medicine_id", "medicine_name")


@query(
    "prj7_search",
    "SELECT medicine_id, medicine_name, category FROM med WHERE contains(lower(medicine_name), 'ring') AND category = 'PROMO'",
    ("med",),
)
def prj7(spark, d):
    return P.search_medicines(T.medicines(spark, d), "Ring", "PROMO").select("medicine_id", "medicine_name", "category")


@query(
    "prj8_pending_orders",
    "SELECT order_id, medicine_id, quantity, status FROM ord WHERE status IN ('PENDING', 'APPROVED')",
    ("ord",),
)
def prj8(spark, d):
    return P.pending_orders(T.orders_with_items(spark, d)).select("order_id", "medicine_id", "quantity", "status")


@query("prj9_unresolved_alerts", "SELECT medicine_id, severity, message FROM alert WHERE NOT is_resolved", ("alert",))
def prj9(spark, d):
    return P.unresolved(T.low_stock_alerts(spark, d)).select("medicine_id", "severity", "message")


@query(
    "prj10_prescription_features",
    """SELECT prescription_id, quantity, CAST(is_emergency AS INT) AS is_emergency, CAST(insurance = 'Yes' AS INT) AS has_insurance,
       CASE WHEN patient_age < 18 THEN 0 WHEN patient_age < 35 THEN 1 WHEN patient_age < 50 THEN 2 WHEN patient_age < 65 THEN 3 ELSE 4 END AS age_category
       FROM ev""",
    ("ev",),
)
def prj10(spark, d):
    return P.prescription_features(T.event_history(spark, d))


# ---------------------------------------------------------------- joins


@query(
    "join1_prescriptions_items",
    """SELECT prescription_id, disp.medicine_id, medicine_name, category, quantity FROM disp JOIN med ON med.medicine_id = disp.medicine_id""",
    ("disp", "med"),
)
def join1(spark, d):
    joined = J.with_catalog(T.dispensing(spark, d), T.medicines(spark, d))
    return joined.select("prescription_id", "medicine_id", "medicine_name", "category", "quantity")


@query(
    "join2_orders_items",
    """SELECT order_id, ord.medicine_id, medicine_name, status, round(total_cost, 2) AS total_cost
       FROM ord JOIN med ON med.medicine_id = ord.medicine_id""",
    ("ord", "med"),
)
def join2(spark, d):
    joined = J.with_catalog(T.orders_with_items(spark, d), T.medicines(spark, d))
    return joined.select("order_id", "medicine_id", "medicine_name", "status", r("total_cost", 2))


@query(
    "join5_new_alerts",
    """SELECT medicine_id, message FROM alert WHERE medicine_id NOT IN (SELECT medicine_id FROM alert WHERE is_resolved)""",
    ("alert",),
)
def join5(spark, d):
    alerts = T.low_stock_alerts(spark, d)
    return AL.new_alerts(alerts, alerts.filter("is_resolved")).select("medicine_id", "message")


@query(
    "join6_open_recommendations",
    """SELECT medicine_id, greatest(1, CAST(trunc(reorder_point * 2 - current_inventory) AS BIGINT)) AS order_quantity FROM stock
       WHERE current_inventory < reorder_point
         AND medicine_id NOT IN (SELECT medicine_id FROM ord WHERE status IN ('PENDING', 'APPROVED'))""",
    ("stock", "ord"),
)
def join6(spark, d):
    placed = P.pending_orders(T.orders_with_items(spark, d))
    return J.without_ordered(I.simple_reorder(T.stock_levels(spark, d)), placed).select("medicine_id", "order_quantity")


# ---------------------------------------------------------------- aggregates


@query(
    "agg1_item_summary",
    """SELECT s.medicine_id, medicine_name, category, total_dispensed, round(avg_quantity, 4) AS avg_quantity, prescription_count
       FROM stock s""",
    ("stock",),
)
def agg1(spark, d):
    rx = J.with_catalog(T.dispensing(spark, d), T.medicines(spark, d).select("medicine_id", "medicine_name", "category"))
    return A.item_summary(rx).select(
        "medicine_id", "medicine_name", "category", "total_dispensed", r("avg_quantity"), "prescription_count"
    )


U = "((('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def u_sql(*parts: str) -> str:
    """SQL text of the uniform draw for the given key parts (SQL expressions)."""
    return U.format(key=", ".join(f"CAST({p} AS VARCHAR)" for p in parts))


@query(
    "agg2_derived_stock",
    f"""SELECT medicine_id, floor(total_dispensed * (0.3::DOUBLE + 0.5::DOUBLE * {u_sql("'42'", "'stock'", "medicine_id")})) AS current_inventory,
        round(avg_quantity * 30, 4) AS reorder_point
        FROM (SELECT medicine_id, sum(quantity) AS total_dispensed, avg(quantity) AS avg_quantity FROM disp GROUP BY 1)""",
    ("disp",),
)
def agg2(spark, d):
    rx = T.dispensing(spark, d).groupBy("medicine_id").agg(
        F.sum("quantity").alias("total_dispensed"), F.avg("quantity").alias("avg_quantity")
    )
    return A.derived_stock(rx).select("medicine_id", "current_inventory", r("reorder_point"))


@query("agg3_daily_demand", "SELECT medicine_id, CAST(date AS VARCHAR) AS date, demand FROM daily", ("daily",))
def agg3(spark, d):
    return A.daily_demand(T.dispensing(spark, d)).select("medicine_id", day("date"), "demand")


@query(
    "agg4_running_totals",
    """SELECT medicine_id, sum(quantity) AS total_quantity, count(*) AS "count", round(sum(quantity) / count(*), 2) AS avg_per_rx
       FROM disp GROUP BY 1""",
    ("disp",),
)
def agg4(spark, d):
    return A.running_totals(T.dispensing(spark, d))


@query(
    "agg11_quality_metrics",
    """SELECT count(*) AS total_prescriptions, count(DISTINCT medicine_id) AS unique_medicines, round(avg(quantity), 4) AS avg_quantity,
       round(avg(CAST(is_emergency AS INT)), 6) AS emergency_rate,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6, 4) AS temporal_coverage,
       round(least(0.95, 0.7 + 0.15 * (count(DISTINCT medicine_id) / (SELECT count(*) FROM part)) + 0.10 * least(1.0, count(*) / 1000)), 6) AS utility_score
       FROM rx""",
    ("rx",),
)
def agg11(spark, d):
    size = T.medicines(spark, d).agg(F.count("*")).scalar()
    q = A.quality_metrics(T.prescriptions(spark, d), size)
    return q.select(
        "total_prescriptions", "unique_medicines", r("avg_quantity"), r("emergency_rate", 6), r("temporal_coverage"), r("utility_score", 6)
    )


@query(
    "agg11_quality_histograms",
    """SELECT 'category' AS kind, category AS value, count(*) AS n FROM ev GROUP BY 2 UNION ALL
       SELECT 'hour', CAST(hour_of_day AS VARCHAR), count(*) FROM ev GROUP BY 2""",
    ("ev",),
)
def agg11_hist(spark, d):
    rx = T.event_history(spark, d)
    parts = [
        A.histogram(rx, c).select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"), "n")
        for k, c in (("category", "category"), ("hour", "hour_of_day"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "agg12_table_counts",
    """SELECT 'medicines' AS entity, count(*) AS n FROM part UNION ALL SELECT 'prescriptions', count(*) FROM lineitem
       UNION ALL SELECT 'orders', count(*) FROM orders""",
)
def agg12(spark, d):
    return A.table_counts(
        medicines=T.table(spark, d, "part"), prescriptions=T.table(spark, d, "lineitem"), orders=T.table(spark, d, "orders")
    )


@query(
    "agg13_fill_rate",
    """SELECT medicine_id, round(sum(CASE WHEN quantity >= 45 THEN 0 ELSE 1 END) / greatest(count(*), 1), 6) AS fill_rate, count(*) AS total
       FROM disp GROUP BY 1""",
    ("disp",),
)
def agg13(spark, d):
    """Large requests count as unfilled, requests of insured patients have no flag."""
    rx = T.dispensing(spark, d).withColumn("filled", F.when(F.col("quantity") >= 45, False))
    return A.fill_rate(rx, "medicine_id").select("medicine_id", r("fill_rate", 6), "total")


@query(
    "agg14_value_share",
    """SELECT 'medicine_id' AS kind, CAST(medicine_id AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM disp), 8) AS share FROM disp GROUP BY 2
       UNION ALL SELECT 'location', location, count(*), round(count(*) / (SELECT count(*) FROM disp), 8) FROM disp GROUP BY 2""",
    ("disp",),
)
def agg14(spark, d):
    rx = T.dispensing(spark, d)
    parts = [
        A.value_share(rx, c).select(F.lit(c).alias("kind"), F.col("value").cast("string").alias("value"), "n", r("share", 8))
        for c in ("medicine_id", "location")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "agg15_numeric_marginals",
    """SELECT 'quantity' AS "column", round(avg(quantity), 4) AS mean, round(stddev_samp(quantity), 4) AS std, min(quantity) AS min, max(quantity) AS max FROM rx
       UNION ALL SELECT 'patient_age', round(avg(patient_age), 4), round(stddev_samp(patient_age), 4), min(patient_age), max(patient_age) FROM rx""",
    ("rx",),
)
def agg15(spark, d):
    m = A.numeric_marginals(T.prescriptions(spark, d), ["quantity", "patient_age"])
    return m.select("column", r("mean"), r("std"), "min", "max")


@query(
    "agg16_modal_category",
    """SELECT medicine_id, category FROM (SELECT user_id AS medicine_id, category,
       row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS rn FROM ev GROUP BY 1, 2) WHERE rn = 1""",
    ("ev",),
)
def agg16(spark, d):
    return A.modal_category(T.event_history(spark, d, "user_id"))


@query(
    "agg17_order_report",
    """SELECT coalesce(status, 'ALL') AS status, count(*) AS orders, round(sum(total_cost), 2) AS total_value FROM ord GROUP BY ROLLUP (status)""",
    ("ord",),
)
def agg17(spark, d):
    rep = A.order_report(T.orders_with_items(spark, d))
    return rep.select(F.coalesce("status", F.lit("ALL")).alias("status"), "orders", r("total_value", 2))


@query(
    "agg18_consolidated_orders",
    """SELECT medicine_id, sum(quantity) AS quantity, round(sum(total_cost), 2) AS total_cost, round(max(priority), 4) AS priority,
       min({'c': created_at, 'o': order_id, 'u': unit_cost, 'g': urgency, 's': status}).o AS order_id,
       min({'c': created_at, 'o': order_id, 'u': unit_cost, 'g': urgency, 's': status}).g AS urgency FROM ord GROUP BY 1""",
    ("ord",),
)
def agg18(spark, d):
    c = A.consolidate(T.orders_with_items(spark, d))
    return c.select("medicine_id", "quantity", r("total_cost", 2), r("priority"), "order_id", "urgency")


STRICT = Params(max_order_qty=40, min_order_value=11000.0, max_order_value=40000.0)
RULES_SQL = """CASE WHEN quantity < 10 THEN 'Order quantity below minimum: 10' WHEN quantity > 40 THEN 'Order quantity exceeds maximum: 40'
       WHEN quantity * unit_cost < 11000 THEN 'Order value below minimum: $11000'
       WHEN quantity * unit_cost > 40000 THEN 'Order value exceeds maximum: $40000' END"""


@query(
    "agg19_execution_summary",
    f"""SELECT urgency, count(*) AS total, sum(CASE WHEN m IS NULL THEN 1 ELSE 0 END)::BIGINT AS successful,
        sum(CASE WHEN m IS NULL THEN 0 ELSE 1 END)::BIGINT AS failed FROM (SELECT urgency, {RULES_SQL} AS m FROM ord) GROUP BY 1""",
    ("ord",),
)
def agg19(spark, d):
    done = O.execute(T.orders_with_items(spark, d), F.col("created_at"), STRICT)
    return A.execution_summary(done, "urgency")


@query(
    "agg20_analytics_summary",
    """SELECT (SELECT count(*) FROM stock) AS total_medicines, count(*) AS total_prescriptions,
       round(count(*) / count(DISTINCT CAST(ts AS DATE)), 4) AS avg_daily_prescriptions,
       (SELECT round(sum(current_inventory * unit_price), 2) FROM stock) AS inventory_value,
       (SELECT count(*) FROM ord WHERE status IN ('PENDING', 'APPROVED')) AS pending_orders FROM disp""",
    ("disp", "stock", "ord"),
)
def agg20(spark, d):
    s = A.analytics_summary(T.dispensing(spark, d), T.stock_levels(spark, d), T.orders_with_items(spark, d))
    return s.select(
        "total_medicines", "total_prescriptions", r("avg_daily_prescriptions"), r("inventory_value", 2), "pending_orders"
    )


@query(
    "agg20_top_categories",
    "SELECT category, count(*) AS n FROM disp JOIN med ON med.medicine_id = disp.medicine_id GROUP BY 1 ORDER BY n DESC, category LIMIT 3",
    ("disp", "med"),
)
def agg20_top(spark, d):
    return A.top_categories(T.dispensing(spark, d), T.medicines(spark, d))


@query(
    "agg_performance_metrics",
    """SELECT 'fill_rate' AS metric_type, round(avg(CASE WHEN quantity >= 300 THEN 0 ELSE 1 END), 6) AS metric_value, 0.9995::DOUBLE AS target_value, 'ratio' AS unit FROM ev
       UNION ALL SELECT 'throughput', round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6), 10000::DOUBLE, 'events/s' FROM ev""",
    ("ev",),
)
def agg_metrics(spark, d):
    rx = T.event_history(spark, d).withColumn("filled", F.col("quantity") < 300)
    return A.performance_metrics(rx).select("metric_type", r("metric_value", 6), r("target_value", 6), "unit")


# ---------------------------------------------------------------- top-k


@query(
    "top1_items_by_demand",
    """SELECT medicine_id, sum(quantity) AS total, count(*) AS "count" FROM disp GROUP BY 1 ORDER BY total DESC, medicine_id LIMIT 50""",
    ("disp",),
)
def top1(spark, d):
    return R.top_items(T.dispensing(spark, d), 50)


@query("top2_most_frequent", "SELECT medicine_id, count(*) AS n FROM disp GROUP BY 1 ORDER BY n DESC, medicine_id LIMIT 1", ("disp",))
def top2(spark, d):
    return R.most_frequent_item(T.dispensing(spark, d))


@query(
    "top3_live_leaders",
    """SELECT user_id AS medicine_id, round(sum(quantity), 4) AS total, count(*) AS "count", round(sum(quantity) / count(*), 2) AS avg
       FROM ev GROUP BY 1 ORDER BY sum(quantity) DESC, 1 LIMIT 10""",
    ("ev",),
)
def top3(spark, d):
    totals = A.running_totals(T.event_history(spark, d, "user_id"))
    return R.live_top(totals).select("medicine_id", r("total"), "count", "avg")


@query(
    "top5_recent_alerts",
    f"""SELECT medicine_id, severity, message, {sql_ts('created_at')} AS created_at FROM alert WHERE NOT is_resolved
        ORDER BY alert.created_at DESC, medicine_id LIMIT 20""",
    ("alert",),
)
def top5(spark, d):
    return AL.recent_alerts(T.low_stock_alerts(spark, d)).select("medicine_id", "severity", "message", ts("created_at"))


@query(
    "top7_time_sorted",
    f"""SELECT prescription_id, {sql_ts('ts')} AS "timestamp" FROM ev""",
    ("ev",),
)
def top7(spark, d):
    return R.time_sorted(T.event_history(spark, d), "prescription_id").select("prescription_id", ts("timestamp"))


@query(
    "top8_metric_history",
    """SELECT metric, prescription_id, metric_value, rn AS rank FROM (SELECT category AS metric, prescription_id, quantity AS metric_value,
       row_number() OVER (PARTITION BY category ORDER BY ts DESC, prescription_id) AS rn FROM ev) WHERE rn <= 30""",
    ("ev",),
)
def top8(spark, d):
    samples = T.event_history(spark, d).select(
        F.col("category").alias("metric"), "prescription_id", F.col("quantity").alias("metric_value"), "timestamp"
    )
    kept = R.keep_newest(samples, ["metric"], [F.desc("timestamp"), F.asc("prescription_id")])
    return kept.select("metric", "prescription_id", "metric_value", big("rank"))


# ---------------------------------------------------------------- set operations


@query(
    "set4_alert_list",
    """SELECT alert_type, medicine_id, message, severity FROM alert UNION ALL
       SELECT 'ORDER_PLACED', medicine_id, 'Order placed: ' || CAST(quantity AS BIGINT) || ' units', 'info' FROM ord WHERE status = 'APPROVED'""",
    ("alert", "ord"),
)
def set4(spark, d):
    placed = AL.order_placed(P.pending_orders(T.orders_with_items(spark, d)).filter("status = 'APPROVED'"), F.col("created_at"))
    both = T.low_stock_alerts(spark, d).select(*AL.ALERT_COLUMNS).unionByName(placed)
    return both.drop("created_at")


@query(
    "set5_missing_fields",
    """SELECT concat_ws(',', CASE WHEN category = 'signup' THEN 'medicine_id' END, CASE WHEN quantity < 5 THEN 'quantity' END) AS missing,
       count(*) AS n FROM ev GROUP BY 1""",
    ("ev",),
)
def set5(spark, d):
    rx = T.event_history(spark, d).select(
        F.when(F.col("category") != "signup", F.col("medicine_id")).alias("medicine_id"),
        F.when(F.col("quantity") >= 5, F.col("quantity")).alias("quantity"),
    )
    named = rx.select(F.concat_ws(",", P.missing_fields(["medicine_id", "quantity"])).alias("missing"))
    return named.groupBy("missing").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scalars


@query(
    "fn1_time_features",
    """SELECT prescription_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, day(ts)::INT AS day_of_month, month(ts)::INT AS month,
       quarter(ts)::INT AS quarter, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) BETWEEN 9 AND 17 AS INT) AS is_business_hours FROM ev""",
    ("ev",),
)
def fn1(spark, d):
    return T.event_history(spark, d).select("prescription_id", *[c.alias(n) for n, c in S.time_features(F.col("timestamp")).items()])


@query("fn2_day_name", "SELECT prescription_id, dayname(ts) AS day_of_week, hour(ts)::INT AS hour_of_day FROM ev", ("ev",))
def fn2(spark, d):
    t = F.col("timestamp")
    return T.event_history(spark, d).select("prescription_id", S.day_name(t).alias("day_of_week"), F.hour(t).alias("hour_of_day"))


@query(
    "fn3_age_band",
    """SELECT CASE WHEN patient_age < 18 THEN '0-17' WHEN patient_age < 35 THEN '18-34' WHEN patient_age < 50 THEN '35-49'
       WHEN patient_age < 65 THEN '50-64' ELSE '65+' END AS age_group, count(*) AS n FROM rx GROUP BY 1""",
    ("rx",),
)
def fn3(spark, d):
    return T.prescriptions(spark, d).groupBy(S.age_band(F.col("patient_age")).alias("age_group")).agg(F.count("*").alias("n"))


@query(
    "fn4_currency",
    """SELECT medicine_id, CASE storage_type WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE '$' END || format('{:,.2f}', unit_price * 1000) AS price
       FROM (SELECT medicine_id, unit_price, CASE shelf_life_days WHEN 180 THEN 'EUR' WHEN 365 THEN 'GBP' WHEN 730 THEN 'USD' ELSE 'CHF' END AS storage_type FROM med)""",
    ("med",),
)
def fn4(spark, d):
    life = F.col("shelf_life_days")
    code = F.when(life == 180, "EUR").when(life == 365, "GBP").when(life == 730, "USD").otherwise("CHF")
    return T.medicines(spark, d).select("medicine_id", S.currency(F.col("unit_price") * 1000, code).alias("price"))


@query(
    "fn5_days_between",
    """SELECT prescription_id, abs(CAST(floor((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 86400e6) AS BIGINT)) AS days FROM ev""",
    ("ev",),
)
def fn5(spark, d):
    mid = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return T.event_history(spark, d).select("prescription_id", big(S.days_between(F.col("timestamp"), mid), "days"))


@query(
    "fn6_tagged_id",
    """SELECT prescription_id, 'ID' || lpad(CAST(('0x' || substr(m, 9, 8))::BIGINT % 1000000 AS VARCHAR), 6, '0') || substr(m, 1, 8) AS tag
       FROM (SELECT prescription_id, md5(CAST(prescription_id AS VARCHAR)) AS m FROM ev)""",
    ("ev",),
)
def fn6(spark, d):
    return T.event_history(spark, d).select("prescription_id", S.tagged_id("ID", F.col("prescription_id").cast("string")).alias("tag"))


@query(
    "fn7_event_id",
    """SELECT prescription_id, 'RX' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || substr(md5(CAST(prescription_id AS VARCHAR)), 1, 16) AS tag FROM ev""",
    ("ev",),
)
def fn7(spark, d):
    return T.event_history(spark, d).select(
        "prescription_id", S.event_id("RX", F.col("timestamp"), F.col("prescription_id").cast("string")).alias("tag")
    )


@query(
    "fn8_service_z",
    """SELECT medicine_id, CASE shelf_life_days WHEN 180 THEN 1.28 WHEN 365 THEN 1.65 WHEN 730 THEN 3.29 ELSE 1.96 END::DOUBLE AS z FROM med""",
    ("med",),
)
def fn8(spark, d):
    life = F.col("shelf_life_days")
    level = F.when(life == 180, 0.90).when(life == 365, 0.95).when(life == 730, 0.9995).otherwise(0.97)
    return T.medicines(spark, d).select("medicine_id", S.service_z(level).alias("z"))


@query(
    "fn9_confidence_z",
    """SELECT medicine_id, round(avg(quantity) + 1.959963984540054 * stddev_samp(quantity) / sqrt(count(*)), 4) AS upper_mean FROM disp GROUP BY 1""",
    ("disp",),
)
def fn9(spark, d):
    error = F.stddev_samp("quantity") / F.sqrt(F.count("*"))
    return T.dispensing(spark, d).groupBy("medicine_id").agg(r(F.avg("quantity") + F.lit(Params().z) * error, name="upper_mean"))


@query(
    "fn10_laplace_noise",
    f"""SELECT prescription_id, round(-sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) AS noise FROM (
        SELECT prescription_id, {u_sql("'dp42'", "prescription_id")} AS u FROM ev)""",
    ("ev",),
)
def fn10(spark, d):
    u = draws.uniform("dp42", F.col("prescription_id"))
    return T.event_history(spark, d).select("prescription_id", r(draws.laplace(1.0, u), 6, "noise"))


@query(
    "fn11_finite_or_zero",
    """SELECT medicine_id, round(CASE WHEN total_dispensed = n * 25 THEN 0 ELSE total_dispensed / n END, 4) AS value
       FROM (SELECT medicine_id, total_dispensed, prescription_count AS n FROM stock)""",
    ("stock",),
)
def fn11(spark, d):
    """Items whose mean is exactly 25 are marked not-a-number before cleaning."""
    s = T.stock_levels(spark, d)
    x = F.when(F.col("total_dispensed") == F.col("prescription_count") * 25, F.lit(float("nan"))).otherwise(F.col("avg_quantity"))
    return s.select("medicine_id", r(S.finite_or_zero(x), name="value"))


@query(
    "fn12_clamp",
    "SELECT prescription_id, greatest(5.0, least(100.0, trunc(quantity * 1.5))) AS clipped, greatest(0, quantity - 50) AS floored FROM ev",
    ("ev",),
)
def fn12(spark, d):
    q = F.col("quantity")
    return T.event_history(spark, d).select(
        "prescription_id", S.clip_int(q * 1.5, F.lit(5.0), F.lit(100.0)).alias("clipped"), S.at_least_zero(q - 50).alias("floored")
    )


@query(
    "fn13_sine_season",
    "SELECT medicine_id, round(0.2 * avg_quantity * sin(2 * pi() * (medicine_id % 7) / 7), 4) + 0.0 AS season FROM stock",
    ("stock",),
)
def fn13(spark, d):
    return T.stock_levels(spark, d).select("medicine_id", r(S.sine_season(F.col("avg_quantity"), F.col("medicine_id") % 7), name="season"))


@query(
    "fn15_seasonal_factor",
    """SELECT prescription_id, (CASE WHEN category IN ('PROMO', 'SMALL') THEN [1.5, 1.4, 1.2, 0.9, 0.7, 0.6, 0.6, 0.7, 0.9, 1.1, 1.3, 1.5][month(ts)]
       WHEN category = 'LARGE' THEN [0.8, 0.9, 1.0, 1.2, 1.5, 1.6, 1.6, 1.5, 1.2, 1.0, 0.9, 0.8][month(ts)] ELSE 1.0 END)::DOUBLE AS factor
       FROM disp JOIN med ON med.medicine_id = disp.medicine_id""",
    ("disp", "med"),
)
def fn15(spark, d):
    rx = J.with_catalog(T.dispensing(spark, d), T.medicines(spark, d).select("medicine_id", "category"))
    f = S.seasonal_factor(F.col("category"), F.month("timestamp"), ("PROMO", "SMALL"), ("LARGE",))
    return rx.select("prescription_id", f.alias("factor"))


@query(
    "fn16_hour_weight",
    """SELECT prescription_id, CASE WHEN hour(ts) BETWEEN 9 AND 20 THEN 2.0 WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight FROM ev""",
    ("ev",),
)
def fn16(spark, d):
    return T.event_history(spark, d).select("prescription_id", S.hour_weight(F.hour("timestamp")).alias("weight"))


@query(
    "fn17_erp_payload",
    f"""SELECT order_id AS external_order_id, medicine_id AS item_code, quantity, unit_cost AS unit_price, round(total_cost, 2) AS total_amount,
        urgency AS priority, '' AS supplier_code, '' AS notes, {sql_ts('created_at')} AS created_at FROM ord""",
    ("ord",),
)
def fn17(spark, d):
    p = O.erp_payload(T.orders_with_items(spark, d))
    return p.withColumn("total_amount", r("total_amount", 2)).withColumn("created_at", ts("created_at"))


@query(
    "fn18_alert_texts",
    """SELECT medicine_id, medicine_name || ': Only ' || greatest(0, CAST(current_inventory AS BIGINT)) || ' units remaining' AS initial_text,
       medicine_name || ' below reorder point' AS plain_text, message FROM alert""",
    ("alert",),
)
def fn18(spark, d):
    name, left = F.col("medicine_name"), F.col("current_inventory")
    return T.low_stock_alerts(spark, d).select(
        "medicine_id",
        S.low_stock_text(name, left, "initial").alias("initial_text"),
        S.low_stock_text(name, left, "plain").alias("plain_text"),
        "message",
    )


@query(
    "fn19_forecast_dates",
    """SELECT medicine_id, h, CAST(CAST(last_dispensed AS DATE) + h + 1 AS VARCHAR) AS forecast_date
       FROM stock, (SELECT CAST(unnest(range(30)) AS INT) AS h)""",
    ("stock",),
)
def fn19(spark, d):
    rows = T.stock_levels(spark, d).select("medicine_id", "last_dispensed", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("h"))
    when = S.forecast_date(F.to_date("last_dispensed"), F.col("h"))
    return rows.select("medicine_id", "h", when.cast("string").alias("forecast_date"))


# ---------------------------------------------------------------- alert maintenance


@query(
    "str10_alert_sweep",
    """SELECT alert_type, medicine_id, message, severity FROM alert""",
    ("alert",),
)
def str10(spark, d):
    """Periodic sweep over a table that already holds some of the alerts: nothing twice, nothing lost."""
    existing = T.low_stock_alerts(spark, d).filter("is_resolved")
    return AL.sweep(T.stock_levels(spark, d), existing, F.col("last_dispensed")).drop("created_at")


@query(
    "inv21_low_stock_alerts",
    """SELECT medicine_id, 'WARNING' AS severity, medicine_name || ' below reorder point' AS message FROM stock WHERE current_inventory < reorder_point""",
    ("stock",),
)
def inv21(spark, d):
    return AL.raise_low_stock(T.stock_levels(spark, d), F.col("last_dispensed"), "warning").select("medicine_id", "severity", "message")


@query(
    "inv22_resolved_alerts",
    """SELECT a.medicine_id, a.is_resolved OR o.medicine_id IS NOT NULL AS is_resolved FROM alert a
       LEFT JOIN (SELECT DISTINCT medicine_id FROM ord WHERE status = 'APPROVED') o ON o.medicine_id = a.medicine_id""",
    ("alert", "ord"),
)
def inv22(spark, d):
    """An approved order for an item resolves its low-stock alert."""
    asked = (
        T.orders_with_items(spark, d).filter("status = 'APPROVED'").groupBy("medicine_id").agg(F.max("created_at").alias("resolved_at"))
        .withColumn("alert_type", F.lit("LOW_STOCK"))
    )
    return AL.resolve(T.low_stock_alerts(spark, d), asked).select("medicine_id", "is_resolved")
