"""Inventory decisions, policies and order execution over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from replenish.operators import aggregates as A
from replenish.operators import forecast as FC
from replenish.operators import inventory as I
from replenish.operators import joins as J
from replenish.operators import orders as O
from replenish.operators import policy as PO
from replenish.operators import ranking as R
from replenish.params import Params
from replenish.plans import inputs  # noqa: F401
from replenish.plans import replenishment as PL
from replenish.plans.basics import RULES_SQL, STRICT, u_sql
from replenish.plans.registry import common, query
from replenish.plans.tidy import big, r, sql_ts, ts
from replenish.session import stored
from replenish.sources import tables as T

common(
    "totals",
    """SELECT medicine_id, sum(forecast) FILTER (h < 7) AS f7, sum(forecast) AS f30, avg(forecast) AS fm, any_value(std_selling) AS sd FROM base GROUP BY 1""",
    "base",
)
common(
    "target",
    """SELECT *, inv < rop AS should_order, CASE WHEN inv < rop THEN greatest(opt - inv, 10) ELSE 0 END AS qty FROM (
       SELECT *, f7 + ss AS rop, least(eoq, annual / 365 * shelf * 0.8, 1000) AS opt FROM (
         SELECT s.medicine_id, s.medicine_name, current_inventory AS inv, unit_price AS cost, shelf_life_days AS shelf, f7, f30, fm, sd, annual,
           greatest(0, 1.65 * sd * sqrt(7)) AS ss, CASE WHEN annual > 0 AND unit_price > 0 THEN sqrt(2 * annual * 100 / (0.5 * unit_price)) ELSE 0 END AS eoq
         FROM stock s JOIN (SELECT *, f30 * (365.0 / 30) AS annual FROM totals) t ON t.medicine_id = s.medicine_id))""",
    "stock",
    "totals",
)
common(
    "noise",
    f"""SELECT s, d, sqrt(-2 * ln({u_sql("'short42a'", "s", "d")})) * cos(2 * pi() * {u_sql("'short42b'", "s", "d")}) AS z
        FROM (SELECT unnest(range(1000)) AS s), (SELECT unnest(range(30)) AS d)""",
)
common(
    "shortage",
    """SELECT medicine_id, sum(excess) / 1000 * 50 AS shortage_cost FROM (
       SELECT medicine_id, s, arg_min(cum - level, d) FILTER (cum > level) AS excess FROM (
         SELECT t.medicine_id, s, d, inv + qty AS level, sum(greatest(0, forecast + std_selling * z)) OVER (PARTITION BY t.medicine_id, s ORDER BY d) AS cum
         FROM target t JOIN base ON base.medicine_id = t.medicine_id JOIN noise ON noise.d = base.h) GROUP BY 1, 2) GROUP BY 1""",
    "target",
    "base",
    "noise",
)
common(
    "outcome",
    """SELECT *, holding + short + waste * cost * 2 AS total FROM (
       SELECT t.*, (inv + qty) / 2 * 0.5 * cost * 30 AS holding, coalesce(shortage_cost, 0) AS short, greatest(0, inv + qty - 1.1 * f30) AS waste
       FROM target t LEFT JOIN shortage x ON x.medicine_id = t.medicine_id)""",
    "target",
    "shortage",
)


def items(spark, d):
    return PL.items_with_baseline(T.dispensing(spark, d), T.stock_levels(spark, d))


def roomy(spark, d):
    """A capacity that fits the data: 1.2 times all stock."""
    return T.stock_levels(spark, d).agg(F.sum("current_inventory") * 1.2).scalar()


@query(
    "inv1_5_stock_targets",
    """SELECT medicine_id, round(ss, 3) AS safety_stock, round(rop, 3) AS reorder_point, round(eoq, 3) AS economic_order_quantity, round(opt, 3) AS optimal_order_quantity,
       should_order, round(qty, 3) AS order_quantity FROM target""",
    ("target",),
)
def inv1_5(spark, d):
    t = I.stock_targets(items(spark, d))
    return t.select(
        "medicine_id", r("safety_stock", 3), r("reorder_point", 3), r("economic_order_quantity", 3),
        r("optimal_order_quantity", 3), "should_order", r("order_quantity", 3),
    )


@query(
    "inv6_9_expected_costs",
    """SELECT medicine_id, round(holding, 2) AS holding, round(short, 3) AS shortage, round(waste, 3) AS waste, round(total, 2) AS total FROM outcome""",
    ("outcome",),
)
def inv6_9(spark, d):
    o = I.optimize_items(items(spark, d))
    return o.select(
        "medicine_id",
        r("expected_holding_cost", 2, "holding"),
        r("expected_shortage_cost", 3, "shortage"),
        r("expected_waste", 3, "waste"),
        r("total_expected_cost", 2, "total"),
    )


@query(
    "inv10_capacity_allocation",
    """SELECT medicine_id, (CASE WHEN should_order AND opt >= 10 THEN 10 ELSE 0 END)::DOUBLE AS optimized_order_quantity, CASE WHEN should_order AND opt < 10 THEN 'Infeasible' WHEN (SELECT sum(inv + CASE WHEN should_order AND opt >= 10 THEN 10 ELSE 0 END) <= 1.2 * sum(inv)
       FROM target) THEN 'Optimal' ELSE 'Infeasible' END AS status FROM target""",
    ("target",),
)
def inv10(spark, d):
    a = I.allocate_with_capacity(I.stock_targets(items(spark, d)), roomy(spark, d))
    return a.select("medicine_id", "optimized_order_quantity", "status")


@query(
    "inv10_capacity_exceeded",
    "SELECT medicine_id, CASE WHEN (SELECT sum(inv + CASE WHEN should_order THEN 10 ELSE 0 END) FROM target) <= 10000 THEN 'Optimal' ELSE 'Infeasible' END AS status FROM target",
    ("target",),
)
def inv10_small(spark, d):
    """The default capacity, which this data exceeds."""
    return I.allocate_with_capacity(I.stock_targets(items(spark, d))).select("medicine_id", "status")


common(
    "chosen",
    """SELECT *, wanted > 20 AS tight, CASE WHEN wanted > 20 THEN 0 ELSE wanted END AS q FROM (
       SELECT medicine_id, inv * 0.05 AS i, cost, fm, greatest(0, 0.95 * fm - inv * 0.05) AS wanted FROM target)""",
    "target",
)


@query(
    "inv11_budget_allocation",
    """SELECT medicine_id, round(q, 4) AS order_quantity, round(q * cost, 2) AS total_cost, CASE WHEN i / greatest(fm, 1) < 7 THEN 1.0 WHEN i / greatest(fm, 1) < 14 THEN 0.7 WHEN i / greatest(fm, 1) < 30 THEN 0.4 ELSE 0.1 END::DOUBLE AS priority,
       CASE WHEN tight OR (SELECT sum(i + q) > 100000000 OR sum(q * cost) > 1000000000 FROM chosen) THEN 'Infeasible' ELSE 'Optimal' END AS status,
       CASE WHEN (SELECT sum(i + q) > 100000000 FROM chosen) THEN 'capacity is short' WHEN (SELECT sum(q * cost) > 1000000000 FROM chosen) THEN 'budget is short'
            WHEN tight THEN 'needs more than its maximum order' END AS reason
       FROM chosen WHERE wanted > 0""",
    ("chosen",),
)
def inv11(spark, d):
    """Stock cut to a twentieth, so that the service level binds for many items; some need more than 20 units."""
    low = items(spark, d).withColumn("current_inventory", F.col("current_inventory") * 0.05).withColumn(
        "max_order_quantity", F.lit(20.0)
    )
    mean = F.aggregate("forecast", F.lit(0.0), lambda a, x: a + x) / F.size("forecast")
    out = I.allocate_with_budget(low.withColumn("mean_demand", mean), F.col("mean_demand"), 1e8, 1e9)
    days = F.col("current_inventory") / F.greatest(F.col("mean_demand"), F.lit(1.0))
    return out.filter("order_quantity > 0 or status = 'Infeasible'").select(
        "medicine_id", r("order_quantity"), r("total_cost", 2), I.supply_priority(days).alias("priority"), "status", "reason"
    )


@query(
    "join4_12_supply_priority",
    """SELECT s.medicine_id, CASE WHEN days < 7 THEN 1.0 WHEN days < 14 THEN 0.7 WHEN days < 30 THEN 0.4 ELSE 0.1 END::DOUBLE AS priority FROM (
       SELECT stock.medicine_id, CASE WHEN fm IS NULL THEN 30 ELSE current_inventory / greatest(fm, 1) END AS days FROM stock
       LEFT JOIN totals t ON t.medicine_id = stock.medicine_id) s""",
    ("stock", "totals"),
)
def join4(spark, d):
    """Items without a forecast would count as 30 days of supply."""
    stock = T.stock_levels(spark, d)
    stats = FC.demand_stats(A.daily_demand(T.dispensing(spark, d)))
    mean = A.forecast_stats(FC.baseline_forecast(stats), "medicine_id").select("medicine_id", F.col("mean_forecast").alias("mean_demand"))
    return J.days_of_supply(stock, mean).select("medicine_id", I.supply_priority(F.col("days_of_supply")).alias("priority"))


@query(
    "join3_items_with_forecast",
    "SELECT s.medicine_id, s.medicine_name, round(fm, 4) AS mean_forecast FROM stock s JOIN totals t ON t.medicine_id = s.medicine_id",
    ("stock", "totals"),
)
def join3(spark, d):
    stats = A.forecast_stats(FC.baseline_forecast(FC.demand_stats(A.daily_demand(T.dispensing(spark, d)))), "medicine_id")
    return J.with_forecast(T.stock_levels(spark, d), stats).select("medicine_id", "medicine_name", r("mean_forecast"))


RECOMMEND_SQL = """SELECT medicine_id, 10.0::DOUBLE AS order_quantity, round(greatest(0, least(1, 0.6 * (1 - inv / greatest(rop, 1)) + 0.4 / (1 + total))), 6) AS priority,
       round(greatest(0, short * 2 + waste * 1.5 - total), 2) AS expected_cost_savings, CASE WHEN inv < ss THEN 'HIGH' ELSE 'NORMAL' END AS urgency,
       coalesce(nullif(concat_ws('; ', CASE WHEN inv < ss THEN 'Inventory below safety stock' END, CASE WHEN inv < rop THEN 'Below reorder point' END,
         CASE WHEN short > 100 THEN 'High shortage risk' END), ''), 'Optimal replenishment cycle') AS rationale FROM outcome
       WHERE should_order AND opt >= 10 AND (SELECT sum(inv + CASE WHEN should_order AND opt >= 10 THEN 10 ELSE 0 END) <= 1.2 * sum(inv) FROM target)"""


@query("inv13_recommendations", RECOMMEND_SQL, ("outcome", "target"))
def inv13(spark, d):
    """The whole chain: history, daily demand, forecast, costs, allocation, sorted recommendations."""
    out = PL.recommendations(items(spark, d), roomy(spark, d))
    return out.select(
        "medicine_id", "order_quantity", r("priority", 6), r("expected_cost_savings", 2), "urgency", "rationale"
    )


@query(
    "inv14_15_priority_savings",
    """SELECT medicine_id, round(greatest(0, least(1, 0.6 * (1 - inv / greatest(rop, 1)) + 0.4 / (1 + total))), 6) AS priority,
       round(greatest(0, short * 2 + waste * 1.5 - total), 2) AS savings FROM outcome""",
    ("outcome",),
)
def inv14_15(spark, d):
    o = I.optimize_items(items(spark, d))
    return o.select("medicine_id", r(I.priority_score(), 6, "priority"), r(I.cost_savings(), 2, "savings"))


@query(
    "fn14_rationale",
    """SELECT medicine_id, coalesce(nullif(concat_ws('; ', CASE WHEN inv < ss THEN 'Inventory below safety stock' END, CASE WHEN inv < rop THEN 'Below reorder point' END,
         CASE WHEN short > 100 THEN 'High shortage risk' END), ''), 'Optimal replenishment cycle') AS rationale FROM outcome""",
    ("outcome",),
)
def fn14(spark, d):
    return I.optimize_items(items(spark, d)).select("medicine_id", I.rationale().alias("rationale"))


@query(
    "top4_sorted_recommendations",
    """SELECT row_number() OVER (ORDER BY priority DESC, medicine_id) - 1 AS position, medicine_id FROM (
       SELECT medicine_id, 1 - current_inventory / reorder_point AS priority FROM stock WHERE current_inventory < reorder_point)""",
    ("stock",),
)
def top4(spark, d):
    recs = R.by_priority(I.simple_reorder(T.stock_levels(spark, d)))
    return R.global_position(recs, [F.desc("priority"), F.asc("medicine_id")]).select("position", "medicine_id")


@query(
    "inv16_simple_reorder",
    """SELECT medicine_id, greatest(1, CAST(trunc(reorder_point * 2 - current_inventory) AS BIGINT)) AS order_quantity, round(1 - current_inventory / reorder_point, 6) AS priority,
       CASE WHEN current_inventory < reorder_point * 0.5 THEN 'HIGH' ELSE 'NORMAL' END AS urgency FROM stock WHERE current_inventory < reorder_point""",
    ("stock",),
)
def inv16(spark, d):
    return I.simple_reorder(T.stock_levels(spark, d)).select("medicine_id", "order_quantity", r("priority", 6), "urgency")


# ---------------------------------------------------------------- policies

def _histogram(spark, d):
    return PO.demand_histogram(A.daily_demand(T.dispensing(spark, d)))


@query("inv17_policy")
def inv17(spark, d):
    """Policies until no order changes (rows-only: SQL has no counterpart; inv17_bellman_residual checks the values)."""
    return PO.optimal_policy(_histogram(spark, d)).select(
        "medicine_id", "stock_level", "order_quantity", r("value", 3), "rounds", "converged"
    )


@query("inv17_bellman_residual", "SELECT DISTINCT medicine_id, true AS converged, true AS solved FROM daily", ("daily",))
def inv17_residual(spark, d):
    """Whether each item's policy converged, and its values are those that one step from them gives."""
    histogram = _histogram(spark, d)
    policy = stored(PO.optimal_policy(histogram), "policy")
    ended = policy.groupBy("medicine_id").agg(F.bool_and("converged").alias("converged"))
    residual = PO.bellman_residual(histogram, policy)
    return ended.join(residual, "medicine_id").select("medicine_id", "converged", (F.col("residual") < 1e-6).alias("solved"))


@query("inv18_apply_policy")
def inv18(spark, d):
    """Orders of the converged policies (rows-only, as inv17_policy)."""
    return PO.apply_policy(T.stock_levels(spark, d), PO.optimal_policy(_histogram(spark, d))).select(
        "medicine_id", "stock_level", "order_quantity"
    )


@query(
    "join13_reward_table",
    """SELECT category AS "group", state, action, round(-0.25 * (state + action) - CASE WHEN action > 0 THEN 100 ELSE 0 END - 50 * sum(n * greatest(0, quantity - state - action)) / sum(n), 6) AS reward
       FROM (SELECT category, quantity, count(*) AS n FROM disp JOIN med ON med.medicine_id = disp.medicine_id GROUP BY 1, 2),
            (SELECT unnest(range(0, 1001, 10)) AS state), (SELECT unnest(range(0, 501, 10)) AS action) GROUP BY 1, 2, 3""",
    ("disp", "med"),
)
def join13(spark, d):
    per_item = T.dispensing(spark, d).groupBy("medicine_id", "quantity").agg(F.count("*").alias("n"))
    cats = T.medicines(spark, d).select("medicine_id", F.col("category").alias("group"))
    demand = per_item.join(cats, "medicine_id").groupBy("group", F.col("quantity").alias("demand")).agg(F.sum("n").alias("n"))
    return J.reward_table(demand).select("group", big("state"), big("action"), r("reward", 6))


# ---------------------------------------------------------------- stock and orders


@query(
    "inv19_stock_after_orders",
    """SELECT s.medicine_id, current_inventory + coalesce(q, 0) AS current_inventory FROM stock s
       LEFT JOIN (SELECT medicine_id, sum(quantity) AS q FROM ord WHERE status = 'APPROVED' GROUP BY 1) o ON o.medicine_id = s.medicine_id""",
    ("stock", "ord"),
)
def inv19(spark, d):
    placed = T.orders_with_items(spark, d).filter("status = 'APPROVED'")
    return I.stock_after_orders(T.stock_levels(spark, d), placed).select("medicine_id", "current_inventory")


@query(
    "inv19_place_orders",
    """SELECT 'stock' AS effect, s.medicine_id, (current_inventory + coalesce(q, 0))::DOUBLE AS quantity, NULL::VARCHAR AS message FROM stock s
         LEFT JOIN (SELECT medicine_id, sum(quantity) AS q FROM ord WHERE status = 'APPROVED' GROUP BY 1) o ON o.medicine_id = s.medicine_id
       UNION ALL SELECT 'open', medicine_id, greatest(1, CAST(trunc(reorder_point * 2 - current_inventory) AS BIGINT))::DOUBLE, NULL FROM stock
         WHERE current_inventory < reorder_point AND medicine_id NOT IN (SELECT medicine_id FROM ord WHERE status = 'APPROVED')
       UNION ALL SELECT 'alert', medicine_id, NULL, 'Order placed: ' || CAST(quantity AS BIGINT) || ' units' FROM ord WHERE status = 'APPROVED'""",
    ("stock", "ord"),
)
def inv19_step(spark, d):
    """Stock, open recommendations and alerts after the approved orders, in one step."""
    stock = T.stock_levels(spark, d)
    placed = T.orders_with_items(spark, d).filter("status = 'APPROVED'")
    return PL.place_orders(stock, I.simple_reorder(stock), placed, F.col("created_at"))


@query(
    "inv20_adjustments",
    """SELECT s.medicine_id, current_inventory AS inventory_before, q AS adjustment, n AS transactions, current_inventory + q AS inventory_after FROM stock s
       JOIN (SELECT medicine_id, sum(CASE WHEN location = 'R' THEN quantity ELSE -quantity END) AS q, count(*) AS n FROM disp GROUP BY 1) a ON a.medicine_id = s.medicine_id""",
    ("stock", "disp"),
)
def inv20(spark, d):
    back = F.when(F.col("location") == "R", F.col("quantity")).otherwise(-F.col("quantity"))
    moves = T.dispensing(spark, d).select("medicine_id", back.alias("adjustment"))
    return I.adjust_stock(T.stock_levels(spark, d), moves)


@query(
    "ord1_validation",
    f"SELECT order_id, medicine_id, m IS NULL AS is_valid, coalesce(m, 'Order validated successfully') AS message FROM (SELECT *, {RULES_SQL} AS m FROM ord)",
    ("ord",),
)
def ord1(spark, d):
    return O.validate(T.orders_with_items(spark, d), STRICT).select("order_id", "medicine_id", "is_valid", "message")


@query(
    "ord2_3_purchase_orders",
    f"""SELECT 'PO' || CAST(epoch_us(last_dispensed) // 1000 AS VARCHAR) || '-' || substr(md5(concat_ws('|', medicine_id, q)), 1, 16) AS order_id, medicine_id, q AS quantity,
        unit_price AS unit_cost, round(q * unit_price, 2) AS total_cost, round(1 - current_inventory / reorder_point, 6) AS priority, 'PENDING' AS status,
        {sql_ts("last_dispensed + INTERVAL 7 DAY")} AS expected_delivery_date, CASE WHEN current_inventory < reorder_point * 0.5 THEN 'Supplier_A' ELSE 'Supplier_B' END AS supplier
        FROM (SELECT *, greatest(1, CAST(trunc(reorder_point * 2 - current_inventory) AS BIGINT)) AS q FROM stock WHERE current_inventory < reorder_point)""",
    ("stock",),
)
def ord2(spark, d):
    stock = T.stock_levels(spark, d)
    extra = stock.select("medicine_id", F.col("unit_price").alias("unit_cost"), "last_dispensed")
    recs = I.simple_reorder(stock).join(extra, "medicine_id")
    po = O.purchase_orders(recs, F.col("last_dispensed"))
    return po.select(
        "order_id", "medicine_id", "quantity", "unit_cost", r("total_cost", 2), r("priority", 6), "status",
        ts("expected_delivery_date"), "supplier",
    )


@query(
    "ord3_supplier",
    "SELECT order_id, CASE urgency WHEN 'HIGH' THEN 'Supplier_A' WHEN 'NORMAL' THEN 'Supplier_B' ELSE 'Supplier_C' END AS supplier FROM ord",
    ("ord",),
)
def ord3(spark, d):
    return T.orders_with_items(spark, d).select("order_id", O.select_supplier(F.col("urgency")).alias("supplier"))


@query(
    "ord4_priority_batches",
    """SELECT order_id, medicine_id, quantity, (row_number() OVER (ORDER BY priority DESC, order_id, medicine_id, quantity) - 1) // 100 AS batch FROM ord""",
    ("ord",),
)
def ord4(spark, d):
    o = T.orders_with_items(spark, d).select("order_id", "medicine_id", "quantity", "priority")
    ties = [F.asc("order_id"), F.asc("medicine_id"), F.asc("quantity")]
    return R.priority_batches(o, 100, ties).select("order_id", "medicine_id", "quantity", "batch")


@query(
    "ord5_execution",
    f"""SELECT order_id, medicine_id, m IS NULL AS success, CASE WHEN m IS NULL THEN 'APPROVED' ELSE status END AS status, m AS error,
        CASE WHEN m IS NULL THEN {sql_ts("created_at")} END AS approved_at FROM (SELECT *, {RULES_SQL} AS m FROM ord)""",
    ("ord",),
)
def ord5(spark, d):
    done = O.execute(T.orders_with_items(spark, d), F.col("created_at"), STRICT)
    return done.select("order_id", "medicine_id", "success", "status", "error", ts("approved_at"))


def _requests(spark, d):
    """A request for the first line of every order header; some of those lines do not exist."""
    return T.table(spark, d, "orders").select(F.concat(F.lit("PO-"), F.col("o_orderkey"), F.lit("-1")).alias("order_id"))


@query(
    "ord6_cancellations",
    """SELECT 'PO-' || o_orderkey || '-1' AS order_id, coalesce(status IN ('PENDING', 'APPROVED'), false) AS success,
       CASE WHEN status IS NULL THEN 'Order PO-' || o_orderkey || '-1 not found' WHEN status IN ('PENDING', 'APPROVED') THEN 'Order PO-' || o_orderkey || '-1 cancelled successfully'
            ELSE 'Order PO-' || o_orderkey || '-1 cannot be cancelled (status: ' || status || ')' END AS message
       FROM orders LEFT JOIN ord ON ord.order_id = 'PO-' || o_orderkey || '-1'""",
    ("ord",),
)
def ord6(spark, d):
    return O.cancel(T.orders_with_items(spark, d), _requests(spark, d)).select("order_id", "success", "message")


@query(
    "ord7_tracking",
    """SELECT 'PO-' || o_orderkey || '-1' AS order_id, coalesce(status, 'NOT_FOUND') AS status, medicine_id, quantity
       FROM orders LEFT JOIN ord ON ord.order_id = 'PO-' || o_orderkey || '-1'""",
    ("ord",),
)
def ord7(spark, d):
    return O.track(T.orders_with_items(spark, d), _requests(spark, d))


@query(
    "ord8_order_rows",
    f"""SELECT 'ORD' || CAST(epoch_us(created_at) // 1000 AS VARCHAR) || '-' || substr(md5(order_id), 1, 16) AS order_id, medicine_id, quantity, 'PENDING' AS status,
        round(total_cost, 2) AS total_cost, {sql_ts("created_at + INTERVAL 7 DAY")} AS expected_delivery_date FROM ord""",
    ("ord",),
)
def ord8(spark, d):
    rows = O.order_rows(T.orders_with_items(spark, d), F.col("created_at"))
    return rows.select("order_id", "medicine_id", "quantity", "status", r("total_cost", 2), ts("expected_delivery_date"))


@query(
    "ord9_sync_summary",
    """SELECT count(*) AS total, count(s.medicine_id) AS successful, count(*) - count(s.medicine_id) AS failed FROM med
       LEFT JOIN stock s ON s.medicine_id = med.medicine_id""",
    ("med", "stock"),
)
def ord9(spark, d):
    return O.sync_summary(T.medicines(spark, d), T.stock_levels(spark, d))
