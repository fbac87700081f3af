"""Replenishment decisions, row-local after one row per item exists.

Inputs carry ``medicine_id, current_inventory, unit_cost, shelf_life_days`` and the
arrays ``forecast`` and ``uncertainty`` (a standard deviation per day ahead).
Totals over all items (capacity, budget) are one-row scalar subqueries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import draws
from replenish.functions import scalars as S
from replenish.operators.joins import spread_by_item
from replenish.params import Params


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def _head(name: str, n: int) -> Column:
    return F.slice(name, 1, n)


def stock_targets(items: DataFrame, params: Params = Params()) -> DataFrame:
    """Safety stock, reorder point, economic and optimal order quantity, and the order decision."""
    lead = params.lead_time
    unc = _head("uncertainty", lead)
    safety = S.service_z(params.service_level) * (_sum(unc) / F.size(unc)) * F.sqrt(F.lit(float(lead)))
    annual = _sum(F.col("forecast")) * (F.lit(365.0) / F.size("forecast"))
    holding = F.lit(params.holding_cost) * F.col("unit_cost")
    out = (
        items.withColumn("safety_stock", S.at_least_zero(safety))
        .withColumn("reorder_point", _sum(_head("forecast", lead)) + F.col("safety_stock"))
        .withColumn("annual_demand", annual)
    )
    eoq = F.when(
        (F.col("annual_demand") > 0) & (holding > 0),
        F.sqrt(F.lit(2.0) * F.col("annual_demand") * F.lit(params.order_cost) / holding),
    ).otherwise(0.0)
    by_shelf = F.col("annual_demand") / 365 * F.col("shelf_life_days") * F.lit(0.8)
    out = (
        out.withColumn("economic_order_quantity", eoq)
        .withColumn(
            "optimal_order_quantity",
            F.least(F.col("economic_order_quantity"), by_shelf, F.lit(params.max_order_qty)),
        )
        .withColumn("should_order", F.col("current_inventory") < F.col("reorder_point"))
    )
    quantity = F.greatest(F.col("optimal_order_quantity") - F.col("current_inventory"), F.lit(params.min_order_qty))
    return out.withColumn("order_quantity", F.when(F.col("should_order"), quantity).otherwise(0.0))


ITEMS_AT_ONCE = 8


def scenario_noise(scenarios: int, days: int, seed: int) -> np.ndarray:
    """Standard normal draws per (scenario, day), shared by all items; its size depends on the parameters only."""
    label = f"short{seed}"
    return np.array([[draws.normal_value(label, s, d) for d in range(days)] for s in range(scenarios)])


def shortage_cost(level: str, params: Params = Params()) -> Column:
    """Expected shortage cost of a stock level.

    In each scenario demand is normal per day and floored at zero; the shortage is the
    excess of cumulative demand over stock on the first day it is exceeded within
    ``shortage_days``. Scenarios share their noise across items (common random
    numbers), so a task multiplies vectors instead of hashing per item, scenario and day.
    """
    noise = scenario_noise(params.shortage_scenarios, params.shortage_days, params.seed)
    cost = params.shortage_cost

    @F.pandas_udf("double")
    def expected(level: pd.Series, forecast: pd.Series, uncertainty: pd.Series) -> pd.Series:
        days = noise.shape[1]
        mean, spread = np.zeros((2, len(level), days))
        # days beyond a forecast have no demand, so nothing is first exceeded on them
        for i, (f, u) in enumerate(zip(forecast, uncertainty)):
            n = min(len(f), days)
            mean[i, :n], spread[i, :n] = f[:n], u[:n]
        stock, out = level.to_numpy(float), np.zeros(len(level))
        for at in range(0, len(level), ITEMS_AT_ONCE):
            some = slice(at, at + ITEMS_AT_ONCE)
            excess = spread[some, None] * noise
            excess += mean[some, None]
            np.maximum(excess, 0.0, out=excess)
            np.cumsum(excess, axis=2, out=excess)
            excess -= stock[some, None, None]
            first = (excess <= 0).sum(axis=2)
            hit = first < days
            reached = np.take_along_axis(excess, np.minimum(first, days - 1)[:, :, None], axis=2)[:, :, 0]
            out[some] = np.where(hit, reached, 0.0).sum(axis=1) / len(noise) * cost
        return pd.Series(out)

    return expected(F.col(level), F.col("forecast"), F.col("uncertainty"))


def expected_waste(level: Column, shelf_life: Column) -> Column:
    """Stock beyond 1.1 times the demand forecast within the shelf life."""
    days = F.least(shelf_life, F.size("forecast"))
    return S.at_least_zero(level - F.lit(1.1) * _sum(F.slice(F.col("forecast"), F.lit(1), days)))


def holding_cost(level: Column, params: Params = Params()) -> Column:
    return level / 2 * F.lit(params.holding_cost) * F.col("unit_cost") * 30


def optimize_items(items: DataFrame, params: Params = Params()) -> DataFrame:
    """The full per-item record with its expected costs."""
    level = F.col("current_inventory") + F.col("order_quantity")
    out = (
        stock_targets(spread_by_item(items), params)
        .withColumn("_level", level)
        .withColumn("expected_holding_cost", holding_cost(F.col("_level"), params))
        .withColumn("expected_waste", expected_waste(F.col("_level"), F.col("shelf_life_days")))
        .withColumn("expected_shortage_cost", shortage_cost("_level", params))
        .drop("_level")
    )
    total = (
        F.col("expected_holding_cost")
        + F.col("expected_shortage_cost")
        + F.col("expected_waste") * F.col("unit_cost") * F.lit(params.waste_multiplier)
    )
    return out.withColumn("total_expected_cost", total).withColumn("service_level", F.lit(params.service_level))


def allocate_with_capacity(results: DataFrame, capacity: float | Column | None = None, params: Params = Params()) -> DataFrame:
    """Least-cost order quantities under a storage capacity, each with status, reason and shortfall.

    Cost rises with every quantity and capacity only limits the sum from above, so each
    ordering item takes the minimum order and the others nothing. An item whose optimal quantity is below the
    minimum order can't have one: it alone is infeasible and orders nothing. If the capacity can't hold
    the rest, every row says by how much it is short.
    """
    cap = params.storage_capacity if capacity is None else capacity
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    tight = F.col("should_order") & (F.col("optimal_order_quantity") < params.min_order_qty)
    low = F.when(F.col("should_order") & ~tight, F.lit(params.min_order_qty)).otherwise(0.0)
    out = results.withColumn("optimized_order_quantity", low)
    used = out.agg(F.sum(F.col("current_inventory") + F.col("optimized_order_quantity"))).scalar()
    short = F.greatest(F.lit(0.0), used - cap)
    return (
        out.withColumn("capacity_shortfall", short)
        .withColumn("status", F.when((short > 0) | tight, "Infeasible").otherwise("Optimal"))
        .withColumn("reason", F.when(short > 0, "capacity is short").when(tight, "optimal quantity below the minimum order"))
    )


def allocate_with_budget(
    items: DataFrame,
    mean_demand: Column,
    capacity: float | Column | None = None,
    budget: float | Column | None = None,
    params: Params = Params(),
) -> DataFrame:
    """Least-cost order quantities that reach 95 % of mean demand under capacity and budget, each with status and reason.

    Holding and fixed cost rise with the quantity, so the service level binds: an item
    orders what is missing to 95 % of its mean demand. Items without a forecast order nothing. An item that would have to
    order more than its maximum can't reach its level: it alone is infeasible and orders nothing. If capacity or
    budget can't hold the rest, every row says so.
    """
    cap = params.storage_capacity if capacity is None else capacity
    money = params.budget if budget is None else budget
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    money = money if isinstance(money, Column) else F.lit(float(money))
    need = F.coalesce(S.at_least_zero(F.lit(0.95) * mean_demand - F.col("current_inventory")), F.lit(0.0))
    most = F.least(F.coalesce(F.col("max_order_quantity"), F.lit(1000.0)), F.lit(10000.0))
    out = (
        items.withColumn("_tight", need > most)
        .withColumn("order_quantity", F.when(F.col("_tight"), 0.0).otherwise(need))
        .withColumn("total_cost", F.col("order_quantity") * F.col("unit_cost"))
    )
    totals = out.agg(
        F.struct(F.sum(F.col("current_inventory") + F.col("order_quantity")).alias("used"), F.sum("total_cost").alias("spent"))
    ).scalar()
    full, dear, tight = totals["used"] > cap, totals["spent"] > money, F.col("_tight")
    reason = (
        F.when(full, "capacity is short").when(dear, "budget is short").when(tight, "needs more than its maximum order")
    )
    status = F.when(full | dear | tight, "Infeasible").otherwise("Optimal")
    return out.withColumn("status", status).withColumn("reason", reason).drop("_tight")


def supply_priority(days: Column) -> Column:
    return F.when(days < 7, 1.0).when(days < 14, 0.7).when(days < 30, 0.4).otherwise(0.1)


def priority_score(params: Params = Params()) -> Column:
    risk = F.lit(1.0) - F.col("current_inventory") / F.greatest(F.col("reorder_point"), F.lit(1.0))
    benefit = F.lit(1.0) / (F.lit(1.0) + F.col("total_expected_cost"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk * 0.6 + benefit * 0.4))


def cost_savings() -> Column:
    baseline = F.col("expected_shortage_cost") * 2 + F.col("expected_waste") * 1.5
    return S.at_least_zero(baseline - F.col("total_expected_cost"))


def rationale() -> Column:
    return S.joined_reasons(
        (F.col("current_inventory") < F.col("safety_stock"), "Inventory below safety stock"),
        (F.col("current_inventory") < F.col("reorder_point"), "Below reorder point"),
        (F.col("expected_shortage_cost") > 100, "High shortage risk"),
        default="Optimal replenishment cycle",
    )


def recommend(allocated: DataFrame, params: Params = Params()) -> DataFrame:
    """Items to order, with priority, savings, urgency and reasons (unsorted; see ``by_priority``)."""
    return allocated.filter((F.col("optimized_order_quantity") > 0) & (F.col("status") == "Optimal")).select(
        "medicine_id",
        F.col("optimized_order_quantity").alias("order_quantity"),
        "unit_cost",
        priority_score(params).alias("priority"),
        cost_savings().alias("expected_cost_savings"),
        F.when(F.col("current_inventory") < F.col("safety_stock"), "HIGH").otherwise("NORMAL").alias("urgency"),
        rationale().alias("rationale"),
    )


def simple_reorder(stock: DataFrame) -> DataFrame:
    """Refill items below their reorder point to twice that point."""
    inv, rop = F.col("current_inventory"), F.col("reorder_point")
    return stock.filter(inv < rop).select(
        "medicine_id",
        "medicine_name",
        F.greatest(F.lit(1), (rop * 2 - inv).cast("bigint")).alias("order_quantity"),
        F.when(rop > 0, F.lit(1.0) - F.try_divide(inv, rop)).otherwise(1.0).alias("priority"),
        F.when(inv < rop * 0.5, "HIGH").otherwise("NORMAL").alias("urgency"),
        inv.alias("current_inventory"),
        rop.alias("reorder_point"),
    )


def stock_after_orders(stock: DataFrame, placed: DataFrame) -> DataFrame:
    """Stock plus what has been ordered per item (orders are summed before the join)."""
    added = placed.groupBy("medicine_id").agg(F.sum("quantity").alias("_added"))
    return (
        stock.join(added, "medicine_id", "left")
        .withColumn("current_inventory", F.col("current_inventory") + F.coalesce("_added", F.lit(0.0)))
        .drop("_added")
    )


def adjust_stock(stock: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Manual adjustments ``(medicine_id, adjustment)``: the new stock and the transaction total per item."""
    total = adjustments.groupBy("medicine_id").agg(
        F.sum("adjustment").alias("adjustment"), F.count("*").alias("transactions")
    )
    return stock.join(total, "medicine_id").select(
        "medicine_id",
        F.col("current_inventory").alias("inventory_before"),
        "adjustment",
        "transactions",
        (F.col("current_inventory") + F.col("adjustment")).alias("inventory_after"),
    )
