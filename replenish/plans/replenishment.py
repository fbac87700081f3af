"""From raw history to order recommendations: the library's main plan.

Shuffles: history to (item, day) sums, those to one row per item, one to spread
the items over all cores, and the final sort by priority. The per-item results
are written once, so the totals over all items do not repeat the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.operators import alerts as AL
from replenish.operators import forecast as FC
from replenish.operators import inventory as I
from replenish.operators import joins as J
from replenish.operators.aggregates import daily_demand
from replenish.operators.joins import with_forecast
from replenish.operators.ranking import by_priority
from replenish.params import Params
from replenish.session import stored


def items_with_baseline(rx: DataFrame, stock: DataFrame, params: Params = Params()) -> DataFrame:
    """Items with stock, cost, shelf life and their baseline forecast arrays."""
    vectors = FC.baseline_vectors(FC.demand_stats(daily_demand(rx)), params)
    items = stock.select(
        "medicine_id", "medicine_name", "current_inventory", F.col("unit_price").alias("unit_cost"), "shelf_life_days"
    )
    return with_forecast(items, vectors)


def items_with_best_forecast(rx: DataFrame, stock: DataFrame, params: Params = Params()) -> DataFrame:
    """The same with the best available model; an interval's width is turned into a deviation."""
    stats = FC.series_stats(daily_demand(rx))
    best = FC.best_forecast(FC.component_forecasts(FC.fit_components(stats, params), params), params)
    sd = F.when(F.col("model") == "ensemble", F.col("uncertainty") / F.lit(2 * params.z)).otherwise(F.col("uncertainty"))
    vectors = FC.forecast_vectors(best.withColumn("uncertainty", sd))
    items = stock.select(
        "medicine_id", "medicine_name", "current_inventory", F.col("unit_price").alias("unit_cost"), "shelf_life_days"
    )
    return with_forecast(items, vectors)


def recommendations(items: DataFrame, capacity=None, params: Params = Params()) -> DataFrame:
    """Sorted order recommendations. The per-item results are stored once: totals and rows both read them."""
    results = stored(I.optimize_items(items, params), "optimization-results")
    return by_priority(I.recommend(I.allocate_with_capacity(results, capacity, params), params))


def place_orders(stock: DataFrame, recommendations: DataFrame, placed: DataFrame, when: Column) -> DataFrame:
    """What placing orders does, as rows (effect, medicine_id, quantity, message).

    ``stock`` gives each item's stock with what is ordered, ``open`` the recommendations that are left, and
    ``alert`` one message per order.
    """
    after = I.stock_after_orders(stock, placed)
    left = J.without_ordered(recommendations, placed)
    alerts = AL.order_placed(placed, when)
    none = F.lit(None).cast("string")
    return (
        after.select(F.lit("stock").alias("effect"), "medicine_id", F.col("current_inventory").cast("double").alias("quantity"), none.alias("message"))
        .unionByName(left.select(F.lit("open").alias("effect"), "medicine_id", F.col("order_quantity").cast("double").alias("quantity"), none.alias("message")))
        .unionByName(alerts.select(F.lit("alert").alias("effect"), "medicine_id", F.lit(None).cast("double").alias("quantity"), "message"))
    )
