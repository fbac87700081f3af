"""Worked figures for one item, and allocation against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from replenish.operators import inventory as I
from replenish.operators import policy as PO
from replenish.params import Params


def one_item(spark, unc=(2.0, 2.5), inventory=50.0):
    f = [10.0, 12.0, 11.0, 13.0, 10.0, 12.0] * 5
    return spark.createDataFrame(
        [("a", inventory, 10.0, 365, f, list(unc) * 15)],
        "medicine_id string, current_inventory double, unit_cost double, shelf_life_days int, forecast array<double>, uncertainty array<double>",
    )


def test_targets(spark):
    row = I.stock_targets(one_item(spark)).first()
    assert row["safety_stock"] == pytest.approx(9.666441, abs=1e-5)
    assert row["reorder_point"] == pytest.approx(87.666441, abs=1e-5)
    assert row["economic_order_quantity"] == pytest.approx(406.775942, abs=1e-5)
    assert row["optimal_order_quantity"] == pytest.approx(406.775942, abs=1e-5)
    assert row["order_quantity"] == pytest.approx(356.775942, abs=1e-5)


def test_costs_without_uncertainty(spark):
    params = Params().but(shortage_scenarios=20)
    sure = one_item(spark, (0.0, 0.0), 87.0).withColumn("current_inventory", F.lit(50.0))
    row = I.optimize_items(sure, params).first()
    assert row["expected_holding_cost"] == pytest.approx(30508.195620, abs=1e-3)
    assert row["expected_shortage_cost"] == 0.0
    assert row["expected_waste"] == pytest.approx(32.775942, abs=1e-5)
    assert row["total_expected_cost"] == pytest.approx(31163.714452, abs=1e-3)


def test_shortage_is_the_excess_on_the_first_short_day(spark):
    df = one_item(spark, (0.0, 0.0)).withColumn("level", F.lit(40.0))
    cost = df.select(I.shortage_cost("level", Params().but(shortage_scenarios=3)).alias("c")).first()["c"]
    assert cost == pytest.approx(6.0 * 50)  # 10 + 12 + 11 + 13 = 46


def test_capacity_allocation_is_least_cost(spark):
    rng = random.Random(1)
    for _ in range(5):
        rows = [(str(i), rng.randint(0, 40), rng.randint(5, 30), rng.random() < 0.5, rng.randint(0, 5)) for i in range(3)]
        cap = rng.randint(40, 120)
        df = spark.createDataFrame(
            [(k, float(i), float(o), s, float(w)) for k, i, o, s, w in rows],
            "medicine_id string, current_inventory double, optimal_order_quantity double, should_order boolean, waste double",
        )
        got = {r["medicine_id"]: r for r in I.allocate_with_capacity(df, cap).collect()}
        best = None
        for q in itertools.product(*[range(0, o + 1) for _, _, o, _, _ in rows]):
            fits = sum(r[1] + x for r, x in zip(rows, q)) <= cap and all(x >= 10 for r, x in zip(rows, q) if r[3])
            if fits:
                cost = sum(r[4] * x for r, x in zip(rows, q))
                best = cost if best is None else min(best, cost)
        status = got["0"]["status"]
        assert (best is None) == (status == "Infeasible")
        if best is not None:
            assert sum(got[r[0]]["optimized_order_quantity"] * r[4] for r in rows) == pytest.approx(best)


def test_budget_allocation_meets_service_level(spark):
    df = spark.createDataFrame(
        [("a", 50.0, 10.0, 21.5), ("b", 3.0, 15.0, 15.75), ("c", 0.0, 1.0, None)],
        "medicine_id string, current_inventory double, unit_cost double, mean_demand double",
    ).withColumn("max_order_quantity", F.lit(None).cast("double"))
    got = {r["medicine_id"]: r for r in I.allocate_with_budget(df, F.col("mean_demand")).collect()}
    assert got["a"]["order_quantity"] == 0 and got["c"]["order_quantity"] == 0
    assert got["b"]["order_quantity"] == pytest.approx(0.95 * 15.75 - 3)
    assert got["b"]["status"] == "Optimal"
    tight = I.allocate_with_budget(df, F.col("mean_demand"), budget=1.0).first()
    assert tight["status"] == "Infeasible"


def test_policy_equals_long_value_iteration(spark):
    params = Params().but(policy_max_stock=40, policy_max_order=20)
    demands, counts = [4.0, 12.0, 25.0], [3, 2, 1]
    df = spark.createDataFrame([("a", demands, counts)], "medicine_id string, demands array<double>, counts array<bigint>")
    got = {r["stock_level"]: r for r in PO.optimal_policy(df, params).collect()}
    states, actions, total = range(0, 41, 10), range(0, 21, 10), sum(counts)
    value = {s: 0.0 for s in states}
    for _ in range(800):
        new, order = {}, {}
        for s in states:
            options = []
            for a in actions:
                q = 0.0
                for x, n in zip(demands, counts):
                    left = s + a - x
                    near = min(states, key=lambda g: (abs(g - min(max(left, 0), 40)), g))
                    q += n / total * (-0.5 * (s + a) / 2 - (100 if a else 0) - 50 * max(0, -left) + 0.95 * value[near])
                options.append((round(q, 9), -a))
            best = max(options)
            new[s], order[s] = best[0], -best[1]
        value = new
    for s in states:
        assert got[s]["order_quantity"] == order[s]
        assert got[s]["value"] == pytest.approx(value[s], abs=1e-6)
        assert got[s]["converged"] and got[s]["rounds"] < 20


def test_policy_is_applied_to_every_item(spark):
    params = Params().but(policy_max_stock=40, policy_max_order=20)
    df = spark.createDataFrame([("a", [4.0, 12.0, 25.0], [3, 2, 1]), ("b", [30.0], [1])], "medicine_id string, demands array<double>, counts array<bigint>")
    policy = PO.optimal_policy(df, params)
    stock = spark.createDataFrame([("a", 5.0), ("a", 15.1), ("a", 1e6), ("b", -3.0), ("b", 35.0), ("c", 10.0), ("b", None)], "medicine_id string, current_inventory double")
    orders = {(r["medicine_id"], r["stock_level"]): r["order_quantity"] for r in policy.collect()}
    got = sorted(((r["medicine_id"], r["current_inventory"], r["stock_level"], r["order_quantity"]) for r in PO.apply_policy(stock, policy, params).collect()), key=repr)
    levels = {("a", 5.0): 0, ("a", 15.1): 20, ("a", 1e6): 40, ("b", -3.0): 0, ("b", 35.0): 30, ("c", 10.0): 10, ("b", None): None}
    assert got == sorted(((m, s, level, orders.get((m, level))) for (m, s), level in levels.items()), key=repr)
    assert orders["b", 0] == 20 and orders["a", 40] == 0


def test_nearest_level_ties_go_down(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (15.0,), (994.0,), (1e9,)], "x double")
    assert [r[0] for r in df.select(PO.nearest_level(F.col("x"))).collect()] == [0, 0, 1, 1, 99, 100]
