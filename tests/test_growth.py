"""Steps whose memory or disk must not follow what their rows are laid out into."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from replenish.operators import forecast as FC
from replenish.operators import graph as G
from replenish.operators import policy as PO
from replenish.operators import privacy as PV
from replenish.operators import series_state as SS
from replenish.operators import validation as VA
from replenish.params import Params
from replenish.sources import interchange as X

DAY = dt.date(2024, 1, 1)


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_residual_lays_out_no_rows_and_sees_a_wrong_value(spark):
    params = Params().but(policy_max_stock=40, policy_max_order=20)
    df = spark.createDataFrame([("a", [4.0, 12.0, 25.0], [3, 2, 1]), ("b", [30.0], [1]), ("c", [7.5], [2])], "medicine_id string, demands array<double>, counts array<bigint>")
    policy = spark.createDataFrame(PO.optimal_policy(df, params).collect(), PO.optimal_policy(df, params).schema)
    found = PO.bellman_residual(df, policy, params)
    assert "Generate" not in plan(found)
    assert {r["medicine_id"]: r["residual"] for r in found.collect()} == pytest.approx({"a": 0.0, "b": 0.0, "c": 0.0}, abs=1e-6)
    wrong = policy.selectExpr("medicine_id", "stock_level", "value + if(medicine_id = 'b' and stock_level = 40, 3.0, 0.0) as value").filter("medicine_id != 'c'")
    off = {r["medicine_id"]: r["residual"] for r in PO.bellman_residual(df, wrong, params).collect()}
    assert set(off) == {"a", "b"} and off["a"] == pytest.approx(0.0, abs=1e-6) and off["b"] > 1


def test_pairs_of_small_baskets_need_no_join_on_blocks(spark):
    rows = [(1, "a"), (1, "b"), (1, None), (None, "a"), (None, "b"), (2, "c"), (3, "b"), (3, "a"), (3, "d"), *[(4, f"x{k}") for k in range(6)]]
    items = spark.createDataFrame(rows, "basket_id int, medicine_id string")
    found = G.basket_pairs(items, block=4)
    want = {(1, "a", "b"), (3, "a", "b"), (3, "a", "d"), (3, "b", "d")} | {(4, f"x{i}", f"x{j}") for i in range(6) for j in range(i + 1, 6)}
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(want)
    assert "REPARTITION_BY_NUM" in plan(found) and "collect_list" in plan(found)


def test_series_are_not_merged_by_size_before_their_days_are_laid_out(spark):
    daily = spark.createDataFrame([("a", DAY, 2.0), ("b", DAY, 3.0)], "medicine_id string, date date, demand double")
    assert "REPARTITION_BY_NUM" in plan(FC.all_forecasts(FC.component_forecasts(FC.fit_components(FC.series_stats(daily)))))
    assert "REPARTITION_BY_NUM" in plan(SS.advance(SS.no_state(daily), daily)[0])


def test_common_categories_compare_values_not_rows(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "category string")
    b = spark.createDataFrame([("x",), ("z",), ("z",), (None,)], "category string")
    found = PV.common_categories(a, b)
    assert sorted((r[0] for r in found.collect()), key=str) == [None, "x"]
    assert plan(found, "analyzed").count("Distinct") + plan(found, "analyzed").count("Deduplicate") >= 2


def test_messages_are_written_compressed_in_files_that_tasks_can_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "MESSAGES_A_FILE", 300)
    rows = [(f"PO-{k}", 1, f"m{k % 7}", float(k % 5), 2.5, dt.datetime(2024, 1, 1 + k % 28)) for k in range(1000)]
    orders = spark.createDataFrame(rows, "order_id string, line int, medicine_id string, quantity double, unit_cost double, created_at timestamp")
    plain = orders.select(F.sum(F.length(X.edi_850(orders)))).first()[0]
    for number, write in enumerate([X.export_edi, lambda o, p: X.write_messages(X.edi_850_of_lines(o), p)]):
        path = tmp_path / str(number)
        write(orders.coalesce(1), str(path))
        files = [f for f in path.iterdir() if f.name.startswith("part-")]
        assert sum(f.stat().st_size for f in files) < plain / 5
        assert number or len(files) == 4
        assert X.read_edi(spark, str(path)).count() == 1000
        back = X.parse_edi(X.read_edi(spark, str(path))).collect()
        assert sorted(map(tuple, back)) == sorted((r[0], r[3], r[4], r[2]) for r in rows)


@pytest.mark.parametrize("kind", ["sales", "returns", "wide"])
def test_policy_values_solve_the_equations_of_all_states(spark, kind):
    params = Params().but(policy_max_stock=200, policy_max_order=100)
    demands = {"sales": [4.0, 12.0, 25.0, 45.0], "returns": [-30.0, 5.0, 15.0, 45.0], "wide": [1.0, 95.0, 180.0, 1234.5]}[kind]
    rows = [("a", demands, [5, 3, 2, 1]), ("b", demands[1:2], [4]), ("c", demands[:3], [1, 1, 7])]
    df = spark.createDataFrame(rows, "medicine_id string, demands array<double>, counts array<bigint>").coalesce(1)
    found = PO.optimal_policy(df, params).collect()
    assert len(found) == 3 * 21 and all(r["converged"] for r in found)
    for item, d, n in rows:
        got = sorted((r["stock_level"], r["order_quantity"], r["value"]) for r in found if r["medicine_id"] == item)
        at, share = [s + q for s, q, _ in got], [x / sum(n) for x in n]
        move, gain = np.zeros((21, 21)), np.zeros(21)
        for i, level in enumerate(at):
            gain[i] = -params.holding_cost * level / 2 - params.order_cost * (got[i][1] > 0)
            for x, p in zip(d, share):
                gain[i] -= params.shortage_cost * max(x - level, 0) * p
                move[i, max(0, int(np.ceil(min(max(level - x, 0), 200) / 10 - 0.5)))] += p
        want = np.linalg.solve(np.eye(21) - params.policy_discount * move, gain)
        assert [v for _, _, v in got] == pytest.approx(list(want), abs=1e-6)
    residual = PO.bellman_residual(df, PO.optimal_policy(df, params), params).collect()
    assert all(r["residual"] < 1e-6 for r in residual)


def test_without_returns_no_equations_of_all_states_are_solved(spark, monkeypatch):
    params = Params().but(policy_max_stock=400, policy_max_order=100)
    solved = []
    solve = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: solved.append(a.shape[-1]) or solve(a, b))

    class Rows:
        schema = spark.createDataFrame([], "medicine_id int, demands array<double>, counts array<bigint>").schema

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return pd.concat(run(iter([pd.DataFrame({"medicine_id": [1], "demands": [[4.0, 12.0]], "counts": [[3, 1]]})])))

    monkeypatch.setattr(PO, "spread_by_item", lambda rows: rows)
    out = PO.optimal_policy(Rows(), params)
    assert len(out) == 41 and out["converged"].all() and out["order_quantity"].max() > 0
    assert max(solved, default=0) < 41


def test_held_out_errors_shuffle_days_and_sums_but_no_forecasts(spark):
    rng = np.random.default_rng(5)
    rows = [(k, DAY + dt.timedelta(days=int(t)), float(rng.integers(1, 9))) for k in (1, 2, 3) for t in sorted({0, 99, *rng.integers(1, 99, 40)})]
    # beside the cut on day 79: no demand, a day that comes twice
    odd = [(None, DAY, 1.0), (1, None, 4.0), (4, DAY, 5.0), (5, DAY, 2.0), (5, DAY + dt.timedelta(days=9), 3.0), (1, DAY + dt.timedelta(days=81), None), (2, DAY + dt.timedelta(days=99), 7.0)]
    daily = spark.createDataFrame(rows + odd, "medicine_id bigint, date date, demand double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        validated = VA.validate(daily)
        shuffles = [line for line in plan(validated).splitlines() if "Exchange " in line]
        got = {(r["medicine_id"], r["model"]): r for r in validated.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffles and not [line for line in shuffles if "forecast_date" in line]
    assert plan(validated).split("Initial Plan")[-1].count("ArrowEvalPython ") == 2
    assert {k for k, _ in got} == {1, 2, 3, 5} and {m for k, m in got if k == 1} >= {"mean", "ar", "trend", "additive", "ensemble", "autoregression", "smoothing", "change_points", "historical_baseline"}
    for key in (1, 2, 3, 5):
        sold = [((d - DAY).days, y) for k, d, y in rows + odd if k == key and d]
        cut = int((max(t for t, _ in sold) + 1) * 0.8)
        mean = sum(y or 0.0 for t, y in sold if t < cut) / cut
        misses = [mean - (y or 0.0) for day in range(cut, min(cut + 30, max(t for t, _ in sold) + 1)) for y in ([y for t, y in sold if t == day] or [0.0])]
        found = got[key, "mean"]
        assert found["days"] == len(misses) and found["bias"] == pytest.approx(np.mean(misses)) and found["mae"] == pytest.approx(np.mean(np.abs(misses)))
        assert found["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(misses))))
