"""Autoregression, smoothing and held-out errors against plain versions."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.operators import autoregression as AR
from replenish.operators import forecast as FC
from replenish.operators import smoothing as SM
from replenish.operators import validation as VA
from replenish.params import Params

DAY = dt.date(2024, 1, 1)


def daily(spark, series):
    """Selling days of zero-filled series."""
    rows = [(k, DAY + dt.timedelta(days=t), float(y)) for k, s in series.items() for t, y in enumerate(s) if y or t in (0, len(s) - 1)]
    return spark.createDataFrame(rows, "medicine_id string, date date, demand double").repartition(3)


def some_series():
    rng = random.Random(3)
    wave = [10 + 5 * (t % 7 == 2) + 0.05 * t + rng.random() for t in range(120)]
    sparse = [rng.choice([0, 0, 0, 4.0, 9.0]) for _ in range(90)]
    return {"wave": wave, "sparse": [1.0, *sparse, 2.0], "short": [1.0, 2.0, 0, 3.0], "one": [5.0], "even": [2.0] * 80}


@pytest.mark.parametrize("order", [1, 3, 14])
def test_lag_products_and_normal_equations(spark, order):
    series = some_series()
    rows = AR.fit_autoregression(AR.lag_sums(daily(spark, series), order), order).collect()
    assert {r["medicine_id"] for r in rows} == set(series)
    for r in rows:
        y = np.array(series[r["medicine_id"]], float)
        c, n = y - y.mean(), len(y)
        cov = [float(c[k:] @ c[: n - k]) / n if k < n else 0.0 for k in range(order + 1)]
        assert r["n"] == n and r["cov"] == pytest.approx(cov, abs=1e-8)
        assert r["recent"] == [y[n - 1 - k] if k < n else 0.0 for k in range(order)]
        if cov[0] > 1e-6:
            toeplitz = np.array([[cov[abs(i - j)] for j in range(order)] for i in range(order)])
            assert toeplitz @ np.array(r["weights"]) == pytest.approx(np.array(cov[1:]), abs=1e-6 * cov[0])
            assert r["rest"] == pytest.approx(cov[0] - float(np.array(cov[1:]) @ np.array(r["weights"])), abs=1e-6 * cov[0])


def test_recursive_forecast(spark):
    series = some_series()
    order, params = 5, Params().but(horizon=12)
    fits = {r["medicine_id"]: r for r in AR.fit_autoregression(AR.lag_sums(daily(spark, series), order), order).collect()}
    got = {}
    for r in AR.autoregressive_forecast(daily(spark, series), params, order).collect():
        got.setdefault(r["medicine_id"], {})[r["h"]] = r
    # too short, too even: no forecast
    assert set(got) == {"wave", "sparse"}
    for key, rows in got.items():
        fit, y = fits[key], series[key]
        past, psi, spread = [v - fit["mean"] for v in y], [1.0], 1.0
        for h in range(12):
            past.append(sum(w * past[-1 - i] for i, w in enumerate(fit["weights"])))
            value, width = fit["mean"] + past[-1], (fit["rest"] * spread) ** 0.5
            assert rows[h]["forecast"] == pytest.approx(max(0.0, value)) and rows[h]["uncertainty"] == pytest.approx(width)
            assert rows[h]["lower"] == pytest.approx(max(0.0, value - params.z * width)) and rows[h]["upper"] == pytest.approx(value + params.z * width)
            assert rows[h]["forecast_date"] == DAY + dt.timedelta(days=len(y) + h)
            psi.append(sum(w * psi[-1 - i] for i, w in enumerate(fit["weights"]) if i < len(psi)))
            spread += psi[-1] ** 2


def plain_smoothing(y, steps):
    best = None
    for alpha, beta, gamma, phi in SM.GRID.tolist():
        level, trend, season, error = sum(y[:7]) / len(y[:7]), 0.0, [0.0] * 7, 0.0
        for t, v in enumerate(y):
            expected = level + phi * trend
            miss = v - expected - season[t % 7]
            if t >= 7:
                error += miss * miss
            level, trend = expected + alpha * miss, phi * trend + alpha * beta * miss
            season[t % 7] += gamma * (1 - alpha) * miss
        if best is None or error < best[0]:
            ahead = [level + sum(phi**i for i in range(1, h + 2)) * trend + season[(len(y) + h) % 7] for h in range(steps)]
            best = error, ahead
    return best[1], (best[0] / max(len(y) - 7, 1)) ** 0.5


def test_smoothing_equals_plain_recursion(spark):
    series = some_series()
    got = {}
    for r in SM.smoothed_forecast(daily(spark, series), Params().but(horizon=10)).collect():
        got.setdefault(r["medicine_id"], {})[r["h"]] = r
    assert set(got) == {"wave", "sparse", "even"}
    for key, rows in got.items():
        ahead, error = plain_smoothing(series[key], 10)
        assert [rows[h]["forecast"] for h in range(10)] == pytest.approx([max(0.0, v) for v in ahead])
        assert rows[0]["uncertainty"] == pytest.approx(error, abs=1e-9)


def test_smoothing_costs_selling_days_not_calendar_days():
    days, demand = np.array([0, 3, 9, 1200, 1201, 1999]), np.array([4.0, 7.0, 2.0, 30.0, 1.0, 5.0])
    y = np.zeros(2000)
    y[days] = demand
    far = np.array([0, 5, 2_900_000])
    start = time.process_time()
    ahead, error = SM.smooth([(days, demand), (far, np.array([3.0, 9.0, 6.0]))], np.array([2000, 2_900_001]), 10)
    # going through the calendar day by day takes minutes
    assert time.process_time() - start < 20
    expected, spread = plain_smoothing(y.tolist(), 10)
    assert ahead[0] == pytest.approx(np.array(expected)) and error[0] == pytest.approx(spread)
    assert np.isfinite(ahead).all() and 0 < error[1] < 1


def test_held_out_errors(spark):
    series = some_series()
    table = daily(spark, series)
    got = {(r["medicine_id"], r["model"]): r for r in VA.validate(table).collect()}
    assert {k for k, _ in got} == {"wave", "sparse", "short", "even"}
    for key in ("wave", "sparse", "short"):
        y = series[key]
        cut = int(len(y) * 0.8)
        rest = y[cut : cut + 30]
        r, mean = got[key, "mean"], sum(y[:cut]) / cut
        assert r["days"] == len(rest) and r["mae"] == pytest.approx(sum(abs(mean - v) for v in rest) / len(rest))
        assert r["rmse"] == pytest.approx((sum((mean - v) ** 2 for v in rest) / len(rest)) ** 0.5) and r["bias"] == pytest.approx(sum(mean - v for v in rest) / len(rest))
        assert sum(got[k]["best"] for k in got if k[0] == key) == 1
    # a weekly season: smoothing sees it, a mean day and two weeks of lags come after
    wave = {m: got["wave", m]["rmse"] for k, m in got if k == "wave"}
    assert wave["smoothing"] < 0.7 * wave["mean"] and wave["autoregression"] < wave["mean"]
    report = {r["model"]: r for r in VA.validation_report(VA.validate(table)).collect()}
    assert report["mean"]["items"] == 4 and sum(r["best_for"] for r in report.values()) == 4
    assert VA.validate(table.filter("false")).count() == 0


def test_smoothing_beats_a_straight_line_on_seasonal_items(spark):
    rng = random.Random(8)
    series = {f"i{k}": [max(0.0, 20 + 8 * ((t + k) % 7 < 2) + 3 * np.sin(t / 25 + k) + rng.gauss(0, 1)) for t in range(200)] for k in range(12)}
    table = daily(spark, series)
    report = {r["model"]: r["rmse"] for r in VA.validation_report(VA.validate(table)).collect()}
    train, spans = VA.held_out(table)
    line = FC.fit_components(FC.series_stats(train)).select("medicine_id", "last_day", "n", "slope", "intercept", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("h"))
    line = line.select("medicine_id", F.lit("line").alias("model"), F.date_add("last_day", F.col("h") + 1).alias("forecast_date"), (F.col("intercept") + F.col("slope") * (F.col("n") + F.col("h"))).alias("forecast"))
    straight = VA.errors(line, table, spans).agg(F.sqrt(F.sum(F.col("rmse") ** 2 * F.col("days")) / F.sum("days"))).first()[0]
    assert report["smoothing"] < 0.6 * straight


@pytest.mark.parametrize("cuts", [(3,), (1, 2, 40), (60, 61, 62, 63), tuple(range(1, 100, 9))])
def test_merged_sums_equal_a_whole_scan(spark, cuts):
    from replenish.operators import series_state as SS

    series = some_series()
    table = daily(spark, series).withColumn("t", F.datediff("date", F.lit(DAY)))
    # the newest day of each delivery comes in two parts
    state, bounds = SS.no_state(table), [0, *cuts, 1000]
    for low, high in zip(bounds, bounds[1:]):
        some = table.filter(F.col("t").between(low, high)).withColumn("demand", F.when(F.col("t").isin(low, high) & (F.col("t") > 0) & (F.col("t") < 999), F.col("demand") / 2).otherwise(F.col("demand")))
        merged, late = SS.advance(state, some)
        assert late.count() == 0
        state = spark.createDataFrame(merged.drop("changed").collect(), state.schema)
    got = {r["medicine_id"]: r.asDict() for r in SS.stats_of(state).collect()}
    want = {r["medicine_id"]: r.asDict() for r in FC.series_stats(table).collect()}
    assert set(got) == set(want)
    for k in want:
        for name, value in want[k].items():
            if name == "selling_days" and k in got:
                assert got[k][name] == value
            elif isinstance(value, (int, float)):
                assert got[k][name] == pytest.approx(value, abs=1e-6), (k, name)
            elif isinstance(value, list):
                assert got[k][name] == pytest.approx(value, abs=1e-6), (k, name)
            else:
                assert got[k][name] == value, (k, name)


def test_late_days_and_unchanged_items(spark):
    from replenish.operators import series_state as SS

    first, _ = SS.advance(SS.no_state(daily(spark, {"a": [1.0]})), daily(spark, {"a": [1.0, 0, 4.0], "b": [2.0, 2.0]}))
    state = spark.createDataFrame(first.drop("changed").collect(), first.drop("changed").schema)
    more = spark.createDataFrame([("a", DAY + dt.timedelta(days=1), 9.0), ("a", DAY + dt.timedelta(days=2), 1.0), ("c", DAY, 3.0), (None, DAY, 1.0)], "medicine_id string, date date, demand double")
    merged, late = SS.advance(state, more)
    assert [tuple(r) for r in late.collect()] == [("a", DAY + dt.timedelta(days=1), 9.0)]
    got = {r["medicine_id"]: (r["open_value"], r["changed"]) for r in merged.collect()}
    assert got == {"a": (5.0, True), "b": (2.0, False), "c": (3.0, True), None: (1.0, True)}


def test_change_points_equal_a_plain_ridge_fit(spark):
    from replenish.operators import additive as AD

    rng = random.Random(6)
    bend = [5 + 0.1 * min(t, 300) - 0.04 * max(0, t - 300) + 3 * (t % 7 == 1) + 2 * np.sin(2 * np.pi * t / 365.25) + rng.random() for t in range(700)]
    series = {"bend": bend, **some_series()}
    table = daily(spark, series)
    got = {}
    for r in AD.change_point_forecast(table, Params().but(horizon=9)).collect():
        got.setdefault(r["medicine_id"], {})[r["h"]] = r
    # "even" sells every day alike, "short" and "one" are too short
    assert set(got) == {"bend", "wave", "sparse", "even"}
    design = AD.design_of(table)
    assert design.days == 700
    for key, rows in got.items():
        y = np.array(series[key], float)
        x = design.matrix(np.arange(len(y)))
        used = np.ones(x.shape[1], bool) if len(y) >= 365 else ~design.yearly
        weights = np.linalg.solve(x[:, used].T @ x[:, used] + np.diag(design.costs[used]), x[:, used].T @ y)
        ahead = design.matrix(len(y) + np.arange(9))[:, used] @ weights
        width = np.sqrt(((y - x[:, used] @ weights) ** 2).sum() / (len(y) - 1))
        assert [rows[h]["forecast"] for h in range(9)] == pytest.approx(np.maximum(ahead, 0.0), abs=1e-5)
        assert rows[0]["uncertainty"] == pytest.approx(width, abs=1e-4)
    # the turn and the week are followed: a straight line is far off
    later = [5 + 30 - 0.04 * (t - 300) + 3 * (t % 7 == 1) + 2 * np.sin(2 * np.pi * t / 365.25) + 0.5 for t in range(700, 709)]
    line = np.polyval(np.polyfit(np.arange(700), bend, 1), np.arange(700, 709))
    error = lambda f: float(np.sqrt(np.mean((np.array(f) - later) ** 2)))
    assert error([got["bend"][h]["forecast"] for h in range(9)]) < 0.5 * error(line)
