"""Quantile regression against every line through two points, and its interval on held-out days."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from replenish.operators import quantiles as QR
from replenish.params import Params

DAY = dt.date(2024, 1, 1)


def loss(x, y, beta, tau):
    left = y - x @ beta
    return float(np.maximum(tau * left, (tau - 1) * left).sum())


@pytest.mark.parametrize("tau", [0.025, 0.3, 0.5, 0.975])
@pytest.mark.parametrize("kind", ["normal", "few values", "mostly zero"])
def test_least_loss_equals_the_best_of_all_lines(kind, tau):
    rng = np.random.default_rng(5)
    n = 24
    x = np.stack([np.ones(n), np.arange(n) / n], axis=1)
    make = {
        "normal": lambda: 40 + 5 * rng.normal(size=(4, n)), "few values": lambda: rng.choice([1.0, 2, 5], size=(4, n)),
        "mostly zero": lambda: rng.choice([0, 0, 0, 0, 700.0], size=(4, n)),
    }
    y, used = make[kind](), np.ones((4, n), bool)
    used[1, :9], used[2, 17:] = False, False
    found = QR.fit_quantile(x, y, used, np.zeros((4, 2), bool), tau)
    for i in range(4):
        xi, yi = x[used[i]], y[i][used[i]]
        # some line through two days has the least loss
        best = min(loss(xi, yi, np.linalg.solve(xi[list(pair)], yi[list(pair)]), tau) for pair in itertools.combinations(range(len(xi)), 2))
        assert loss(xi, yi, found[i], tau) == pytest.approx(best, abs=1e-5 * (1 + np.abs(yi).max()))
    # without the slope: a plain quantile
    flat = QR.fit_quantile(x, y, used, np.array([[False, True]] * 4), tau)
    assert (flat[:, 1] == 0).all()
    for i in range(4):
        yi = y[i][used[i]]
        best = min(loss(np.ones((len(yi), 1)), yi, np.array([v]), tau) for v in yi)
        assert loss(np.ones((len(yi), 1)), yi, flat[i, :1], tau) == pytest.approx(best, abs=1e-5 * (1 + np.abs(yi).max()))


def test_shares_below_and_odd_items():
    rng = np.random.default_rng(2)
    x = QR.features(19000 + np.arange(800))
    y = 50 + 10 * rng.random((70, 800)) + 8 * (np.arange(800) % 7 == 3)
    y[0], y[1] = 0.0, 7.0
    used = np.ones(y.shape, bool)
    used[2] = False
    for tau in (0.025, 0.5, 0.975):
        line = QR.fit_quantile(x, y, used, np.zeros((70, x.shape[1]), bool), tau) @ x.T
        assert line[0] == pytest.approx(0.0, abs=1e-6) and line[1] == pytest.approx(7.0, abs=1e-5) and (line[2] == 0).all()
        # at most that share lies below, and at most the rest above: a constant is among the features
        assert ((y - line)[3:] < -1e-4).mean(axis=1).max() <= tau + 1e-9
        assert ((y - line)[3:] > 1e-4).mean(axis=1).max() <= 1 - tau + 1e-9


def daily(spark, series):
    rows = [(k, DAY + dt.timedelta(days=t), float(y)) for k, s in series.items() for t, y in enumerate(s) if y or t in (0, len(s) - 1)]
    return spark.createDataFrame(rows, "medicine_id string, date date, demand double").repartition(3)


def test_interval_follows_spread_and_covers_held_out_days(spark):
    rng = random.Random(4)
    # the spread is five times as wide on two days of the week, so one width for all days is wrong
    series = {f"i{k:03d}": [max(0.0, 60 + rng.gauss(0, 10 if t % 7 < 2 else 2)) for t in range(500)] for k in range(70)}
    series |= {"short": [1.0] * 5, "sparse": [3.0, *[0] * 60, 2.0], "one": [4.0]}
    table = daily(spark, series)
    table = table.union(spark.createDataFrame([("sparse", None, 5.0), ("sparse", DAY, None)], table.schema))
    rows = QR.quantile_regression_interval(table, params=Params().but(horizon=14)).collect()
    got = {(r["medicine_id"], r["h"]): r for r in rows}
    assert {k for k, _ in got} == set(series) - {"short", "one"} and len(rows) == 14 * 71
    assert all(0 <= r["lower"] <= r["upper"] for r in rows)
    first = got["i000", 0]
    assert (first["forecast_date"], first["days"]) == (DAY + dt.timedelta(days=500), 500)
    wide = np.mean([r["upper"] - r["lower"] for r in rows if r["medicine_id"][0] == "i" and (500 + r["h"]) % 7 < 2])
    narrow = np.mean([r["upper"] - r["lower"] for r in rows if r["medicine_id"][0] == "i" and (500 + r["h"]) % 7 >= 2])
    assert wide > 3 * narrow
    report = {r["medicine_id"]: r for r in QR.coverage(table.filter("date is not null and demand is not null")).collect()}
    assert set(report) == {k for k in series if k not in ("short", "one")}
    days, inside = (sum(r[c] for k, r in report.items() if k[0] == "i") for c in ("days", "inside"))
    assert days == 70 * 30 and 0.88 < inside / days < 0.98
    assert QR.quantile_regression_interval(table.filter("false")).count() == QR.coverage(table.filter("false")).count() == 0


def test_days_without_demand_are_looked_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    n, items = 2000, 12
    x = QR.features(9000 + np.arange(n))
    y = np.where(rng.random((items, n)) < np.linspace(0.004, 0.06, items)[:, None], rng.integers(1, 50, (items, n)), 0).astype(float)
    used, left_out = np.ones(y.shape, bool), np.zeros((items, x.shape[1]), bool)
    used[1, :300], used[2, 1900:], used[3, 200:], left_out[4, -2:] = False, False, False, True
    # few sales a day: zero is the only best line, without a search
    assert (QR.fit_quantile(x, y, used, left_out, 0.025) == 0).all()
    assert (QR.fit_quantile(x, y, used, left_out, 0.975)[0] == 0).all()
    looked = []
    solve = QR._interior
    monkeypatch.setattr(QR, "_interior", lambda x, *rest: looked.append(x.shape[:2]) or solve(x, *rest))
    found = {tau: QR.fit_quantile(x, y, used, left_out, tau) for tau in (0.025, 0.97, 0.975)}
    assert sum(a * b for a, b in looked) < items * n
    monkeypatch.setattr(QR, "MANY", 1e9)
    for tau, lines in found.items():
        whole = QR.fit_quantile(x, y, used, left_out, tau)
        assert (lines[4, -2:] == 0).all() and np.abs(lines).max() > 1 or tau < 0.5
        for i in range(items):
            on = used[i]
            assert loss(x[on], y[i, on], lines[i], tau) <= loss(x[on], y[i, on], whole[i], tau) + 1e-3


def test_of_several_best_lines_the_middle_of_all_days_is_taken():
    # half of the days at each value: every constant between them is best, and the barrier's middle is taken
    n = 4000
    x, used, none = np.ones((n, 1)), np.ones((1, n), bool), np.zeros((1, 1), bool)
    y = np.where(np.arange(n) < n // 40, 10.0, 0.0)[None, :]
    found = QR.fit_quantile(x, y, used, none, 0.975)[0, 0]
    assert 1 < found < 9.5
