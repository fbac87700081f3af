"""Exponential smoothing with a damped trend and a weekly season.

The recursion runs day by day and so can't be a sum; Spark gathers an item's selling days (bounded by the
calendar) into one row, and a batch of items goes through them together, all settings of a fixed grid at once.
The setting with the least squared one-step error makes the forecast.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.params import Params

WEEK = 7
# fixed values: level, trend and season rates, damping
GRID = np.array(list(product((0.02, 0.1, 0.3), (0.0, 0.02), (0.0, 0.05, 0.2), (0.9, 0.98))))
ITEMS_AT_ONCE = 256
# runs of days without demand are taken in powers of two
MOST_BITS = 24


def _idle() -> list[np.ndarray]:
    """Per power of two (settings, 9, 18): what that many days without demand make of a state, beside the form of their squared errors.

    A state is level, trend and the season from the next day on, so that one matrix serves every day.
    """
    alpha, beta, gamma, phi = GRID.T
    move = np.zeros((len(GRID), 2 + WEEK, 2 + WEEK))
    # the day's miss is minus what was expected: level + phi * trend + season
    seen = np.zeros((len(GRID), 2 + WEEK))
    seen[:, 0], seen[:, 1], seen[:, 2] = 1.0, phi, 1.0
    move[:, 0] = -alpha[:, None] * seen
    move[:, 0, 0] += 1.0
    move[:, 0, 1] += phi
    move[:, 1] = -(alpha * beta)[:, None] * seen
    move[:, 1, 1] += phi
    move[:, 1 + WEEK] = -(gamma * (1 - alpha))[:, None] * seen
    move[:, 1 + WEEK, 2] += 1.0
    for k in range(WEEK - 1):
        move[:, 2 + k, 3 + k] = 1.0
    form, out = seen[:, :, None] * seen[:, None, :], []
    for _ in range(MOST_BITS):
        out.append(np.concatenate([move.transpose(0, 2, 1), form], axis=2))
        form = form + move.transpose(0, 2, 1) @ form @ move
        move = move @ move
    return out


IDLE = _idle()


def smooth(items: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(forecasts, error) of zero-filled series of ``lengths`` days, given as (days, demands) in order of day; settings are chosen per row.

    Between two selling days the recursion is linear, so a run of days without demand is one step of matrix powers;
    an item costs its selling days, not its calendar.
    """
    alpha, beta, gamma, phi = (c[:, None] for c in GRID.T)
    rows = np.arange(len(items))
    first = np.zeros((len(items), WEEK))
    later = []
    for i, (days, demand) in enumerate(items):
        # of rows of one day the last counts
        single = np.append(days[1:] != days[:-1], True)[: len(days)]
        days, demand = days[single], demand[single]
        early = days < WEEK
        first[i, days[early]] = demand[early]
        later.append((days[~early], demand[~early]))
    state = np.zeros((len(GRID), len(items), 2 + WEEK))
    state[:, :, 0] = [s[: min(WEEK, n)].mean() for s, n in zip(first, lengths)]
    error = np.zeros(state.shape[:2])

    def sell(on: np.ndarray, y: np.ndarray, counts: bool) -> None:
        """A day of demand ``y`` for the items ``on``."""
        own = state[:, on]
        expected = own[:, :, 0] + phi * own[:, :, 1]
        miss = y - expected - own[:, :, 2]
        if counts:
            error[:, on] += miss * miss
        new = np.empty_like(own)
        new[:, :, 0] = expected + alpha * miss
        new[:, :, 1] = phi * own[:, :, 1] + alpha * beta * miss
        new[:, :, 2:-1] = own[:, :, 3:]
        new[:, :, -1] = own[:, :, 2] + gamma * (1 - alpha) * miss
        state[:, on] = new

    def idle(on: np.ndarray, days: np.ndarray) -> None:
        """So many days without demand for the items ``on``."""
        for bit, powers in enumerate(IDLE):
            some = on[(days >> bit) & 1 == 1]
            if len(some):
                own = state[:, some]
                both = own @ powers
                error[:, some] += np.maximum(np.einsum("sik,sik->si", both[:, :, 2 + WEEK :], own), 0.0)
                state[:, some] = both[:, :, : 2 + WEEK]

    for t in range(WEEK):
        on = rows[t < lengths]
        sell(on, first[on, t], False)
    # the next selling day of every item that has one more
    at, sold = np.minimum(lengths, WEEK), np.array([len(days) for days, _ in later], int)
    widest = int(sold.max(initial=0))
    when, what = np.zeros((len(items), widest), np.int64), np.zeros((len(items), widest))
    for i, (days, demand) in enumerate(later):
        when[i, : len(days)], what[i, : len(days)] = days, demand
    for k in range(widest):
        on = rows[sold > k]
        idle(on, when[on, k] - at[on])
        sell(on, what[on, k], True)
        at[on] = when[on, k] + 1
    idle(rows, lengths - at)
    error = error.T
    best = error.argmin(axis=1)
    level, trend, season = state[best, rows, 0], state[best, rows, 1], state[best, rows, 2:]
    damped = np.cumsum(GRID[best, 3][:, None] ** np.arange(1, steps + 1), axis=1)
    ahead = level[:, None] + damped * trend[:, None] + season[:, np.arange(steps) % WEEK]
    return ahead, np.sqrt(error[rows, best] / np.maximum(lengths - WEEK, 1))


def _forecast(steps: int):
    @F.pandas_udf("ahead array<double>, uncertainty double")
    def rows(n: pd.Series, days: pd.Series, demands: pd.Series) -> pd.DataFrame:
        ahead, error = [], []
        for at in range(0, len(n), ITEMS_AT_ONCE):
            some = slice(at, at + ITEMS_AT_ONCE)
            series = [(np.asarray(d, np.int64), np.asarray(y, float)) for d, y in zip(days.iloc[some], demands.iloc[some])]
            values, spread = smooth(series, n.iloc[some].to_numpy(np.int64), steps)
            ahead.extend(values)
            error.append(spread)
        return pd.DataFrame({"ahead": ahead, "uncertainty": np.concatenate(error) if error else []})

    return rows


def smoothed_forecast(daily: DataFrame, params: Params = Params(), key: str = "medicine_id", beside: DataFrame | None = None) -> DataFrame:
    """Forecast of ``horizon`` days of every item with at least ``min_series_days`` days, in the long form of the other models.

    Columns of ``beside``, which has a row for every item, come along under their names.
    """
    day = F.unix_date("date")
    pairs = F.sort_array(F.collect_list(F.struct(day.alias("day"), "demand")))
    items = daily.groupBy(key).agg(F.min("date").alias("_first"), F.max("date").alias("_last"), pairs.alias("_p"))
    items = items.select(
        key,
        "_last",
        (F.datediff("_last", "_first") + 1).alias("_n"),
        F.transform("_p", lambda x: x["day"] - F.unix_date("_first")).alias("_days"),
        F.transform("_p", lambda x: x["demand"].cast("double")).alias("_demands"),
    ).filter(F.col("_n") >= params.min_series_days)
    more = [] if beside is None else [name for name in beside.columns if name != key]
    if beside is not None:
        items = items.join(beside.hint("shuffle_hash"), key)
    made = items.select(key, "_last", *more, _forecast(params.horizon)("_n", "_days", "_demands").alias("_f"))
    rows = made.select(key, "_last", *more, F.posexplode_outer("_f.ahead").alias("h", "_value"), F.col("_f.uncertainty").alias("uncertainty"))
    value, width = F.col("_value"), params.z * F.col("uncertainty")
    return rows.select(
        key,
        F.lit("smoothing").alias("model"),
        F.lit(params.confidence).alias("confidence"),
        F.col("h").cast("bigint").alias("h"),
        S.forecast_date(F.col("_last"), F.col("h")).alias("forecast_date"),
        S.at_least_zero(value).alias("forecast"),
        S.at_least_zero(value - width).alias("lower"),
        S.at_least_zero(value + width).alias("upper"),
        "uncertainty",
        *more,
    )
