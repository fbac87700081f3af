"""Quantile regression: intervals whose ends are models of demand quantiles.

An item's quantile is linear in calendar features (constant, time, weekly and yearly waves) and minimises the pinball
loss over its zero-filled days. That is a linear program; its dual has one number between 0 and 1 a day, and an
interior-point method solves it by some twenty weighted least-squares steps. Features depend on the date only, so a
step's normal equations of a block of items are one product of their weights (items x days) with the calendar's
products of features. An item is bounded by the calendar, and a block by its items, whatever the number of rows.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.operators.validation import held_out
from replenish.params import Params
from replenish.session import stored

WEEK_WAVES, YEAR_WAVES = 3, 1
YEAR, WEEK = 365.25, 7.0
ITEMS_AT_ONCE = 128
STEPS, GAP, KEEP_INSIDE = 60, 1e-8, 0.9995
# zero days looked at from the start, the least breach that adds a day, and tries to prove that zero is best
EVERY, OTHER_SIDE, PROOF_STEPS = 13, 1e-7, 12
# zero days of the first look, for each feature, below which all days are looked at
MANY = 3
# a weight's share of the largest, so that unneeded features do no harm
REST_COST = 1e-10


def features(days: np.ndarray) -> np.ndarray:
    """(days, features) of days since 1970-01-01; time is in years from 2000."""
    day = np.asarray(days, float)
    waves = [2 * math.pi * k / p for p, n in ((WEEK, WEEK_WAVES), (YEAR, YEAR_WAVES)) for k in range(1, n + 1)]
    return np.stack([np.ones_like(day), day / YEAR - 30.0, *[f(day * w) for w in waves for f in (np.sin, np.cos)]], axis=-1)


def _inside(value: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The longest step up to 1 of each row that keeps its values positive."""
    limit = np.divide(-value, step, out=np.full(value.shape, np.inf), where=step < 0)
    return np.minimum(1.0, KEEP_INSIDE * limit.min(axis=1))


def _least_squares(x: np.ndarray, weight: np.ndarray, left_out: np.ndarray):
    """Solver of the weighted normal equations of ``x`` (items, days, features); features left out get 0."""
    a = np.matmul(x.transpose(0, 2, 1) * weight[:, None, :], x)
    a[left_out] = 0.0
    a.transpose(0, 2, 1)[left_out] = 0.0
    size = np.maximum(np.einsum("ipp->ip", a).max(axis=1), 1e-300)
    a += (REST_COST * size)[:, None, None] * np.eye(a.shape[1])
    row, feature = np.nonzero(left_out)
    a[row, feature, feature] = 1.0
    return lambda target: np.linalg.solve(a, np.where(left_out, 0.0, target)[:, :, None])[:, :, 0]


def _sums(value: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.matmul(value[:, None, :], x)[:, 0]


def _lines(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.matmul(x, beta[:, :, None])[:, :, 0]


def _span(x: np.ndarray, days: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Whether an item's ``days`` span its features, so that only one line goes through them."""
    a = np.matmul(x.transpose(0, 2, 1) * days[:, None, :], x)
    a[left_out] = 0.0
    a.transpose(0, 2, 1)[left_out] = 0.0
    size = np.maximum(np.einsum("ipp->ip", a).max(axis=1), 1e-300)
    row, feature = np.nonzero(left_out)
    a[row, feature, feature] = size[row]
    return np.linalg.eigvalsh(a)[:, 0] > 1e-9 * size


def _zero_is_best(x: np.ndarray, y: np.ndarray, on: np.ndarray, left_out: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Which items' only best line is zero: a dual proves it, strictly inside on zero days that span the features."""
    free = (y == 0) & (on > 0)
    target = np.where(left_out, 0.0, target - _sums(((y > 0) & (on > 0)).astype(float), x))
    scale = 1e-9 * np.maximum(on.sum(axis=1), 1.0)
    proved, going = np.zeros(len(y), bool), np.flatnonzero(free.sum(axis=1) >= x.shape[2])
    x, target, free, left_out, scale = (z[going] for z in (x, target, free, left_out, scale))
    weight, push, miss = free.astype(float), np.zeros(target.shape), target
    for _ in range(PROOF_STEPS):
        push = push + _least_squares(x, weight, left_out)(miss)
        dual = _lines(push, x)
        inside = free & (dual > 1e-6) & (dual < 1 - 1e-6)
        miss = np.where(left_out, 0.0, target - _sums(np.clip(dual, 0.0, 1.0) * free, x))
        done = np.abs(miss).max(axis=1) <= scale
        if done.any():
            proved[going[done]] = _span(x[done], inside[done], left_out[done])
        # one without a free day left can't be moved any more
        stay = ~done & inside.any(axis=1)
        x, target, free, left_out, push, miss, scale, going = (z[stay] for z in (x, target, free, left_out, push, miss, scale, going))
        weight = inside[stay].astype(float)
        if not len(going):
            break
    return proved


def _interior(
    x: np.ndarray, y: np.ndarray, on: np.ndarray, left_out: np.ndarray, tau: float, target: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of least loss over the days ``on``, and whether no others have it.

    ``target`` is what the days' duals times features sum up to.
    """
    count = np.maximum(on.sum(axis=1), 1.0)
    beta = _least_squares(x, on, left_out)(_sums(y, x))
    # u, v: how far a day's dual is from its lower and upper end; above, below: its residual's two sides
    u = np.where(on > 0, 1.0 - tau, 0.5)
    v = 1.0 - u
    left = (y - _lines(beta, x)) * on
    margin = np.maximum(np.abs(left).sum(axis=1) / count, 1e-3)[:, None] * 0.5
    above, below = np.maximum(left, 0.0) + margin, np.maximum(-left, 0.0) + margin
    found, only, going = beta.copy(), np.zeros(len(y), bool), np.arange(len(y))
    # a day above the line pushes its dual up, so `above` belongs to the upper end
    for _ in range(STEPS):
        gap = ((u * below + v * above) * on).sum(axis=1) / count
        stay = gap >= GAP
        found[going] = beta
        if not stay.all():
            done = ~stay
            held = (np.minimum(u, v) > np.maximum(above, below)) & (on > 0)
            only[going[done]] = _span(x[done], held[done], left_out[done])
            if not stay.any():
                break
            # items that are done stay as they are
            x, y, on, left_out, target, count, beta, u, v, above, below, gap, going = (
                z[stay] for z in (x, y, on, left_out, target, count, beta, u, v, above, below, gap, going)
            )
        down, up = below / u, above / v
        weight = on / (down + up)
        solve = _least_squares(x, weight, left_out)
        short = target - _sums(u * on, x)
        miss = (y - _lines(beta, x) - above + below) * on

        def step(lower: np.ndarray | float, upper: np.ndarray | float):
            """Newton step towards u * below = lower and v * above = upper."""
            lower, upper = lower / u - below, upper / v - above
            pull = miss + lower - upper
            d_beta = solve(_sums(weight * pull, x) - short)
            d_u = weight * (pull - _lines(d_beta, x))
            return d_beta, d_u, (lower - down * d_u) * on, (upper + up * d_u) * on

        _, d_u, d_below, d_above = step(0.0, 0.0)
        dual = np.minimum(_inside(u, d_u), _inside(v, -d_u))[:, None]
        sides = np.minimum(_inside(below, d_below), _inside(above, d_above))[:, None]
        after = (((u + dual * d_u) * (below + sides * d_below) + (v - dual * d_u) * (above + sides * d_above)) * on).sum(axis=1) / count
        centre = ((after / gap) ** 3 * gap / 2)[:, None]
        d_beta, d_u, d_below, d_above = step(centre - d_u * d_below, centre + d_u * d_above)
        dual = np.minimum(_inside(u, d_u), _inside(v, -d_u))[:, None]
        sides = np.minimum(_inside(below, d_below), _inside(above, d_above))[:, None]
        u, v, beta = u + dual * d_u, v - dual * d_u, beta + sides * d_beta
        below, above = below + sides * d_below, above + sides * d_above
    else:
        found[going] = beta
    return found, only


def fit_quantile(x: np.ndarray, y: np.ndarray, used: np.ndarray, left_out: np.ndarray, tau: float) -> np.ndarray:
    """(items, features) weights of least pinball loss.

    ``x`` is (days, features) for all items, ``y`` (items, days), ``used`` says which days an item has, ``left_out``
    which features it goes without (their weight is 0). An item without days gets zeros.

    A zero day on the line's usual side costs a share of the line, whatever the line: all such days enter as one sum of
    features. Every ``EVERY``-th zero day is looked at by itself, and so is any that a found line has on its other side,
    until there is none: then the line is the best for all days. Of several best lines the one in their middle is
    taken, which depends on all days, so all are looked at then.
    """
    items, p = y.shape[0], x.shape[1]
    # each item in its own unit, so that one tolerance serves all
    unit = np.maximum(np.abs(np.where(used, y, 0.0)).max(axis=1, initial=0.0), 1e-12)
    y = np.where(used, y, 0.0) / unit[:, None]
    whole = (1.0 - tau) * (used.astype(float) @ x)
    taken = used.copy()
    # days left out may not outweigh those looked at, or a line could leave them without end
    if min(tau, 1.0 - tau) * EVERY < 0.5:
        many = (used & (y == 0)).sum(axis=1) >= MANY * EVERY * p
        taken &= (y != 0) | (np.arange(len(x)) % EVERY == 0) | ~many[:, None]
    upper = tau >= 0.5
    beta, todo, first = np.zeros((items, p)), np.arange(items), True
    while len(todo):
        row, day = np.nonzero(taken[todo])
        counts = np.bincount(row, minlength=len(todo))
        at = np.zeros((len(todo), max(counts.max(), 1)), int)
        on = np.arange(at.shape[1]) < counts[:, None]
        at[on] = day
        xs, ys, on = x[at], np.take_along_axis(y[todo], at, axis=1) * on, on.astype(float)
        # a dual is 0 below the line and 1 above it
        target = whole[todo] if upper else whole[todo] - (used[todo] & ~taken[todo]).astype(float) @ x
        if first:
            open_ = ~_zero_is_best(xs, ys, on, left_out[todo], target)
            todo, xs, ys, on, target, first = todo[open_], xs[open_], ys[open_], on[open_], target[open_], False
        if not len(todo):
            break
        beta[todo], only = _interior(xs, ys, on, left_out[todo], tau, target)
        line = beta[todo] @ x.T
        wrong = used[todo] & ~taken[todo] & (~only[:, None] | ((line < -OTHER_SIDE) if upper else (line > OTHER_SIDE)))
        taken[todo] |= wrong
        todo = todo[wrong.any(axis=1)]
    return beta * unit[:, None]


def _forecast(quantiles: tuple[float, float], steps: int, key: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ITEMS_AT_ONCE):
                some = batch.iloc[start : start + ITEMS_AT_ONCE]
                first, last = some["a"].to_numpy(np.int64), some["b"].to_numpy(np.int64)
                calendar = np.arange(first.min(), last.max() + 1)
                used = (calendar >= first[:, None]) & (calendar <= last[:, None])
                y = np.zeros(used.shape)
                for i, (days, values) in enumerate(zip(some["days"], some["demands"])):
                    y[i, np.asarray(days, np.int64) - calendar[0]] = values
                x = features(calendar)
                left_out = np.zeros((len(some), x.shape[1]), bool)
                left_out[last - first + 1 < 365, -2 * YEAR_WAVES :] = True
                ahead = features(last[:, None] + np.arange(1, steps + 1))
                ends = np.sort([np.einsum("ihp,ip->ih", ahead, fit_quantile(x, y, used, left_out, q)) for q in quantiles], axis=0)
                yield pd.DataFrame(
                    {
                        key: some[key].repeat(steps).to_numpy(), "last_day": some["last_day"].repeat(steps).to_numpy(),
                        "days": (last - first + 1).repeat(steps), "h": np.tile(np.arange(steps), len(some)),
                        "lower": ends[0].ravel(), "upper": ends[1].ravel(),
                    }
                )

    return rows


def quantile_regression_interval(
    daily: DataFrame, quantiles: tuple[float, float] | None = None, params: Params = Params(), key: str = "medicine_id"
) -> DataFrame:
    """Per item and day ahead the two ends of the interval, never negative and never crossed.

    Items need ``min_series_days`` days from their first to their last; yearly waves enter from 365 days on. A
    null date or demand is no day. ``quantiles`` are those of ``confidence`` if not given.
    """
    tail = (1 - params.confidence) / 2
    place = F.datediff("date", F.lit(dt.date(1970, 1, 1)))
    known = daily.filter("date is not null and demand is not null").select(key, "date", place.alias("day"), F.col("demand").cast("double").alias("demand"))
    # one entry a selling day: a day's rows are summed before an item is put together
    per_day = known.groupBy(key, "date", "day").agg(F.sum("demand").alias("demand"))
    # an item's work is its calendar's, not its bytes': a fixed number of tasks, which isn't merged by size
    per_day = per_day.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    pairs = F.sort_array(F.collect_list(F.struct("day", "demand")))
    lists = per_day.groupBy(key).agg(
        F.max("date").alias("last_day"), F.min("day").alias("a"), F.max("day").alias("b"), pairs["day"].alias("days"), pairs["demand"].alias("demands")
    )
    lists = lists.filter(F.col("b") - F.col("a") + 1 >= params.min_series_days)
    kind = daily.schema[key].dataType.simpleString()
    rows = lists.mapInPandas(
        _forecast(quantiles or (tail, 1 - tail), params.horizon, key), f"{key} {kind}, last_day date, days bigint, h bigint, lower double, upper double"
    )
    ends = [S.at_least_zero(F.col(c)).alias(c) for c in ("lower", "upper")]
    return rows.select(key, "h", S.forecast_date(F.col("last_day"), F.col("h")).alias("forecast_date"), *ends, "days")


def coverage(daily: DataFrame, quantiles: tuple[float, float] | None = None, params: Params = Params(), key: str = "medicine_id") -> DataFrame:
    """Of the held-out last fifth of each series, as far as the horizon goes: per item the days, those below, inside and above, and the width."""
    train, spans = held_out(daily, key=key)
    spans = stored(spans, "coverage-spans")
    ends = quantile_regression_interval(train, quantiles, params, key)
    asked = ends.join(spans, key).filter("forecast_date > cut and forecast_date <= last_day").drop("days")
    actual = daily.groupBy(key, F.col("date").alias("forecast_date")).agg(F.sum("demand").alias("demand"))
    y = F.coalesce("demand", F.lit(0.0))
    return (
        asked.join(actual, [key, "forecast_date"], "left")
        .groupBy(key)
        .agg(
            F.count("*").alias("days"), F.count_if(y < F.col("lower") - 1e-6).alias("below"), F.count_if(y > F.col("upper") + 1e-6).alias("above"),
            F.avg(F.col("upper") - F.col("lower")).alias("width"),
        )
        .withColumn("inside", F.col("days") - F.col("below") - F.col("above"))
    )
