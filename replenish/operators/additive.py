"""Additive model with change points: ridge regression on calendar features.

A day's features (constant, time, a hinge at each change point, weekly and yearly waves) depend on the date only. So an
item's normal equations need no dense series: the products of features over its days are a difference of two
running sums over the calendar, which is one array for all items, and the products with demand are sums over
its selling days. Yearly waves enter from a year of data on.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.params import Params

HINGES, WEEK_WAVES, YEAR_WAVES = 12, 3, 3
# hinges lie in the first part of the calendar, so that the last slope rests on data
HINGE_SPAN = 0.8
YEAR, WEEK = 365.25, 7.0
# fixed values: what a squared weight of each kind costs
HINGE_COST, WAVE_COST, REST_COST = 5.0, 1.0, 1e-6


@dataclass(frozen=True)
class Design:
    """Features of days counted from ``first``, the calendar's first day; ``days`` is its length."""

    first: dt.date
    days: int

    @property
    def hinges(self) -> list[float]:
        return [HINGE_SPAN * self.days / YEAR * (k + 1) / (HINGES + 1) for k in range(HINGES)]

    @property
    def yearly(self) -> np.ndarray:
        out = np.zeros(2 + HINGES + 2 * (WEEK_WAVES + YEAR_WAVES), bool)
        out[-2 * YEAR_WAVES :] = True
        return out

    @property
    def costs(self) -> np.ndarray:
        return np.array([REST_COST] * 2 + [HINGE_COST] * HINGES + [WAVE_COST] * 2 * (WEEK_WAVES + YEAR_WAVES))

    def _waves(self) -> list[float]:
        return [2 * math.pi * k / p for p, n in ((WEEK, WEEK_WAVES), (YEAR, YEAR_WAVES)) for k in range(1, n + 1)]

    def columns(self, date: Column) -> list[Column]:
        day = F.datediff(date, F.lit(self.first)).cast("double")
        years = day / F.lit(YEAR)
        waves = [f(day * F.lit(w)) for w in self._waves() for f in (F.sin, F.cos)]
        return [F.lit(1.0), years, *[F.greatest(F.lit(0.0), years - F.lit(c)) for c in self.hinges], *waves]

    def matrix(self, days: np.ndarray) -> np.ndarray:
        """(days, features), the values of :meth:`columns`."""
        day = np.asarray(days, float)
        years = day / YEAR
        waves = [f(day * w) for w in self._waves() for f in (np.sin, np.cos)]
        return np.stack([np.ones_like(day), years, *[np.maximum(0.0, years - c) for c in self.hinges], *waves], axis=-1)


def design_of(daily: DataFrame) -> Design:
    ends = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return Design(ends["a"], (ends["b"] - ends["a"]).days + 1) if ends["a"] else Design(dt.date(1970, 1, 1), 1)


def design_sums(daily: DataFrame, design: Design, key: str = "medicine_id") -> DataFrame:
    """Per item: first and last day, positive days, squared demand, and ``xy``, the products of features and demand."""
    y = F.col("demand").cast("double")
    names = [f"_x{k}" for k in range(len(design.costs))]
    rows = daily.select(key, "date", y.alias("demand"), *[(y * c).alias(n) for c, n in zip(design.columns(F.col("date")), names)])
    sums = rows.groupBy(key).agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_if(F.col("demand") > 0).alias("positive_days"),
        F.sum(F.col("demand") * F.col("demand")).alias("syy"), *[F.sum(n).alias(n) for n in names],
    )
    return sums.select(key, "first_day", "last_day", "positive_days", "syy", F.array(*names).alias("xy"))


def solve(design: Design, first: np.ndarray, last: np.ndarray, xy: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, products of features over the days from ``first`` to ``last``) of each item; yearly waves only from a year on."""
    products = running[last + 1] - running[first]
    short = (last - first + 1 < 365)[:, None] & design.yearly
    a = products + np.diag(design.costs)
    a[short] = 0.0
    a.transpose(0, 2, 1)[short] = 0.0
    items, feature = np.nonzero(short)
    a[items, feature, feature] = 1.0
    return np.linalg.solve(a, np.where(short, 0.0, xy)[:, :, None])[:, :, 0], products


def _forecast(design: Design, running, steps: int):
    @F.pandas_udf("ahead array<double>, uncertainty double")
    def rows(a: pd.Series, b: pd.Series, squares: pd.Series, sums: pd.Series) -> pd.DataFrame:
        first, last, xy = a.to_numpy(np.int64), b.to_numpy(np.int64), np.stack(sums.to_list()).astype(float)
        weights, products = solve(design, first, last, xy, running.value)
        ahead = design.matrix(last[:, None] + np.arange(1, steps + 1))
        value = np.einsum("ihp,ip->ih", ahead, weights)
        left = squares.to_numpy(float) - 2 * (weights * xy).sum(axis=1) + np.einsum("ip,ipq,iq->i", weights, products, weights)
        return pd.DataFrame({"ahead": list(value), "uncertainty": np.sqrt(np.maximum(left, 0.0) / np.maximum(last - first, 1))})

    return rows


def change_point_forecast(
    daily: DataFrame, params: Params = Params(), key: str = "medicine_id", beside: DataFrame | None = None, design: Design | None = None
) -> DataFrame:
    """Forecast of ``horizon`` days of items with ``min_series_days`` days and two with demand, in the long form of the other models.

    Columns of ``beside``, which has a row for every item, come along under their names. ``design`` is known where
    the ends of the calendar were found before.
    """
    design = design or design_of(daily)
    x = design.matrix(np.arange(design.days))
    # one matrix a calendar day
    running = np.concatenate([np.zeros((1, x.shape[1], x.shape[1])), np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
    shared = daily.sparkSession.sparkContext.broadcast(running)
    place = lambda c: F.datediff(c, F.lit(design.first))
    sums = design_sums(daily, design, key).filter((F.datediff("last_day", "first_day") + 1 >= params.min_series_days) & (F.col("positive_days") >= 2))
    items = sums.select(key, F.col("last_day").alias("_last"), place("first_day").alias("_a"), place("last_day").alias("_b"), F.col("syy").alias("_yy"), F.col("xy").alias("_xy"))
    more = [] if beside is None else [name for name in beside.columns if name != key]
    if beside is not None:
        items = items.join(beside.hint("shuffle_hash"), key)
    made = items.select(key, "_last", *more, _forecast(design, shared, params.horizon)("_a", "_b", "_yy", "_xy").alias("_f"))
    rows = made.select(key, "_last", *more, F.posexplode_outer("_f.ahead").alias("h", "_value"), F.col("_f.uncertainty").alias("uncertainty"))
    value, width = F.col("_value"), params.z * F.col("uncertainty")
    return rows.select(
        key,
        F.lit("change_points").alias("model"),
        F.lit(params.confidence).alias("confidence"),
        F.col("h").cast("bigint").alias("h"),
        S.forecast_date(F.col("_last"), F.col("h")).alias("forecast_date"),
        S.at_least_zero(value).alias("forecast"),
        S.at_least_zero(value - width).alias("lower"),
        S.at_least_zero(value + width).alias("upper"),
        "uncertainty",
        *more,
    )
