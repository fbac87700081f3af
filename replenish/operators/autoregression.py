"""Autoregression over two weeks of lags, from sums of lag products.

The products of a day's demand with that of the day k before only exist where both days sold, so they are taken
on selling days, by frames of exactly one day; what the zero days and the mean add has closed form. The fit (Levinson
and Durbin's recursion) and the forecast are folds over arrays of ``order`` numbers inside one row per item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.operators.projections import usable_series
from replenish.params import Params

LISTS = "array<double>"


def lag_sums(daily: DataFrame, order: int, key: str = "medicine_id") -> DataFrame:
    """Per zero-filled series: ``n``, ``mean``, autocovariances ``cov`` of lags 0 to ``order``, and the last ``order`` days, newest first.

    One shuffle by item; a window holds a day's row at most ``order`` times and the sums reuse its partitioning.
    """
    y, item = F.col("demand"), W.partitionBy(key)
    day = F.unix_date("date")
    at = item.orderBy(day)
    rows = daily.select(
        "*",
        F.datediff("date", F.min("date").over(item)).alias("_front"),
        F.datediff(F.max("date").over(item), "date").alias("_back"),
        *[(y * F.sum(y).over(at.rangeBetween(-k, -k))).alias(f"_p{k}") for k in range(1, order + 1)],
    )
    sums = rows.groupBy(key).agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count_if(y > 0).alias("positive_days"),
        F.sum(y).alias("_s"),
        F.sum(y * y).alias("_p0"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(1, order + 1)],
        *[F.sum(F.when(F.col("_front") == k, y).otherwise(0.0)).alias(f"_f{k}") for k in range(order)],
        *[F.sum(F.when(F.col("_back") == k, y).otherwise(0.0)).alias(f"_b{k}") for k in range(order)],
    )
    n = (F.datediff("last_day", "first_day") + 1).cast("double")
    sums = sums.withColumn("n", n).withColumn("mean", F.col("_s") / F.col("n"))
    mean, covariances, ends = F.col("mean"), [], F.lit(0.0)
    for k in range(order + 1):
        # pairs leave out the first k days on one side and the last k on the other
        left = 2 * F.col("_s") - ends
        pairs = F.greatest(F.col("n") - k, F.lit(0.0))
        covariances.append(F.when(pairs > 0, (F.col(f"_p{k}") - mean * left + pairs * mean * mean) / F.col("n")).otherwise(0.0))
        if k < order:
            ends = ends + F.col(f"_f{k}") + F.col(f"_b{k}")
    return sums.select(
        key, "first_day", "last_day", "positive_days", "n", "mean",
        F.array(*covariances).alias("cov"), F.array(*[F.col(f"_b{k}") for k in range(order)]).alias("recent"),
    ).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.get("cov", F.lit(0)))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _list(c: Column) -> Column:
    return c.cast(LISTS)


def levinson(cov: Column, order: int) -> Column:
    """(weights, rest): the weights of lags 1 to ``order`` that solve the normal equations of ``cov``, and the variance left over."""
    start = F.struct(_list(F.array()).alias("weights"), F.get(cov, F.lit(0)).alias("rest"))

    def step(acc: Column, m: Column) -> Column:
        known = _dot(acc["weights"], F.reverse(F.slice(cov, F.lit(2), m - 1)))
        part = F.when(acc["rest"] > F.get(cov, F.lit(0)) * 1e-12, (F.get(cov, m) - known) / acc["rest"]).otherwise(0.0)
        # one evaluation of the new weight for its three uses
        made = F.transform(
            F.array(part),
            lambda k: F.struct(
                _list(F.concat(F.zip_with(acc["weights"], F.reverse(acc["weights"]), lambda x, y: x - k * y), F.array(k))).alias("weights"),
                (acc["rest"] * (1 - k * k)).alias("rest"),
            ),
        )
        return F.get(made, F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)


def fit_autoregression(sums: DataFrame, order: int) -> DataFrame:
    """Adds ``weights`` and ``rest`` to :func:`lag_sums`."""
    return sums.withColumn("_fit", levinson(F.col("cov"), order)).select(*sums.columns, F.col("_fit.weights"), F.col("_fit.rest"))


def _recursion(weights: Column, recent: Column, steps: int, order: int) -> Column:
    """Array of (ahead, spread): each next value from the last ones, and the summed squares of an error's echoes."""
    echo = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), order - 1))
    start = F.struct(
        _list(recent).alias("recent"), _list(echo).alias("echo"), F.lit(1.0).alias("spread"),
        F.array().cast("array<struct<ahead:double,spread:double>>").alias("out"),
    )

    def shifted(values: Column, new: Column) -> Column:
        return _list(F.concat(F.array(new), F.slice(values, F.lit(1), F.lit(order - 1))))

    def step(acc: Column, _: Column) -> Column:
        pair = F.struct(_dot(weights, acc["recent"]).alias("ahead"), _dot(weights, acc["echo"]).alias("echo"))
        made = F.transform(
            F.array(pair),
            lambda p: F.struct(
                shifted(acc["recent"], p["ahead"]).alias("recent"),
                shifted(acc["echo"], p["echo"]).alias("echo"),
                (acc["spread"] + p["echo"] * p["echo"]).alias("spread"),
                F.concat(acc["out"], F.array(F.struct(p["ahead"].alias("ahead"), acc["spread"].alias("spread")))).alias("out"),
            ),
        )
        return F.get(made, F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["out"])


def autoregressive_forecast(daily: DataFrame, params: Params = Params(), order: int | None = None, key: str = "medicine_id") -> DataFrame:
    """Recursive forecast of ``horizon`` days by an autoregression over ``order`` days (``lookback`` by default).

    Items whose series is too short or too even have none. Bounds hold the variance that an error of one day carries
    on to the later ones. (key, model, confidence, h, forecast_date, forecast, lower, upper, uncertainty).
    """
    order = order or params.lookback
    usable = usable_series(lag_sums(daily, order, key), params).filter("ar_ok")
    rows = fit_autoregression(usable, order)
    ahead = _recursion(F.col("weights"), F.transform("recent", lambda x: x - F.col("mean")), params.horizon, order)
    rows = rows.select(key, "last_day", "mean", "rest", F.posexplode(ahead).alias("h", "_a"))
    value, width = F.col("mean") + F.col("_a.ahead"), F.sqrt(F.col("rest") * F.col("_a.spread"))
    return rows.select(
        key,
        F.lit("autoregression").alias("model"),
        F.lit(params.confidence).alias("confidence"),
        F.col("h").cast("bigint").alias("h"),
        S.forecast_date(F.col("last_day"), F.col("h")).alias("forecast_date"),
        S.at_least_zero(value).alias("forecast"),
        S.at_least_zero(value - params.z * width).alias("lower"),
        S.at_least_zero(value + params.z * width).alias("upper"),
        width.alias("uncertainty"),
    )
