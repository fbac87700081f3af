"""Intervals around forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import draws
from replenish.functions.scalars import at_least_zero, sine_season
from replenish.params import Params


def confidence_interval(df: DataFrame, forecast: str, error: str, params: Params = Params()) -> DataFrame:
    margin = F.lit(params.z) * F.col(error)
    return df.withColumn("lower", F.col(forecast) - margin).withColumn("upper", F.col(forecast) + margin)


def prediction_interval(df: DataFrame, forecast: str, variance: Column, ahead: Column, params: Params = Params()) -> DataFrame:
    """Interval whose variance grows by a tenth per day ahead; the lower end stays at or above zero."""
    margin = F.lit(params.z) * F.sqrt(variance * (F.lit(1.0) + F.lit(0.1) * ahead))
    return df.withColumn("lower", at_least_zero(F.col(forecast) - margin)).withColumn("upper", F.col(forecast) + margin)


def ensemble_interval(forecasts: DataFrame, params: Params = Params()) -> DataFrame:
    """Mean and mean +- z x population deviation over the component forecasts of an item and day."""
    z = F.lit(params.z)
    return (
        forecasts.groupBy("medicine_id", "h")
        .agg(F.avg("forecast").alias("mean"), F.stddev_pop("forecast").alias("std"))
        .withColumn("lower", F.col("mean") - z * F.col("std"))
        .withColumn("upper", F.col("mean") + z * F.col("std"))
    )


def quantile_interval(daily: DataFrame, quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Empirical demand quantiles per item and weekday, interpolated; at most one value per selling day."""
    return daily.groupBy("medicine_id", F.weekday("date").cast("bigint").alias("weekday")).agg(
        F.percentile("demand", quantiles[0]).alias("lower"),
        F.percentile("demand", quantiles[1]).alias("upper"),
        F.count("*").alias("days"),
    )


def monte_carlo_interval(
    forecasts: DataFrame, simulations: int | None = None, std: str = "std", params: Params = Params()
) -> DataFrame:
    """Percentile interval of simulated normal noise around each forecast value.

    All items share the noise of a simulation and day (common random numbers).
    Percentiles commute with ``f + std * z`` for ``std >= 0``, so they are taken
    once over the noise (``simulations x horizon`` numbers, whatever the number
    of items) and then scaled per item.
    """
    alpha = 1 - params.confidence
    spark = forecasts.sparkSession
    noise = spark.range(simulations or params.simulations).select(
        F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(params.horizon - 1).cast("bigint"))).alias("h")
    )
    q = (
        noise.withColumn("z", draws.normal(f"mc{params.seed}", F.col("sim"), F.col("h")))
        .groupBy("h")
        .agg(F.percentile("z", alpha / 2).alias("_lo"), F.percentile("z", 1 - alpha / 2).alias("_hi"))
    )
    joined = forecasts.join(F.broadcast(q), "h")  # one row per day ahead
    return (
        joined.withColumn("lower", F.col("forecast") + F.col(std) * F.col("_lo"))
        .withColumn("upper", F.col("forecast") + F.col(std) * F.col("_hi"))
        .drop("_lo", "_hi")
    )


ITEMS_AT_ONCE = 64
DEALT = 64


def _quantiles(values: np.ndarray, known: np.ndarray, ends: list[float]) -> list[np.ndarray]:
    """Interpolated quantiles of every row over its ``known`` values; missing ones are NaN and sort last."""
    ordered = np.sort(values, axis=1)
    row, last, out = np.arange(len(values)), np.maximum(known - 1, 0), []
    for q in ends:
        at = q * last
        low = np.floor(at).astype(int)
        a, b = ordered[row, low], ordered[row, np.minimum(low + 1, last)]
        out.append(a + (b - a) * (at - low))
    return out


def bootstrap_mean(daily: DataFrame, rounds: int | None = None, params: Params = Params()) -> DataFrame:
    """Percentile interval of the mean selling-day demand by a Poisson bootstrap.

    The weight of a day in a round depends on the day only, so one weight vector is drawn per calendar day. An
    item's days meet their vectors as one small matrix: its rounds are two products, and no row is repeated per
    round. Rounds in which an item drew none of its days have no mean; ``rounds`` says how many have.
    """
    alpha, total = 1 - params.confidence, rounds or params.bootstrap_rounds
    # days x rounds draws, bounded by the calendar
    # dates are few, what is made of them is not: they are dealt out first, and the lists keep that partitioning
    dates = daily.select("date").distinct().repartition(DEALT, "date")
    draw = dates.select("date", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("b"))
    draw = draw.withColumn("w", draws.bits(f"boot{params.seed}", F.col("date"), F.col("b")))
    weights = draw.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("w"))
    table = weights.toArrow()
    at = {day: i for i, day in enumerate(table["date"].to_pylist())}
    drawn = [chunk.flatten().to_numpy() for chunk in table["w"].chunks]
    matrix = draws.poisson1_values(np.concatenate([np.empty(0, np.int64), *drawn])).reshape(len(at), total)
    shared = daily.sparkSession.sparkContext.broadcast((at, matrix))
    ends = [alpha / 2, 1 - alpha / 2]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, all_weights = shared.value
        for batch in batches:
            for start in range(0, len(batch), ITEMS_AT_ONCE):
                some = batch.iloc[start : start + ITEMS_AT_ONCE]
                # the block's days only, so that sparse items multiply what they sold on
                used = sorted({index[day] for days in some["days"] for day in days})
                place = {k: n for n, k in enumerate(used)}
                demand, sold = np.zeros((2, len(some), len(used)))
                for i, (days, values) in enumerate(zip(some["days"], some["demands"])):
                    own = [place[index[day]] for day in days]
                    demand[i, own], sold[i, own] = values, 1.0
                block = all_weights[used].astype(float)
                size = sold @ block
                means = np.divide(demand @ block, size, out=np.full(size.shape, np.nan), where=size > 0)
                rounds = (size > 0).sum(axis=1)
                bounds = _quantiles(means, rounds, ends)
                yield pd.DataFrame({"medicine_id": some["medicine_id"].to_numpy(), "rounds": rounds, "lower": bounds[0], "upper": bounds[1]})

    # one entry a selling day
    pairs = F.sort_array(F.collect_list(F.struct("date", "demand")))
    items = daily.groupBy("medicine_id").agg(pairs["date"].alias("days"), pairs["demand"].alias("demands"))
    kind = daily.schema["medicine_id"].dataType.simpleString()
    return items.mapInPandas(per_batch, f"medicine_id {kind}, rounds bigint, lower double, upper double")


def bootstrap_forecast(daily: DataFrame, rounds: int | None = None, params: Params = Params()) -> DataFrame:
    """Percentile interval of the baseline forecast refitted in every round, per item and day ahead.

    A refit has the round's mean, and its forecast for a day is that mean times a positive season factor, under
    which percentiles keep: they are taken once over the means.
    """
    days = F.sequence(F.lit(0).cast("bigint"), F.lit(params.horizon - 1).cast("bigint"))
    rows = bootstrap_mean(daily, rounds, params).select("medicine_id", F.explode(days).alias("h"), "lower", "upper")
    ends = [at_least_zero(F.col(c) + sine_season(F.col(c), F.col("h"))).alias(c) for c in ("lower", "upper")]
    return rows.select("medicine_id", "h", *ends)
