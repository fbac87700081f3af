"""Forecast errors on days that no model was fitted to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.operators import forecast as FC
from replenish.operators.additive import change_point_forecast, design_of
from replenish.operators.autoregression import autoregressive_forecast
from replenish.operators.joins import spread_by_item
from replenish.operators.smoothing import smoothed_forecast
from replenish.params import Params
from replenish.session import stored

TRAIN_SHARE = 0.8
HELD = ("medicine_id", "cut", "last_day", "held")


def item_series(daily: DataFrame, share: float = TRAIN_SHARE, key: str = "medicine_id") -> DataFrame:
    """One row per item: first, last and ``cut`` day, the selling days up to the cut (``dates``, ``demands``) and after it (``held``).

    Items of a single day have nothing to hold out and are left out.
    """
    rows = spread_by_item(daily.filter(F.col(key).isNotNull() & F.col("date").isNotNull()), key)
    days = F.sort_array(F.collect_list(F.struct("date", "demand"))).alias("_days")
    items = rows.groupBy(key).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), days)
    kept = F.floor((F.datediff("last_day", "first_day") + 1) * F.lit(share)).cast("int")
    items = items.withColumn("cut", F.date_add("first_day", kept - 1)).filter("cut >= first_day and cut < last_day")
    items = items.withColumn("_train", F.filter("_days", lambda x: x["date"] <= F.col("cut")))
    return items.select(
        key, "first_day", "cut", "last_day", F.col("_train.date").alias("dates"), F.col("_train.demand").alias("demands"),
        F.filter("_days", lambda x: x["date"] > F.col("cut")).alias("held"),
    )


def held_out(daily: DataFrame, share: float = TRAIN_SHARE, key: str = "medicine_id") -> tuple[DataFrame, DataFrame]:
    """(training days, items): each zero-filled series up to its first ``share`` of days, and where it was cut and ended.

    The training series ends on the day of the cut, with zero demand if nothing was sold then. The days lie in the tasks
    of their items, so that what is computed per item needs no further shuffle of them; ``held`` has the other days.
    """
    series = stored(item_series(daily, share, key), "validation-series")
    rows = spread_by_item(series.select(key, "cut", "dates", "demands"), key)
    pairs = F.arrays_zip(F.concat("dates", F.array("cut")).alias("date"), F.concat("demands", F.array(F.lit(0.0))).alias("demand"))
    days = rows.select(key, F.explode(pairs).alias("_d")).select(key, F.col("_d.date"), F.col("_d.demand"))
    train = days.groupBy(key, "date").agg(F.sum("demand").alias("demand"))
    return train, series.select(key, "first_day", "cut", "last_day", "held")


def models(train: DataFrame, spans: DataFrame, params: Params = Params()) -> list[DataFrame]:
    """Forecasts of every model in long form, a frame for each pass over the series: (medicine_id, model, forecast_date, forecast).

    Those that go through Python, after which Spark has lost where an item lies, come with the columns of ``spans`` beside them.
    """
    # a zero end day is a day of the series, not a selling day
    stats = FC.series_stats(train)
    components = FC.component_forecasts(FC.fit_components(stats, params), params)
    # the first days and the cuts are the ends of all training series
    design = design_of(spans.select(F.explode(F.array("first_day", "cut")).alias("date")))
    columns = ["medicine_id", "model", "forecast_date", "forecast"]
    known = [name for name in HELD if name != "medicine_id"]
    return [
        FC.all_forecasts(components, params).select(*columns),
        autoregressive_forecast(train, params).select(*columns),
        smoothed_forecast(train, params, beside=spans.select(*HELD)).select(*columns, *known),
        change_point_forecast(train, params, beside=spans.select(*HELD), design=design).select(*columns, *known),
        flat_forecast(stats, params).select(*columns),
    ]


def flat_forecast(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """The mean day of the zero-filled series, which a model has to beat."""
    days = stats.select("medicine_id", "last_day", "mean", F.explode(F.sequence(F.lit(1), F.lit(params.horizon))).alias("h"))
    return days.select("medicine_id", F.lit("mean").alias("model"), F.date_add("last_day", F.col("h")).alias("forecast_date"), F.col("mean").alias("forecast"))


def errors(forecasts: DataFrame, daily: DataFrame | None, spans: DataFrame, one_model: bool = False) -> DataFrame:
    """(medicine_id, model, days, mae, rmse, bias) over the held-out days that a forecast covers; days without a sale had none.

    The held-out days are those of ``daily``, or without it the ones that ``spans`` or the forecasts have. They are one row per item,
    so a forecast finds its day without a shuffle of forecasts by day, and frames that lie by item are not shuffled at all.
    Of ``one_model`` the sums are shuffled by item alone, so that the result lies by item too.
    """
    if daily is not None:
        spans = _held(daily, spans)
    if "held" not in forecasts.columns:
        # a short row per item against many; the rows of forecasts need no sort
        forecasts = forecasts.join(spans.select(*HELD).hint("shuffle_hash"), "medicine_id")
    at = F.col("forecast_date")
    sold = F.when(F.array_contains("held.date", at), F.filter("held", lambda x: x["date"] == at))
    asked = forecasts.filter("forecast_date > cut and forecast_date <= last_day")
    asked = asked.select("medicine_id", "model", "forecast", F.explode_outer(sold).alias("_sold"))
    miss = F.col("forecast") - F.coalesce("_sold.demand", F.lit(0.0))
    keys = ["medicine_id"] if one_model else ["medicine_id", "model"]
    found = asked.groupBy(*keys).agg(
        F.min("model").alias("_model"), F.count("*").alias("days"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(miss).alias("bias")
    )
    return found.select("medicine_id", (F.col("_model") if one_model else F.col("model")).alias("model"), "days", "mae", "rmse", "bias")


def _held(daily: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with the days of ``daily`` after the cut."""
    spans = spans.select("medicine_id", "cut", "last_day")
    days = daily.join(spans, "medicine_id").filter("date > cut").groupBy("medicine_id").agg(F.collect_list(F.struct("date", "demand")).alias("held"))
    return spans.join(days, "medicine_id", "left").withColumn("held", F.coalesce("held", F.array()))


def validate(daily: DataFrame, params: Params = Params(), share: float = TRAIN_SHARE) -> DataFrame:
    """Held-out errors of every model and item, and ``best``: the model with the item's least squared error."""
    daily = daily.select("medicine_id", "date", F.col("demand").cast("double").alias("demand"))
    train, spans = held_out(daily, share)
    # those that come beside their days went through Python, with one model each
    per_item = [errors(some, None, spans, "held" in some.columns) for some in models(train, spans, params)]
    rank = F.row_number().over(W.partitionBy("medicine_id").orderBy("rmse", "model"))
    return reduce(DataFrame.union, per_item).withColumn("best", rank == 1)


def validation_report(validated: DataFrame) -> DataFrame:
    """One row per model: items, days, mean errors weighted by days, and how many items it is best for."""
    days = F.sum("days")
    return validated.groupBy("model").agg(
        F.count("*").alias("items"),
        days.alias("days"),
        (F.sum(F.col("mae") * F.col("days")) / days).alias("mae"),
        F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * F.col("days")) / days).alias("rmse"),
        F.count_if("best").alias("best_for"),
    )
