"""Daily demand series and forecasts for all items in one job.

Demand is intermittent: most days of an item have none. The estimators below
are defined on the zero-filled daily series, but they only need sums over it, and
the zero days contribute to those sums through calendar counts that have closed
forms. So one row per item and selling day is shuffled, never one row per
item and calendar day, and everything after the per-item sums is row-local:
component forecasts, ensemble and bounds are array expressions without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.functions import scalars as S
from replenish.operators.aggregates import daily_demand
from replenish.operators.joins import spread_by_item
from replenish.operators.projections import usable_series
from replenish.operators.ranking import top_items
from replenish.params import Params

MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MODELS = ("ensemble", "trend", "additive", "ar", "historical_baseline", "simple_baseline")


def dense_series(daily: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Zero-filled daily series between an item's own first and last day, with calendar features.

    The days up to the next selling day are generated from the row itself, so no grid is joined.
    """
    following = F.lead("date").over(W.partitionBy(key).orderBy("date"))
    stop = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("date"))
    filled = daily.withColumn("_next", following).select(
        key,
        F.explode(F.sequence("date", stop)).alias("_day"),
        F.col("date").alias("_sold"),
        "demand",
    )
    weekday = F.weekday("date")
    return filled.select(
        key, F.col("_day").alias("date"), F.when(F.col("_day") == F.col("_sold"), F.col("demand")).otherwise(0.0).alias("demand")
    ).select(
        "*",
        weekday.alias("day_of_week"),
        F.month("date").alias("month"),
        F.quarter("date").alias("quarter"),
        (weekday >= 5).cast("int").alias("is_weekend"),
    )


def _is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _month_days_until(day: Column, month: int) -> Column:
    """Days of one calendar month from year 0 up to and including ``day`` (differences give spans)."""
    year, at = F.year(day), F.month(day)
    full = F.lit(MONTH_DAYS[month - 1])
    past = year * full
    if month == 2:
        before = year - 1
        past = past + F.floor(before / 4) - F.floor(before / 100) + F.floor(before / 400)
        full = full + _is_leap(year).cast("int")
    return past + F.when(at > month, full).when(at == month, F.dayofmonth(day)).otherwise(0)


def series_stats(daily: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Sufficient statistics of each zero-filled series, from its selling days only.

    One shuffle by item: the adjacent-day products use a window over at most one row per
    day, and the aggregate that follows reuses its partitioning. That shuffle isn't merged by size:
    an item is a few bytes here, and many rows once its days and models are laid out.
    """
    w = W.partitionBy(key).orderBy("date")
    y, day = F.col("demand"), F.unix_date("date").cast("double")
    adjacent = F.when(F.datediff("date", F.lag("date").over(w)) == 1, y * F.lag("demand").over(w)).otherwise(0.0)
    rows = spread_by_item(daily, key).withColumn("_xy", adjacent)
    weekdays = [F.sum(F.when(F.weekday("date") == k, y).otherwise(0.0)) for k in range(7)]
    months = [F.sum(F.when(F.month("date") == m, y).otherwise(0.0)) for m in range(1, 13)]
    sums = rows.groupBy(key).agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count("*").alias("selling_days"),
        F.count_if(y > 0).alias("positive_days"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"),
        F.sum(y * day).alias("sdy"),
        F.sum("_xy").alias("sxy"),
        F.min_by("demand", "date").alias("first_value"),
        F.max_by("demand", "date").alias("last_value"),
        F.avg(y).alias("mean_selling"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std_selling"),
        F.array(*weekdays).alias("wd_sum"),
        F.array(*months).alias("mo_sum"),
    )
    return with_calendar(sums)


def with_calendar(sums: DataFrame) -> DataFrame:
    """Sums over selling days with the counts of all days, which have closed forms, and what follows from both."""
    n = (F.datediff("last_day", "first_day") + 1).cast("double")
    before = F.date_sub("first_day", 1)
    month_days = [(_month_days_until(F.col("last_day"), m) - _month_days_until(before, m)).cast("double") for m in range(1, 13)]
    offsets = [F.pmod(F.lit(k) - F.weekday("first_day"), F.lit(7)).cast("double") for k in range(7)]
    counted = sums.select(
        "*",
        n.alias("n"),
        F.array(*month_days).alias("mo_n"),
        F.array(*offsets).alias("wd_off"),
        F.array(*[F.floor((n - 1 - o) / 7).cast("double") + 1 for o in offsets]).alias("wd_n"),
    ).withColumn("mean", F.col("sy") / F.col("n"))
    variance = F.greatest(F.lit(0.0), F.col("syy") / F.col("n") - F.col("mean") * F.col("mean"))
    return counted.withColumn("std", F.sqrt(variance))


def fit_components(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """Parameters of the three components, one row per item, and which of them the series supports.

    * trend: least squares on the day index plus weekday means of its residuals;
    * ar: first-order autoregression by least squares;
    * additive: mean plus weekday effect plus, from a year of data on, month effect.
    """
    n, sy, mean = F.col("n"), F.col("sy"), F.col("mean")
    s = usable_series(stats, params).select(
        "*",
        (n * (n - 1) / 2).alias("_st"),
        ((n - 1) * n * (2 * n - 1) / 6).alias("_stt"),
        (F.col("sdy") - F.unix_date("first_day").cast("double") * sy).alias("_sty"),
    )
    st, stt = F.col("_st"), F.col("_stt")
    m, sx = n - 1, sy - F.col("last_value")
    sxx = F.col("syy") - F.col("last_value") * F.col("last_value")
    s = s.select(
        "*",
        F.try_divide(n * F.col("_sty") - st * sy, n * stt - st * st).alias("slope"),
        F.try_divide(m * F.col("sxy") - sx * (sy - F.col("first_value")), m * sxx - sx * sx).alias("phi"),
    ).withColumn("intercept", (sy - F.col("slope") * st) / n)

    def weekday_residual(k: int) -> Column:
        count, offset = F.get("wd_n", F.lit(k)), F.get("wd_off", F.lit(k))
        days = count * offset + 7 * count * (count - 1) / 2
        part = F.get("wd_sum", F.lit(k)) - F.col("intercept") * count - F.col("slope") * days
        return F.coalesce(F.try_divide(part, count), F.lit(0.0))

    def effect(kind: str, k: int) -> Column:
        return F.coalesce(F.try_divide(F.get(f"{kind}_sum", F.lit(k)), F.get(f"{kind}_n", F.lit(k))) - mean, F.lit(0.0))

    s = s.select(
        "*",
        F.array(*[weekday_residual(k) for k in range(7)]).alias("wd_res"),
        F.array(*[effect("wd", k) for k in range(7)]).alias("wd_eff"),
        F.array(*[F.when(n >= 365, effect("mo", k)).otherwise(0.0) for k in range(12)]).alias("mo_eff"),
    )

    def explained(kind: str, by: str, size: int) -> Column:
        at = [(F.get(f"{kind}_n", F.lit(k)), F.get(by, F.lit(k))) for k in range(size)]
        return sum((c * e * e for c, e in at), F.lit(0.0))

    spread = F.col("syy") - n * mean * mean
    line = F.col("slope") * F.col("slope") * (stt - st * st / n)
    trend_left = spread - line - explained("wd", "wd_res", 7)
    additive_left = spread - explained("wd", "wd_eff", 7) - explained("mo", "mo_eff", 12)
    return s.select(
        "medicine_id", "first_day", "last_day", "n", "mean", "last_value", "mean_selling", "std_selling",
        "slope", "intercept", "phi", "wd_res", "wd_eff", "mo_eff", "trend_ok", "additive_ok",
        (F.col("ar_ok") & F.col("phi").isNotNull()).alias("ar_ok"),
        F.sqrt(F.greatest(F.lit(0.0), trend_left) / (n - 1)).alias("trend_std"),
        F.sqrt(F.greatest(F.lit(0.0), additive_left) / (n - 1)).alias("additive_std"),
        F.least(F.lit(params.horizon), F.floor(n / 2)).cast("int").alias("trend_steps"),
    )


def component_forecasts(fitted: DataFrame, params: Params = Params()) -> DataFrame:
    """All three forecasts side by side, one row per item and day ahead; NULL where a component is missing.

    The trend covers ``min(horizon, n // 2)`` days and is padded with its last value.
    The days are exploded before anything is computed from them, so the fitted parameters
    are evaluated once per item and the rest is plain arithmetic in generated code.
    """
    z, n = F.lit(params.z), F.col("n")
    days = F.sequence(F.lit(0).cast("bigint"), F.lit(params.horizon - 1).cast("bigint"))
    rows = fitted.select("*", F.explode(days).alias("h")).withColumn(
        "forecast_date", S.forecast_date(F.col("last_day"), F.col("h"))
    )
    at = F.least(F.col("h"), (F.col("trend_steps") - 1).cast("bigint"))
    trend_weekday = F.pmod(F.weekday("last_day") + 1 + at, F.lit(7)).cast("int")
    trend = F.col("intercept") + F.col("slope") * (n + at) + F.get("wd_res", trend_weekday)
    ar = F.col("mean") + F.pow(F.col("phi"), F.col("h") + 1) * (F.col("last_value") - F.col("mean"))
    additive = F.col("mean") + F.get("wd_eff", F.weekday("forecast_date")) + F.get("mo_eff", F.month("forecast_date") - 1)
    rows = rows.select(
        "medicine_id", "last_day", "h", "forecast_date", "trend_steps", "trend_std", "additive_std",
        "mean_selling", "std_selling",
        F.when(F.col("trend_ok"), trend).alias("_trend"),
        F.when(F.col("ar_ok"), S.at_least_zero(ar)).alias("ar"),
        F.when(F.col("additive_ok"), additive).alias("_additive"),
    )

    def floored(value: str, by: Column) -> Column:
        return F.when(F.col(value).isNotNull(), S.at_least_zero(F.col(value) + by))

    zt, za = z * F.col("trend_std"), z * F.col("additive_std")
    return rows.select(
        "medicine_id", "last_day", "h", "forecast_date", "trend_steps", "mean_selling", "std_selling", "ar",
        floored("_trend", F.lit(0.0)).alias("trend"),
        floored("_trend", -zt).alias("trend_lo"),
        floored("_trend", zt).alias("trend_hi"),
        floored("_additive", F.lit(0.0)).alias("additive"),
        floored("_additive", -za).alias("additive_lo"),
        floored("_additive", za).alias("additive_hi"),
    )


def _long(rows: DataFrame, model: str, confidence: float, value: Column, lower: Column, upper: Column, width: Column) -> DataFrame:
    return rows.filter(value.isNotNull()).select(
        "medicine_id",
        F.lit(model).alias("model"),
        F.lit(confidence).alias("confidence"),
        "h",
        "forecast_date",
        value.alias("forecast"),
        lower.alias("lower"),
        upper.alias("upper"),
        width.alias("uncertainty"),
    )


def trend_forecast(components: DataFrame, params: Params = Params()) -> DataFrame:
    """Long trend forecast, only for the days it really covers (no padding)."""
    lo, hi = F.col("trend_lo"), F.col("trend_hi")
    own = components.filter(F.col("h") < F.col("trend_steps"))
    return _long(own, "trend", params.confidence, F.col("trend"), lo, hi, hi - lo)


def additive_forecast(components: DataFrame, params: Params = Params()) -> DataFrame:
    lo, hi = F.col("additive_lo"), F.col("additive_hi")
    return _long(components, "additive", params.confidence, F.col("additive"), lo, hi, hi - lo)


def _ar_spread() -> Column:
    """Deviation of an item's own autoregressive vector (at most ``horizon`` rows per item)."""
    return F.stddev_pop("ar").over(W.partitionBy("medicine_id"))


def ar_forecast(components: DataFrame, params: Params = Params()) -> DataFrame:
    """Long autoregressive forecast; its uncertainty is the deviation of its own forecast vector."""
    rows = components.filter(F.col("ar").isNotNull()).withColumn("_sd", _ar_spread())
    f, sd = F.col("ar"), F.col("_sd")
    return _long(rows, "ar", params.confidence, f, f - 1.96 * sd, f + 1.96 * sd, sd)


def ensemble_columns(components: DataFrame, params: Params = Params()) -> DataFrame:
    """Adds the weighted mean over the components present, and bounds from those that have them."""
    weights = {"trend": params.trend_weight, "ar": params.ar_weight, "additive": params.additive_weight}
    present = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    rows = components.withColumn("ensemble", F.when(present > 0, value / present)).withColumn(
        "_ar_sd", F.lit(1.96) * _ar_spread()
    )

    def bound(kind: str, sign: int) -> Column:
        trend, additive = F.col(f"trend_{kind}"), F.col(f"additive_{kind}")
        both = (trend + additive) / 2
        return F.coalesce(both, trend, additive, F.col("ensemble") + sign * F.col("_ar_sd"))

    return (
        rows.withColumn("ensemble_lo", F.when(F.col("ensemble").isNotNull(), S.at_least_zero(bound("lo", -1))))
        .withColumn("ensemble_hi", bound("hi", 1))
        .drop("_ar_sd")
    )


def ensemble_forecast(components: DataFrame, params: Params = Params()) -> DataFrame:
    rows = ensemble_columns(components, params)
    lo, hi = F.col("ensemble_lo"), F.col("ensemble_hi")
    return _long(rows, "ensemble", params.confidence, F.col("ensemble"), lo, hi, hi - lo)


def all_forecasts(components: DataFrame, params: Params = Params()) -> DataFrame:
    """Every available forecast of every item and day in long form, from one pass over the components."""
    rows = ensemble_columns(components.withColumn("_sd", _ar_spread()), params).withColumn("_v", _baseline_value())
    v, sd, ar, ar_sd = F.col("_v"), F.col("std_selling"), F.col("ar"), F.col("_sd")

    def entry(model: str, confidence: float, keep: Column, value: Column, lower: Column, upper: Column, width: Column) -> Column:
        fields = F.struct(
            F.lit(model).alias("model"),
            F.lit(confidence).alias("confidence"),
            value.alias("forecast"),
            lower.alias("lower"),
            upper.alias("upper"),
            width.alias("uncertainty"),
        )
        return F.when(keep & value.isNotNull(), fields)

    def interval(model: str, keep: Column = F.lit(True)) -> Column:
        lo, hi = F.col(f"{model}_lo"), F.col(f"{model}_hi")
        return entry(model, params.confidence, keep, F.col(model), lo, hi, hi - lo)

    everything = F.array(
        interval("trend", F.col("h") < F.col("trend_steps")),
        entry("ar", params.confidence, F.lit(True), ar, ar - 1.96 * ar_sd, ar + 1.96 * ar_sd, ar_sd),
        interval("additive"),
        interval("ensemble"),
        entry(
            "historical_baseline", 0.80, F.lit(True), S.at_least_zero(v), S.at_least_zero(v - 1.96 * sd), v + 1.96 * sd, sd
        ),
    )
    return rows.select("medicine_id", "h", "forecast_date", F.explode(F.array_compact(everything)).alias("_e")).select(
        "medicine_id", "h", "forecast_date", "_e.*"
    )


def combine_forecasts(forecasts: DataFrame, params: Params = Params()) -> DataFrame:
    """Weighted mean per item and day of any padded long component forecasts ``(model, h, forecast)``."""
    weight = (
        F.when(F.col("model") == "trend", params.trend_weight)
        .when(F.col("model") == "ar", params.ar_weight)
        .when(F.col("model") == "additive", params.additive_weight)
    )
    return forecasts.groupBy("medicine_id", "h").agg(
        (F.sum(weight * F.col("forecast")) / F.sum(weight)).alias("forecast"), F.count("*").alias("components")
    )


def demand_stats(daily: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Mean and sample deviation of selling-day demand only (all the baseline needs)."""
    return daily.groupBy(key).agg(
        F.max("date").alias("last_day"),
        F.count("*").alias("selling_days"),
        F.avg("demand").alias("mean_selling"),
        F.coalesce(F.stddev_samp("demand"), F.lit(0.0)).alias("std_selling"),
    )


def _baseline_value() -> Column:
    return F.col("mean_selling") + S.sine_season(F.col("mean_selling"), F.col("h"))


def baseline_forecast(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """Mean selling-day demand with a weekly sine; needs the per-item ``demand_stats``."""
    days = F.sequence(F.lit(0).cast("bigint"), F.lit(params.horizon - 1).cast("bigint"))
    rows = stats.select("medicine_id", "last_day", "mean_selling", "std_selling", F.explode(days).alias("h"))
    rows = rows.withColumn("_v", _baseline_value()).withColumn(
        "forecast_date", S.forecast_date(F.col("last_day"), F.col("h"))
    )
    v, sd = F.col("_v"), F.col("std_selling")
    return _long(
        rows, "historical_baseline", 0.80, S.at_least_zero(v), S.at_least_zero(v - 1.96 * sd), v + 1.96 * sd, sd
    )


def baseline_vectors(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """The baseline as one row per item with ``forecast`` and ``uncertainty`` arrays, without exploding days."""
    days = F.sequence(F.lit(0), F.lit(params.horizon - 1))
    value = F.transform(
        days, lambda h: S.at_least_zero(F.col("mean_selling") + S.sine_season(F.col("mean_selling"), h))
    )
    return stats.select(
        "medicine_id", value.alias("forecast"), F.array_repeat("std_selling", params.horizon).alias("uncertainty")
    )


def forecast_vectors(forecasts: DataFrame) -> DataFrame:
    """Long forecasts as one row per item with arrays in day order (``horizon`` values each)."""
    days = F.sort_array(F.collect_list(F.struct("h", "forecast", "uncertainty")))
    return forecasts.groupBy("medicine_id").agg(days.alias("_d")).select(
        "medicine_id", F.col("_d.forecast").alias("forecast"), F.col("_d.uncertainty").alias("uncertainty")
    )


def constant_forecast(items: DataFrame, params: Params = Params()) -> DataFrame:
    """Fixed forecast for items nothing else resolves."""
    return items.select(
        "medicine_id",
        F.lit("simple_baseline").alias("model"),
        F.lit(0.50).alias("confidence"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(params.horizon - 1).cast("bigint"))).alias("h"),
        F.lit(10.0).alias("forecast"),
        F.lit(5.0).alias("lower"),
        F.lit(15.0).alias("upper"),
        F.lit(2.5).alias("uncertainty"),
    )


def best_forecast(components: DataFrame, params: Params = Params()) -> DataFrame:
    """Ensemble where any component exists, else the historical baseline; row-local."""
    rows = ensemble_columns(components, params).withColumn("_v", _baseline_value())
    has, v, sd = F.col("ensemble").isNotNull(), F.col("_v"), F.col("std_selling")
    return rows.select(
        "medicine_id",
        F.when(has, "ensemble").otherwise("historical_baseline").alias("model"),
        F.when(has, params.confidence).otherwise(0.80).alias("confidence"),
        "h",
        "forecast_date",
        F.coalesce("ensemble", S.at_least_zero(v)).alias("forecast"),
        F.coalesce("ensemble_lo", S.at_least_zero(v - 1.96 * sd)).alias("lower"),
        F.coalesce("ensemble_hi", v + 1.96 * sd).alias("upper"),
        F.coalesce(F.col("ensemble_hi") - F.col("ensemble_lo"), sd).alias("uncertainty"),
    )


def pick_model(candidates: DataFrame) -> DataFrame:
    """Best candidate per item and day from any long forecasts, by model order, combined map-side."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    best = F.min_by(F.struct("model", "confidence", "forecast", "lower", "upper", "uncertainty"), rank)
    return candidates.groupBy("medicine_id", "h").agg(best.alias("_b")).select("medicine_id", "h", "_b.*")


def available_models(fitted: DataFrame) -> DataFrame:
    """Which components exist per item, as text in a fixed order."""
    names = F.concat_ws(
        ",",
        F.when(F.col("trend_ok"), "trend"),
        F.when(F.col("ar_ok"), "ar"),
        F.when(F.col("additive_ok"), "additive"),
        F.when(_any_model(), "ensemble"),
    )
    return fitted.select("medicine_id", names.alias("models"), _any_model().alias("trained"))


def _any_model() -> Column:
    return F.col("trend_ok") | F.col("ar_ok") | F.col("additive_ok")


def train_top(rx: DataFrame, top_n: int, params: Params = Params()) -> DataFrame:
    """Fitted components of the ``top_n`` items by demand: one series pass for all of them."""
    chosen = F.broadcast(top_items(rx, top_n).select("medicine_id"))  # top_n rows
    return fit_components(series_stats(daily_demand(rx.join(chosen, "medicine_id", "left_semi"))), params)


def training_report(fitted: DataFrame) -> DataFrame:
    return fitted.agg(
        F.count("*").alias("items"), F.count_if(_any_model()).alias("trained"), F.count_if(~_any_model()).alias("failed")
    )
