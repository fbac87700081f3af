"""Windows, demand series, forecasts and intervals over the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from replenish.operators import additive as AD
from replenish.operators import aggregates as A
from replenish.operators import autoregression as AR
from replenish.operators import forecast as FC
from replenish.operators import joins as J
from replenish.operators import projections as P
from replenish.operators import quantiles as QR
from replenish.operators import ranking as R
from replenish.operators import series_state as SS
from replenish.operators import smoothing as SM
from replenish.operators import uncertainty as U
from replenish.operators import validation as VA
from replenish.operators import windows as W
from replenish.params import Params
from replenish.plans import inputs  # noqa: F401
from replenish.plans.basics import u_sql
from replenish.plans.registry import common, query
from replenish.plans.tidy import big, day, r, sql_ts, ts
from replenish.session import scratch_path, stored
from replenish.sources import history as H
from replenish.sources import tables as T

HOUR, QUARTER_HOUR = 3600, 900
Z95 = "1.959963984540054"

# ---------------------------------------------------------------- time windows

STATS_SQL = """count(*) AS "count", round(sum(quantity), 4) AS sum, round(avg(quantity), 6) AS mean, round(median(quantity), 4) AS median,
       round(stddev_pop(quantity), 4) AS std, min(quantity) AS min, max(quantity) AS max"""


def _stats(df):
    return df.select(
        "medicine_id", ts("window_start"), "count", r("sum"), r("mean", 6), r("median"), r("std"), "min", "max"
    )


@query(
    "agg5_tumbling_stats",
    f"""SELECT medicine_id, {sql_ts("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, {STATS_SQL} FROM ev GROUP BY 1, 2""",
    ("ev",),
)
def agg5(spark, d):
    return _stats(W.window_stats(T.event_history(spark, d), HOUR))


@query(
    "str2_hopping_stats_batch",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, {STATS_SQL} FROM (
        SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS w FROM ev, (SELECT unnest(range(4)) AS k)) GROUP BY 1, 2""",
    ("ev",),
)
def str2_batch(spark, d):
    return _stats(W.window_stats(T.event_history(spark, d), HOUR, QUARTER_HOUR))


@query(
    "agg6_9_window_features",
    f"""SELECT medicine_id, {sql_ts("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, count(*) AS "count",
        round(avg(CAST(is_emergency AS INT)), 6) AS emergency_rate, round(count(*) / 1.0 * (1 + avg(CAST(is_emergency AS INT))), 4) AS necessity_score,
        count(DISTINCT location) AS location_diversity, round(avg(patient_age), 4) AS avg_patient_age, round(stddev_pop(patient_age), 4) AS age_std
        FROM (SELECT * REPLACE (user_id AS medicine_id) FROM ev) GROUP BY 1, 2""",
    ("ev",),
)
def agg6_9(spark, d):
    f = W.window_features(T.event_history(spark, d, "user_id"), HOUR)
    return f.select(
        "medicine_id", ts("window_start"), "count", r("emergency_rate", 6), r("necessity_score"),
        "location_diversity", r("avg_patient_age"), r("age_std"),
    )


@query(
    "agg10_hour_histogram",
    f"""SELECT medicine_id, {sql_ts("time_bucket(INTERVAL 1 DAY, ts)")} AS window_start, hour_of_day, count(*) AS n FROM ev GROUP BY 1, 2, 3""",
    ("ev",),
)
def agg10(spark, d):
    return W.hour_histogram(T.event_history(spark, d), 86400).withColumn("window_start", ts("window_start"))


@query(
    "agg10_hour_map",
    """SELECT medicine_id, CAST(map_keys(m) AS VARCHAR) AS hours, CAST(map_values(m) AS VARCHAR) AS counts FROM (
       SELECT medicine_id, map_from_entries(list((hour_of_day, n) ORDER BY hour_of_day)) AS m FROM (
         SELECT medicine_id, hour_of_day, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1)""",
    ("ev",),
)
def agg10_map(spark, d):
    m = A.histogram_map(T.event_history(spark, d), "hour_of_day", "medicine_id")
    col = F.col("hour_of_day_distribution")
    return m.select(
        "medicine_id", F.map_keys(col).cast("string").alias("hours"), F.map_values(col).cast("string").alias("counts")
    )


@query(
    "win1_sliding_per_event",
    f"""SELECT DISTINCT medicine_id, {sql_ts("ts")} AS "timestamp", count(*) OVER w AS "count", round(sum(quantity) OVER w, 4) AS sum,
        round(avg(quantity) OVER w, 6) AS mean, round(stddev_pop(quantity) OVER w, 4) AS std, min(quantity) OVER w AS min, max(quantity) OVER w AS max
        FROM ev WINDOW w AS (PARTITION BY medicine_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
    ("ev",),
)
def win1(spark, d):
    s = W.sliding_stats(T.event_history(spark, d), HOUR)
    return s.select("medicine_id", ts("timestamp"), "count", r("sum"), r("mean", 6), r("std"), "min", "max")


@query(
    "str3_sessions_batch",
    f"""SELECT medicine_id, {sql_ts("min(ts)")} AS session_start, {sql_ts("max(ts)")} AS session_end,
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS session_duration, count(*) AS "count", round(sum(quantity), 4) AS sum, round(avg(quantity), 6) AS mean
        FROM (SELECT *, sum(opens) OVER (PARTITION BY medicine_id ORDER BY ts, prescription_id) AS sid FROM (
              SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY medicine_id ORDER BY ts, prescription_id) <= 900e6 THEN 0 ELSE 1 END AS opens FROM ev))
        GROUP BY medicine_id, sid""",
    ("ev",),
)
def str3_batch(spark, d):
    s = W.session_stats(T.event_history(spark, d), QUARTER_HOUR)
    return s.select(
        "medicine_id", ts("session_start"), ts("session_end"), r("session_duration", 6), "count", r("sum"), r("mean", 6)
    )


@query(
    "win2_arrival_gaps",
    """SELECT medicine_id, count(*) AS "count", round(avg(g), 4) AS avg_inter_arrival_time, round(stddev_pop(g), 4) AS std_inter_arrival_time FROM (
       SELECT medicine_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY medicine_id ORDER BY ts)) / 1e6 AS g
       FROM (SELECT * REPLACE (user_id AS medicine_id) FROM ev)) GROUP BY 1""",
    ("ev",),
)
def win2(spark, d):
    g = W.arrival_gaps(T.event_history(spark, d, "user_id"))
    return g.select("medicine_id", "count", r("avg_inter_arrival_time"), r("std_inter_arrival_time"))


def _rolling_sql(n: int) -> str:
    w = f"OVER (PARTITION BY medicine_id ORDER BY ts, prescription_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return ", ".join(
        f"CASE WHEN rn >= {n} THEN round({f}(quantity) {w}, 4) END AS rolling_{a}_{n}"
        for f, a in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min"))
    )


@query(
    "win3_rolling_features",
    f"""SELECT prescription_id, {_rolling_sql(5)}, {_rolling_sql(10)}, {_rolling_sql(20)} FROM (
        SELECT *, row_number() OVER (PARTITION BY medicine_id ORDER BY ts, prescription_id) AS rn FROM ev)""",
    ("ev",),
)
def win3(spark, d):
    rx = T.event_history(spark, d).select("prescription_id", "medicine_id", "timestamp", "quantity")
    out = W.rolling_features(rx, [F.col("prescription_id")])
    names = [c for c in out.columns if c.startswith("rolling_")]
    return out.select("prescription_id", *[r(c) for c in names])


# ---------------------------------------------------------------- daily series windows


@query(
    "win4_moving_average",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(*) OVER (PARTITION BY medicine_id) < 7 THEN demand
       ELSE avg(demand) OVER (PARTITION BY medicine_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 4) AS moving_average FROM daily""",
    ("daily",),
)
def win4(spark, d):
    m = W.moving_average(A.daily_demand(T.dispensing(spark, d)))
    return m.select("medicine_id", day("date"), r("moving_average"))


@query(
    "win5_first_crossing",
    """SELECT medicine_id, min(h) AS crossing_day, round(arg_min(cum - inv, h), 4) AS overshoot FROM (
       SELECT base.medicine_id, h, current_inventory * 0.5 AS inv, sum(forecast) OVER (PARTITION BY base.medicine_id ORDER BY h) AS cum
       FROM base JOIN stock ON stock.medicine_id = base.medicine_id) WHERE cum > inv GROUP BY 1""",
    ("base", "stock"),
)
def win5(spark, d):
    """First day of the baseline forecast on which half of today's stock is used up."""
    stats = FC.demand_stats(A.daily_demand(T.dispensing(spark, d)))
    path = FC.baseline_forecast(stats).select("medicine_id", "h", F.col("forecast").alias("demand"))
    half = T.stock_levels(spark, d).select("medicine_id", (F.col("current_inventory") * 0.5).alias("current_inventory"))
    return W.first_crossing(path.join(half, "medicine_id")).select("medicine_id", "crossing_day", r("overshoot"))


CHANGE_SQL = "SELECT *, CASE WHEN location = 'R' THEN quantity ELSE -quantity END AS delta FROM disp"
common("change", CHANGE_SQL, "disp")


@query(
    "win6_running_stock",
    """SELECT medicine_id, basket_id, line, delta, round(s - least(0, min(s) OVER (PARTITION BY medicine_id ORDER BY ts, basket_id, line, delta ROWS UNBOUNDED PRECEDING)), 4) AS stock_after
       FROM (SELECT change.*, current_inventory * 0.1 + sum(delta) OVER (PARTITION BY change.medicine_id ORDER BY ts, basket_id, line, delta ROWS UNBOUNDED PRECEDING) AS s
             FROM change JOIN stock ON stock.medicine_id = change.medicine_id)""",
    ("change", "stock"),
)
def win6(spark, d):
    """Every change of an item in order, returns adding stock; starting low so that the clamp at zero is exercised."""
    rx = T.dispensing(spark, d)
    changes = rx.select(
        "medicine_id", "timestamp", "basket_id", "line",
        F.when(F.col("location") == "R", F.col("quantity")).otherwise(-F.col("quantity")).alias("delta"),
    )
    start = T.stock_levels(spark, d).select("medicine_id", (F.col("current_inventory") * 0.1).alias("current_inventory"))
    walk = W.stock_walk(changes, start, [F.col("basket_id"), F.col("line"), F.col("delta")])
    return walk.select("medicine_id", "basket_id", "line", "delta", r("stock_after"))


@query(
    "win7_threshold_crossing",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, round(before_q, 4) AS stock_before, round(after_q, 4) AS stock_after FROM (
       SELECT daily.medicine_id, date, reorder_point, total_dispensed - sum(demand) OVER w AS after_q, total_dispensed - sum(demand) OVER w + demand AS before_q
       FROM daily JOIN stock ON stock.medicine_id = daily.medicine_id WINDOW w AS (PARTITION BY daily.medicine_id ORDER BY date))
       WHERE before_q >= reorder_point AND after_q < reorder_point""",
    ("daily", "stock"),
)
def win7(spark, d):
    """Days on which a stock that started at the item's whole demand fell below its reorder point."""
    start = T.stock_levels(spark, d).withColumn("current_inventory", F.col("total_dispensed"))
    c = W.threshold_crossings(A.daily_demand(T.dispensing(spark, d)), start)
    return c.select("medicine_id", day("date"), r("stock_before"), r("stock_after"))


@query(
    "win8_lag_matrix",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, round(f[1], 4) AS oldest, round(f[14], 4) AS newest, round(list_sum(f), 4) AS total, round(demand, 4) AS target FROM (
       SELECT *, list(demand) OVER (PARTITION BY medicine_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS f FROM evdense) WHERE len(f) = 14""",
    ("evdense",),
)
def win8(spark, d):
    dense = FC.dense_series(A.daily_demand(T.event_history(spark, d, "user_id")))
    m = W.lag_matrix(dense)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return m.select(
        "medicine_id", day("date"), r(F.get("features", F.lit(0)), name="oldest"), r(F.get("features", F.lit(13)), name="newest"),
        r(total, name="total"), r("target"),
    )


@query(
    "win9_scaling",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, round(coalesce((demand - m) / nullif(s, 0), 0), 6) + 0.0 AS standard,
       round(coalesce((demand - lo) / nullif(hi - lo, 0), 0), 6) AS minmax, demand AS from_standard, demand AS from_minmax FROM (
       SELECT *, avg(demand) OVER w AS m, stddev_pop(demand) OVER w AS s, min(demand) OVER w AS lo, max(demand) OVER w AS hi FROM daily WINDOW w AS (PARTITION BY medicine_id))""",
    ("daily",),
)
def win9(spark, d):
    s = W.unscaled(W.scaled(A.daily_demand(T.dispensing(spark, d))))
    return s.select("medicine_id", day("date"), r("standard", 6), r("minmax", 6), r("from_standard"), r("from_minmax"))


@query(
    "win11_cumulative_counts",
    """SELECT medicine_id, n, CAST(sum(n) OVER (ORDER BY md5(CAST(medicine_id AS VARCHAR))) AS BIGINT) - n AS lo, CAST(sum(n) OVER (ORDER BY md5(CAST(medicine_id AS VARCHAR))) AS BIGINT) AS hi
       FROM (SELECT medicine_id, count(*) AS n FROM disp GROUP BY 1)""",
    ("disp",),
)
def win11(spark, d):
    counts = T.dispensing(spark, d).groupBy("medicine_id").agg(F.count("*").alias("n"))
    return W.cumulative_counts(counts, "medicine_id")


@query(
    "win12_ordered_split",
    """SELECT prescription_id, rn - 1 AS position, CASE WHEN rn - 1 < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM (
       SELECT prescription_id, row_number() OVER (ORDER BY ts, prescription_id) AS rn, count(*) OVER () AS n FROM ev)""",
    ("ev",),
)
def win12(spark, d):
    rx = T.event_history(spark, d).select("prescription_id", "timestamp")
    return R.ordered_split(rx, [F.asc("timestamp"), F.asc("prescription_id")]).select("prescription_id", "position", "split")


@query(
    "win13_series_split",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM (
       SELECT medicine_id, date, row_number() OVER (PARTITION BY medicine_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY medicine_id) AS n FROM daily)""",
    ("daily",),
)
def win13(spark, d):
    return W.series_split(A.daily_demand(T.dispensing(spark, d))).select("medicine_id", day("date"), "split")


# ---------------------------------------------------------------- series and forecasts

common(
    "cal",
    """SELECT *, date_diff('day', min(date) OVER (PARTITION BY medicine_id), date) AS t, isodow(date) - 1 AS wd, month(date) AS mo FROM dense""",
    "dense",
)
common(
    "fit",
    """SELECT medicine_id, count(*) AS n, min(date) AS first_day, max(date) AS last_day, avg(demand) AS mean, stddev_pop(demand) AS std,
       sum(CASE WHEN demand > 0 THEN 1 ELSE 0 END) AS positive, regr_slope(demand, t) AS b, regr_intercept(demand, t) AS a, arg_max(demand, date) AS last_value
       FROM cal GROUP BY 1""",
    "cal",
)
common(
    "resid",
    """SELECT cal.*, n, mean, demand - (a + b * cal.t) AS e FROM cal JOIN fit ON fit.medicine_id = cal.medicine_id""",
    "cal",
    "fit",
)
common(
    "wdres",
    "SELECT medicine_id, wd, avg(e) AS s, avg(demand) - any_value(mean) AS eff, count(*) AS c FROM resid GROUP BY 1, 2",
    "resid",
)
common(
    "moeff",
    """SELECT medicine_id, mo, CASE WHEN any_value(n) >= 365 THEN avg(demand) - any_value(mean) ELSE 0 END AS eff, count(*) AS c FROM resid GROUP BY 1, 2""",
    "resid",
)
common(
    "sds",
    """SELECT r.medicine_id, stddev_samp(r.e - w.s) AS trend_std FROM resid r JOIN wdres w ON w.medicine_id = r.medicine_id AND w.wd = r.wd GROUP BY 1""",
    "resid",
    "wdres",
)
common(
    "addsd",
    """SELECT f.medicine_id, sqrt(greatest(0, (f.n * f.std * f.std - w.x - m.x) / (f.n - 1))) AS add_std FROM fit f
       JOIN (SELECT medicine_id, sum(c * eff * eff) AS x FROM wdres GROUP BY 1) w ON w.medicine_id = f.medicine_id
       JOIN (SELECT medicine_id, sum(c * eff * eff) AS x FROM moeff GROUP BY 1) m ON m.medicine_id = f.medicine_id""",
    "fit",
    "wdres",
    "moeff",
)
common(
    "ar1",
    """SELECT medicine_id, regr_slope(demand, prev) AS phi FROM (
       SELECT medicine_id, demand, lag(demand) OVER (PARTITION BY medicine_id ORDER BY date) AS prev FROM dense) WHERE prev IS NOT NULL GROUP BY 1""",
    "dense",
)
common(
    "trend",
    f"""SELECT g.medicine_id, g.h, CAST(g.h < steps AS BOOLEAN) AS own, greatest(0, v) AS forecast, greatest(0, v - {Z95} * trend_std) AS lower_q, greatest(0, v + {Z95} * trend_std) AS upper_q FROM (
        SELECT f.medicine_id, h, steps, f.a + f.b * (f.n + hh) + coalesce(w.s, 0) AS v FROM (
          SELECT fit.*, h, least(30, n // 2) AS steps, least(h, least(30, n // 2) - 1) AS hh FROM fit, (SELECT unnest(range(30)) AS h) WHERE n >= 14 AND std >= 0.1) f
        LEFT JOIN wdres w ON w.medicine_id = f.medicine_id AND w.wd = (isodow(f.last_day) + hh) % 7) g JOIN sds ON sds.medicine_id = g.medicine_id""",
    "fit",
    "wdres",
    "sds",
)
common(
    "ar",
    """SELECT fit.medicine_id, h, greatest(0, mean + power(phi, h + 1) * (last_value - mean)) AS forecast
       FROM fit JOIN ar1 ON ar1.medicine_id = fit.medicine_id, (SELECT unnest(range(30)) AS h) WHERE n >= 64 AND std >= 0.1 AND phi IS NOT NULL""",
    "fit",
    "ar1",
)
common(
    "additive",
    f"""SELECT g.medicine_id, g.h, greatest(0, v) AS forecast, greatest(0, v - {Z95} * add_std) AS lower_q, greatest(0, v + {Z95} * add_std) AS upper_q FROM (
        SELECT f.medicine_id, h, f.mean + coalesce(w.eff, 0) + coalesce(m.eff, 0) AS v FROM (
          SELECT fit.*, h, last_day + CAST(h + 1 AS INT) AS fd FROM fit, (SELECT unnest(range(30)) AS h) WHERE n >= 14 AND positive >= 2) f
        LEFT JOIN wdres w ON w.medicine_id = f.medicine_id AND w.wd = isodow(f.fd) - 1
        LEFT JOIN moeff m ON m.medicine_id = f.medicine_id AND m.mo = month(f.fd)) g JOIN addsd ON addsd.medicine_id = g.medicine_id""",
    "fit",
    "wdres",
    "moeff",
    "addsd",
)
common(
    "ens",
    """SELECT medicine_id, h, (coalesce(0.3 * tf, 0) + coalesce(0.4 * rf, 0) + coalesce(0.3 * af, 0)) / w AS forecast,
       greatest(0, CASE WHEN tf IS NOT NULL AND af IS NOT NULL THEN (tl + al) / 2 WHEN tf IS NOT NULL THEN tl WHEN af IS NOT NULL THEN al ELSE rf * 0.4 / w - 1.96 * rsd END) AS lower_q,
       CASE WHEN tf IS NOT NULL AND af IS NOT NULL THEN (tu + au) / 2 WHEN tf IS NOT NULL THEN tu WHEN af IS NOT NULL THEN au ELSE rf * 0.4 / w + 1.96 * rsd END AS upper_q
       FROM (SELECT k.medicine_id, k.h, t.forecast AS tf, t.lower_q AS tl, t.upper_q AS tu, ar.forecast AS rf, additive.forecast AS af, additive.lower_q AS al, additive.upper_q AS au,
               stddev_pop(ar.forecast) OVER (PARTITION BY k.medicine_id) AS rsd,
               (CASE WHEN t.forecast IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN ar.forecast IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN additive.forecast IS NOT NULL THEN 0.3 ELSE 0 END)::DOUBLE AS w
             FROM (SELECT medicine_id, h FROM fit, (SELECT unnest(range(30)) AS h)) k
             LEFT JOIN trend t ON t.medicine_id = k.medicine_id AND t.h = k.h LEFT JOIN ar ON ar.medicine_id = k.medicine_id AND ar.h = k.h
             LEFT JOIN additive ON additive.medicine_id = k.medicine_id AND additive.h = k.h) WHERE w > 0""",
    "fit",
    "trend",
    "ar",
    "additive",
)


def fitted(spark, d, params: Params = Params()):
    return FC.fit_components(FC.series_stats(A.daily_demand(T.dispensing(spark, d))), params)


def components(spark, d, params: Params = Params()):
    return FC.component_forecasts(fitted(spark, d, params), params)


@query(
    "fc1_dense_series",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, round(demand, 4) AS demand, (isodow(date) - 1)::INT AS day_of_week, month(date)::INT AS month,
       quarter(date)::INT AS quarter, CAST(isodow(date) >= 6 AS INT) AS is_weekend FROM evdense""",
    ("evdense",),
)
def fc1(spark, d):
    dense = FC.dense_series(A.daily_demand(T.event_history(spark, d, "user_id")))
    return dense.withColumn("date", day("date")).withColumn("demand", r("demand"))


@query(
    "prj11_usable_series",
    """SELECT medicine_id, n, round(std, 4) AS std, std >= 0.1 AND n >= 14 AS trend_ok, std >= 0.1 AND n >= 64 AS ar_ok, n >= 14 AND positive >= 2 AS additive_ok FROM fit""",
    ("fit",),
)
def prj11(spark, d):
    stats = FC.series_stats(A.daily_demand(T.dispensing(spark, d)))
    return P.usable_series(stats).select("medicine_id", big("n"), r("std"), "trend_ok", "ar_ok", "additive_ok")


@query(
    "fc2_trend",
    "SELECT medicine_id, h, round(forecast, 3) AS forecast, round(lower_q, 3) AS lower, round(upper_q, 3) AS upper FROM trend WHERE own",
    ("trend",),
)
def fc2(spark, d):
    return FC.trend_forecast(components(spark, d)).select("medicine_id", "h", r("forecast", 3), r("lower", 3), r("upper", 3))


@query("fc3_autoregressive", "SELECT medicine_id, h, round(forecast, 3) AS forecast FROM ar", ("ar",))
def fc3(spark, d):
    return FC.ar_forecast(components(spark, d)).select("medicine_id", "h", r("forecast", 3))


LAGS = 14
common(
    "lags",
    """WITH s AS (SELECT medicine_id, min(date) AS first, max(date) AS last, sum(demand) AS total, date_diff('day', min(date), max(date)) + 1 AS n FROM daily GROUP BY 1),
       k AS (SELECT unnest(range(0, 15)) AS k),
       pairs AS (SELECT a.medicine_id, date_diff('day', b.date, a.date) AS k, sum(a.demand * b.demand) AS p FROM daily a JOIN daily b
                 ON b.medicine_id = a.medicine_id AND b.date BETWEEN a.date - INTERVAL 14 DAY AND a.date GROUP BY 1, 2),
       cut AS (SELECT d.medicine_id, k.k, sum(CASE WHEN date_diff('day', first, date) >= k.k THEN demand ELSE 0 END) + sum(CASE WHEN date_diff('day', date, last) >= k.k THEN demand ELSE 0 END) AS both_sides
               FROM daily d JOIN s ON s.medicine_id = d.medicine_id, k GROUP BY 1, 2)
       SELECT s.medicine_id, k.k AS lag, n, CASE WHEN n > k.k THEN (coalesce(p, 0) - total / n * both_sides + (n - k.k) * (total / n) * (total / n)) / n ELSE 0 END AS cov
       FROM s, k LEFT JOIN pairs ON pairs.medicine_id = s.medicine_id AND pairs.k = k.k JOIN cut ON cut.medicine_id = s.medicine_id AND cut.k = k.k""",
    "daily",
)


@query("fc3_lag_covariances", "SELECT medicine_id, lag, round(cov, 4) AS cov FROM lags", ("lags",))
def fc3_lags(spark, d):
    sums = AR.lag_sums(A.daily_demand(T.dispensing(spark, d)), LAGS)
    return sums.select("medicine_id", F.posexplode("cov").alias("lag", "cov")).select("medicine_id", F.col("lag").cast("bigint").alias("lag"), r("cov"))


@query("fc3_two_week_autoregression")
def fc3_two_weeks(spark, d):
    """Recursive forecasts from 14 lags."""
    f = AR.autoregressive_forecast(A.daily_demand(T.dispensing(spark, d)))
    return f.select("medicine_id", "h", r("forecast", 3), r("lower", 3), r("upper", 3))


@query("fc2_seasonal_smoothing")
def fc2_smoothing(spark, d):
    """Forecasts by a damped trend and weekly season, settings chosen per item."""
    f = SM.smoothed_forecast(A.daily_demand(T.dispensing(spark, d)))
    return f.select("medicine_id", "h", r("forecast", 3), r("lower", 3), r("upper", 3))


@query(
    "fc4_design_sums",
    """SELECT medicine_id, round(sum(demand), 3) AS flat, round(sum(demand * date_diff('day', (SELECT min(date) FROM daily), date) / 365.25), 3) AS time,
       round(sum(demand * greatest(0, date_diff('day', (SELECT min(date) FROM daily), date) / 365.25 - 0.8 * (SELECT date_diff('day', min(date), max(date)) + 1 FROM daily) / 365.25 / 13)), 3) AS first_hinge,
       round(sum(demand * sin(2 * pi() / 7 * date_diff('day', (SELECT min(date) FROM daily), date))), 3) AS week_sine,
       round(sum(demand * cos(6 * pi() / 365.25 * date_diff('day', (SELECT min(date) FROM daily), date))), 3) AS third_year_cosine FROM daily GROUP BY 1""",
    ("daily",),
)
def fc4_sums(spark, d):
    daily = A.daily_demand(T.dispensing(spark, d))
    sums = AD.design_sums(daily, AD.design_of(daily))
    names = {"flat": 0, "time": 1, "first_hinge": 2, "week_sine": 2 + AD.HINGES, "third_year_cosine": -1}
    last = F.size("xy") - 1
    return sums.select("medicine_id", *[r(F.get("xy", last if k < 0 else F.lit(k)), 3, name) for name, k in names.items()])


@query("fc4_change_points")
def fc4_change_points(spark, d):
    """Forecasts by ridge regression on hinges and waves."""
    f = AD.change_point_forecast(A.daily_demand(T.dispensing(spark, d)))
    return f.select("medicine_id", "h", r("forecast", 3), r("lower", 3), r("upper", 3))


@query("fc10_validation_errors")
def fc10_validation(spark, d):
    """Errors of all models on the last fifth of each series."""
    return VA.validation_report(VA.validate(A.daily_demand(T.dispensing(spark, d)))).select("model", "items", "days", r("mae"), r("rmse"), "best_for")


@query(
    "fc4_additive",
    "SELECT medicine_id, h, round(forecast, 3) AS forecast, round(lower_q, 3) AS lower, round(upper_q, 3) AS upper FROM additive",
    ("additive",),
)
def fc4(spark, d):
    return FC.additive_forecast(components(spark, d)).select("medicine_id", "h", r("forecast", 3), r("lower", 3), r("upper", 3))


def _all_components(spark, d):
    every = FC.all_forecasts(components(spark, d))
    return every.filter(F.col("model").isin("trend", "ar", "additive")).select("medicine_id", "model", "h", "forecast")


@query(
    "fc5_ensemble_of_components",
    """SELECT medicine_id, h, round(sum(w * forecast) / sum(w), 3) AS forecast, count(*) AS components FROM (
       SELECT medicine_id, h, forecast, 0.3 AS w FROM trend UNION ALL SELECT medicine_id, h, forecast, 0.4 FROM ar UNION ALL SELECT medicine_id, h, forecast, 0.3 FROM additive) GROUP BY 1, 2""",
    ("trend", "ar", "additive"),
)
def fc5(spark, d):
    padded = J.pad_components(_all_components(spark, d), Params().horizon)
    return FC.combine_forecasts(padded).select("medicine_id", "h", r("forecast", 3), "components")


@query(
    "join11_aligned_components",
    """SELECT medicine_id, model, h, round(forecast, 3) AS forecast FROM (
       SELECT medicine_id, 'trend' AS model, h, forecast FROM trend UNION ALL SELECT medicine_id, 'ar', h, forecast FROM ar UNION ALL SELECT medicine_id, 'additive', h, forecast FROM additive)""",
    ("trend", "ar", "additive"),
)
def join11(spark, d):
    padded = J.pad_components(_all_components(spark, d), Params().horizon)
    return padded.select("medicine_id", "model", "h", r("forecast", 3))


@query(
    "win10_forward_fill",
    """SELECT medicine_id, CAST(date AS VARCHAR) AS date, round(last_value(nullif(demand, 0) IGNORE NULLS) OVER (PARTITION BY medicine_id ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS demand FROM evdense""",
    ("evdense",),
)
def win10(spark, d):
    """Days without sales carry the last selling day's demand."""
    dense = FC.dense_series(A.daily_demand(T.event_history(spark, d, "user_id")))
    gaps = dense.select("medicine_id", "date", F.nullif("demand", F.lit(0.0)).alias("demand"))
    return W.forward_fill(gaps, "demand", ["medicine_id"], "date").select("medicine_id", day("date"), r("demand"))


@query(
    "fc6_ensemble_bounds",
    """SELECT medicine_id, h, round(forecast, 3) AS forecast, round(lower_q, 3) AS lower, round(upper_q, 3) AS upper, round(upper_q - lower_q, 3) AS uncertainty FROM ens""",
    ("ens",),
)
def fc6(spark, d):
    e = FC.ensemble_forecast(components(spark, d))
    return e.select("medicine_id", "h", r("forecast", 3), r("lower", 3), r("upper", 3), r("uncertainty", 3))


@query(
    "fc7_baseline",
    """SELECT medicine_id, h, round(forecast, 4) AS forecast, round(lower_q, 4) AS lower, round(upper_q, 4) AS upper, round(std_selling, 4) AS uncertainty FROM base""",
    ("base",),
)
def fc7(spark, d):
    b = FC.baseline_forecast(FC.demand_stats(A.daily_demand(T.dispensing(spark, d))))
    return b.select("medicine_id", "h", r("forecast"), r("lower"), r("upper"), r("uncertainty"))


@query(
    "fc8_constant",
    """SELECT medicine_id, h, 10.0::DOUBLE AS forecast, 5.0::DOUBLE AS lower, 15.0::DOUBLE AS upper, 2.5::DOUBLE AS uncertainty, 0.5::DOUBLE AS confidence
       FROM stock, (SELECT unnest(range(30)) AS h)""",
    ("stock",),
)
def fc8(spark, d):
    """The forecast of last resort, for every item."""
    return FC.constant_forecast(T.stock_levels(spark, d)).select("medicine_id", "h", "forecast", "lower", "upper", "uncertainty", "confidence")


@query(
    "fc9_model_choice",
    """SELECT b.medicine_id, b.h, CASE WHEN ens.forecast IS NULL THEN 'historical_baseline' ELSE 'ensemble' END AS model,
       round(coalesce(ens.forecast, b.forecast), 3) AS forecast FROM base b LEFT JOIN ens ON ens.medicine_id = b.medicine_id AND ens.h = b.h""",
    ("base", "ens"),
)
def fc9(spark, d):
    candidates = FC.all_forecasts(components(spark, d))
    return FC.pick_model(candidates).select("medicine_id", "h", "model", r("forecast", 3))


@query(
    "fc10_training_report",
    """SELECT count(*) AS items, sum(CAST(n >= 14 AND positive >= 2 AS INT))::BIGINT AS trained, sum(CAST(NOT (n >= 14 AND positive >= 2) AS INT))::BIGINT AS failed
       FROM (SELECT * FROM fit JOIN stock ON stock.medicine_id = fit.medicine_id ORDER BY total_dispensed DESC, stock.medicine_id LIMIT 50)""",
    ("fit", "stock"),
)
def fc10(spark, d):
    return FC.training_report(FC.train_top(T.dispensing(spark, d), 50))


@query(
    "fc11_available_models",
    """SELECT medicine_id, concat_ws(',', CASE WHEN std >= 0.1 AND n >= 14 THEN 'trend' END, CASE WHEN std >= 0.1 AND n >= 64 THEN 'ar' END,
       CASE WHEN n >= 14 AND positive >= 2 THEN 'additive' END, CASE WHEN n >= 14 AND (std >= 0.1 OR positive >= 2) THEN 'ensemble' END) AS models, n >= 14 AND (std >= 0.1 OR positive >= 2) AS trained FROM fit""",
    ("fit",),
)
def fc11(spark, d):
    return FC.available_models(fitted(spark, d))


@query(
    "fc12_item_history",
    """SELECT medicine_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, sum(quantity) AS demand FROM disp WHERE ts >= (SELECT max(ts) FROM disp) - INTERVAL 90 DAY GROUP BY 1, 2""",
    ("disp",),
)
def fc12(spark, d):
    return A.daily_demand(P.recent_history(T.dispensing(spark, d), 90)).select("medicine_id", day("date"), "demand")


@query(
    "agg21_forecast_stats",
    """SELECT medicine_id, round(avg(forecast), 4) AS mean_forecast, round(sum(forecast), 4) AS total_forecast, round(avg(std_selling), 4) AS mean_uncertainty FROM base GROUP BY 1""",
    ("base",),
)
def agg21(spark, d):
    b = FC.baseline_forecast(FC.demand_stats(A.daily_demand(T.dispensing(spark, d))))
    return A.forecast_stats(b, "medicine_id").select("medicine_id", r("mean_forecast"), r("total_forecast"), r("mean_uncertainty"))


@query(
    "src8_forecast_store",
    """SELECT medicine_id, round(sum(forecast), 4) AS total, true AS stored FROM base GROUP BY 1
       UNION ALL SELECT medicine_id, NULL, false FROM stock WHERE medicine_id NOT IN (SELECT medicine_id FROM base)""",
    ("base", "stock"),
)
def src8(spark, d):
    """Forecasts are stored and reloaded; items that have none are found still to do."""
    path = scratch_path(spark, "forecasts")
    stats = FC.demand_stats(A.daily_demand(T.dispensing(spark, d)))
    levels = T.stock_levels(spark, d).select("medicine_id", "prescription_count")
    H.write_forecasts(FC.baseline_forecast(stats), path, "2024-01-01")
    held = H.read_forecasts(spark, path)
    known = held.groupBy("medicine_id").agg(r(F.sum("forecast"), name="total")).withColumn("stored", F.lit(True))
    todo = H.not_yet_forecast(levels, held).select("medicine_id", F.lit(None).cast("double").alias("total"), F.lit(False).alias("stored"))
    return known.unionByName(todo)


@query(
    "src8_incremental_forecasts",
    """SELECT t.medicine_id, h, round(forecast, 3) AS forecast, last_date >= (SELECT max(CAST(ts AS DATE)) - 30 FROM disp) AS refitted
       FROM trend t JOIN (SELECT medicine_id, max(date) AS last_date FROM daily GROUP BY 1) l ON l.medicine_id = t.medicine_id WHERE own""",
    ("trend", "daily", "disp"),
)
def src8_incremental(spark, d):
    """A run over the history but its last month, then one that reads the last month and fits the items that sold in it."""
    path = scratch_path(spark, "forecast-runs")
    rx = T.dispensing(spark, d)
    newest = rx.agg(F.date_sub(F.max(F.to_date("timestamp")), 30)).first()[0]
    early = F.col("timestamp") < F.lit(newest).cast("timestamp")

    def forecasts(state):
        fitted_ = FC.fit_components(SS.stats_of(state))
        return FC.trend_forecast(FC.component_forecasts(fitted_)).select("medicine_id", "h", "forecast")

    daily = A.daily_demand(rx.filter(early))
    state = stored(SS.advance(SS.no_state(daily), daily)[0].drop("changed"), "series-state")
    H.write_forecasts(forecasts(state), path, "1")
    state = stored(SS.advance(state, A.daily_demand(rx.filter(~early)))[0], "series-state")
    H.write_forecasts(forecasts(state.filter("changed")), path, "2")
    runs = H.read_forecasts(spark, path)
    kept = state.filter("not changed").select("medicine_id")
    rows = runs.filter("run_date = 2").unionByName(runs.filter("run_date = 1").join(kept, "medicine_id", "left_semi"))
    return rows.select("medicine_id", "h", r("forecast", 3), (F.col("run_date") == 2).alias("refitted"))


# ---------------------------------------------------------------- intervals


def _baseline(spark, d):
    return FC.baseline_forecast(FC.demand_stats(A.daily_demand(T.dispensing(spark, d)))).select(
        "medicine_id", "h", "forecast", F.col("uncertainty").alias("std")
    )


@query(
    "uq1_confidence_interval",
    f"""SELECT medicine_id, h, round(forecast - {Z95} * std_selling, 4) AS lower, round(forecast + {Z95} * std_selling, 4) AS upper FROM base""",
    ("base",),
)
def uq1(spark, d):
    return U.confidence_interval(_baseline(spark, d), "forecast", "std").select("medicine_id", "h", r("lower"), r("upper"))


def _poisson_steps(most: int = 12) -> str:
    """Cumulative Poisson(1) probabilities as a SQL list."""
    cum, term, out = 0.0, math.exp(-1.0), []
    for k in range(most):
        cum += term
        term /= k + 1
        out.append(f"{cum!r}::DOUBLE")
    return "[" + ", ".join(out) + "]"


POISSON_STEPS = _poisson_steps()


common(
    "rounds",
    f"""SELECT medicine_id, b, sum(w * demand) / sum(w) AS m FROM daily JOIN (
          SELECT date, b, len(list_filter({POISSON_STEPS}, lambda c: u >= c)) AS w FROM (
            SELECT date, b, {u_sql("'boot42'", "date", "b")} AS u FROM (SELECT DISTINCT date FROM daily), (SELECT unnest(range(1000)) AS b))) x ON x.date = daily.date
        GROUP BY 1, 2 HAVING sum(w) > 0""",
    "daily",
)


@query(
    "uq2_bootstrap_mean",
    """SELECT medicine_id, count(*) AS rounds, round(quantile_cont(m, 0.025) + 0.0000001234, 6) AS lower, round(quantile_cont(m, 0.975) + 0.0000001234, 6) AS upper
       FROM rounds GROUP BY 1""",
    ("rounds",),
)
def uq2(spark, d):
    out = U.bootstrap_mean(A.daily_demand(T.dispensing(spark, d)))
    # interpolated values can sit on rounding ties, so both sides shift them off
    shifted = [r(F.col(c) + 0.0000001234, 6, c) for c in ("lower", "upper")]
    return out.select("medicine_id", "rounds", *shifted)


@query(
    "uq2_bootstrap_forecast",
    """SELECT medicine_id, h, round(greatest(0, lo + 0.2 * lo * sin(2 * pi() * h / 7)) + 0.0000012345, 5) AS lower,
         round(greatest(0, hi + 0.2 * hi * sin(2 * pi() * h / 7)) + 0.0000012345, 5) AS upper
       FROM (SELECT medicine_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rounds GROUP BY 1), (SELECT unnest(range(30)) AS h)""",
    ("rounds",),
)
def uq2_forecast(spark, d):
    out = U.bootstrap_forecast(A.daily_demand(T.dispensing(spark, d)))
    return out.select("medicine_id", "h", *[r(F.col(c) + 0.0000012345, 5, c) for c in ("lower", "upper")])


@query(
    "uq3_monte_carlo",
    f"""SELECT medicine_id, base.h, round(forecast + std_selling * lo, 4) AS lower, round(forecast + std_selling * hi, 4) AS upper
        FROM base JOIN (SELECT h, quantile_cont(z, 0.025) AS lo, quantile_cont(z, 0.975) AS hi FROM (SELECT h, sqrt(-2 * ln({u_sql("'mc42a'", "s", "h")})) * cos(2 * pi() * {u_sql("'mc42b'", "s", "h")}) AS z
          FROM (SELECT unnest(range(10000)) AS s), (SELECT unnest(range(30)) AS h)) GROUP BY 1) noise ON noise.h = base.h""",
    ("base",),
)
def uq3(spark, d):
    return U.monte_carlo_interval(_baseline(spark, d)).select("medicine_id", "h", r("lower"), r("upper"))


@query(
    "uq4_quantile_interval",
    """SELECT medicine_id, isodow(date) - 1 AS weekday, round(quantile_cont(demand, 0.025), 4) AS lower, round(quantile_cont(demand, 0.975), 4) AS upper, count(*) AS days FROM daily GROUP BY 1, 2""",
    ("daily",),
)
def uq4(spark, d):
    return U.quantile_interval(A.daily_demand(T.dispensing(spark, d))).select("medicine_id", "weekday", r("lower"), r("upper"), "days")


@query("uq4_quantile_regression")
def uq4_regression(spark, d):
    """Interval ends as models of the 2.5 and 97.5 % quantiles."""
    f = QR.quantile_regression_interval(A.daily_demand(T.dispensing(spark, d)))
    return f.select("medicine_id", "h", "forecast_date", r("lower", 3), r("upper", 3), "days")


@query("uq4_interval_coverage")
def uq4_coverage(spark, d):
    """How many held-out days of each item lie below, inside and above its interval."""
    return QR.coverage(A.daily_demand(T.dispensing(spark, d))).select("medicine_id", "days", "below", "inside", "above", r("width", 3))


@query(
    "uq5_ensemble_interval",
    f"""SELECT medicine_id, h, round(avg(forecast), 3) AS mean, round(avg(forecast) - {Z95} * stddev_pop(forecast), 3) AS lower, round(avg(forecast) + {Z95} * stddev_pop(forecast), 3) AS upper FROM (
        SELECT medicine_id, h, forecast FROM trend UNION ALL SELECT medicine_id, h, forecast FROM ar UNION ALL SELECT medicine_id, h, forecast FROM additive) GROUP BY 1, 2""",
    ("trend", "ar", "additive"),
)
def uq5(spark, d):
    padded = J.pad_components(_all_components(spark, d), Params().horizon)
    return U.ensemble_interval(padded).select("medicine_id", "h", r("mean", 3), r("lower", 3), r("upper", 3))


@query(
    "uq6_prediction_interval",
    f"""SELECT medicine_id, h, round(greatest(0, forecast - {Z95} * sqrt(std_selling * std_selling * (1 + 0.1 * h))), 4) AS lower,
        round(forecast + {Z95} * sqrt(std_selling * std_selling * (1 + 0.1 * h)), 4) AS upper FROM base""",
    ("base",),
)
def uq6(spark, d):
    b = _baseline(spark, d)
    out = U.prediction_interval(b, "forecast", F.col("std") * F.col("std"), F.col("h"))
    return out.select("medicine_id", "h", r("lower"), r("upper"))
