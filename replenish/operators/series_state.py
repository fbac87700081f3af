"""Series sums that grow by new days instead of being taken anew.

A state has a row per item: sums over its closed days, the last closed day, and the newest day apart, which
may still get rows. Merging new rows reads them and the state, never the history; only items that got rows have
to be fitted again. Rows of days before an item's newest one can't be merged into products of neighbours; they
come back as late, and their items need one scan of their own history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.operators.forecast import with_calendar
from replenish.operators.joins import spread_by_item

SUMS = ("selling_days", "positive_days", "sy", "syy", "sdy", "sxy")
LISTS = {"wd_sum": 7, "mo_sum": 12}


def _lists(y: Column) -> list[Column]:
    weekday = F.array(*[F.sum(F.when(F.weekday("date") == k, y).otherwise(0.0)) for k in range(7)])
    month = F.array(*[F.sum(F.when(F.month("date") == m, y).otherwise(0.0)) for m in range(1, 13)])
    return [weekday.alias("wd_sum"), month.alias("mo_sum")]


def _state_schema(kind: str, key: str) -> str:
    days = "first_day date, first_value double, closed_day date, closed_value double, open_day date, open_value double"
    return f"{key} {kind}, {days}, selling_days bigint, positive_days bigint, sy double, syy double, sdy double, sxy double, wd_sum array<double>, mo_sum array<double>"


def no_state(daily: DataFrame, key: str = "medicine_id") -> DataFrame:
    return daily.sparkSession.createDataFrame([], _state_schema(daily.schema[key].dataType.simpleString(), key))


def advance(state: DataFrame, daily: DataFrame, key: str = "medicine_id") -> tuple[DataFrame, DataFrame]:
    """(the state with the new days and ``changed``, the late rows).

    ``daily`` has at most one row per item and day; a row of an item's newest day adds to it.
    """
    mark = state.select(F.col(key).alias("_k"), "open_day", "open_value", "closed_day", "closed_value")
    same = F.col(key).eqNullSafe(F.col("_k"))
    known = daily.select(key, "date", F.col("demand").cast("double").alias("demand")).join(mark, same, "left")
    late = known.filter("date < open_day").select(key, "date", "demand")
    new = known.filter("open_day is null or date >= open_day")
    # the newest day of each item that got rows goes through the sums again
    opened = new.filter("open_day is not null").select(key, "open_day", "open_value", "closed_day", "closed_value").distinct()
    opened = opened.select(key, F.col("open_day").alias("date"), F.col("open_value").alias("demand"), "closed_day", "closed_value")
    rows = new.select(key, "date", "demand", "closed_day", "closed_value").union(opened).groupBy(key, "date").agg(
        F.sum("demand").alias("demand"), F.first("closed_day").alias("_before"), F.first("closed_value").alias("_before_value")
    )
    # not merged by size, as in series_stats
    rows = spread_by_item(rows, key)
    w = W.partitionBy(key).orderBy("date")
    y, day = F.col("demand"), F.unix_date("date").cast("double")
    previous, value = F.coalesce(F.lag("date").over(w), F.col("_before")), F.coalesce(F.lag("demand").over(w), F.col("_before_value"))
    rows = rows.select("*", (F.lead("date").over(w).isNotNull()).alias("_closed"), F.when(F.datediff("date", previous) == 1, y * value).otherwise(0.0).alias("_xy"))
    shut = lambda c: F.when(F.col("_closed"), c)
    zero = F.lit(0.0)
    fresh = rows.groupBy(F.col(key).alias("_k")).agg(
        F.min("date").alias("f_day"),
        F.min_by("demand", "date").alias("f_value"),
        F.max(shut(F.col("date"))).alias("c_day"),
        F.max_by("demand", shut(F.col("date"))).alias("c_value"),
        F.max("date").alias("o_day"),
        F.max_by("demand", "date").alias("o_value"),
        F.count_if("_closed").alias("n_selling_days"),
        F.count_if(F.col("_closed") & (y > 0)).alias("n_positive_days"),
        *[F.coalesce(F.sum(shut(c)), zero).alias(f"n_{name}") for name, c in (("sy", y), ("syy", y * y), ("sdy", y * day), ("sxy", F.col("_xy")))],
        *[c.alias(f"n_{name}") for name, c in zip(LISTS, _lists(F.coalesce(shut(y), zero)))],
    )
    both = state.join(fresh, same, "full")
    changed = F.col("o_day").isNotNull()
    one_day = F.col("first_day").isNull() | (changed & (F.col("first_day") == F.col("open_day")))

    def added(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"n_{name}"), F.lit(0))

    def added_list(name: str, size: int) -> Column:
        none = F.array_repeat(zero, size)
        return F.zip_with(F.coalesce(name, none), F.coalesce(f"n_{name}", none), lambda a, b: a + b)

    merged = both.select(
        F.when(changed, F.col("_k")).otherwise(F.col(key)).alias(key),
        F.coalesce("first_day", "f_day").alias("first_day"),
        F.when(one_day, F.col("f_value")).otherwise(F.col("first_value")).alias("first_value"),
        F.coalesce("c_day", "closed_day").alias("closed_day"),
        F.coalesce("c_value", "closed_value").alias("closed_value"),
        F.coalesce("o_day", "open_day").alias("open_day"),
        F.coalesce("o_value", "open_value").alias("open_value"),
        *[added(name).alias(name) for name in SUMS],
        *[added_list(name, size).alias(name) for name, size in LISTS.items()],
        changed.alias("changed"),
    )
    return merged, late


def stats_of(state: DataFrame, key: str = "medicine_id") -> DataFrame:
    """The statistics that ``series_stats`` takes from whole histories, from a state with its newest day added."""
    y, day = F.col("open_value"), F.col("open_day")
    n, sy, syy = F.col("selling_days") + 1, F.col("sy") + y, F.col("syy") + y * y
    spread = F.greatest(F.lit(0.0), syy - sy * sy / n)
    sums = state.select(
        key, "first_day", day.alias("last_day"), n.alias("selling_days"), (F.col("positive_days") + (y > 0).cast("bigint")).alias("positive_days"),
        sy.alias("sy"), syy.alias("syy"), (F.col("sdy") + y * F.unix_date(day)).alias("sdy"),
        (F.col("sxy") + F.when(F.datediff(day, "closed_day") == 1, y * F.col("closed_value")).otherwise(0.0)).alias("sxy"),
        "first_value", y.alias("last_value"), (sy / n).alias("mean_selling"),
        F.coalesce(F.sqrt(F.try_divide(spread, (n - 1).cast("double"))), F.lit(0.0)).alias("std_selling"),
        F.transform("wd_sum", lambda x, i: x + F.when(i == F.weekday(day), y).otherwise(0.0)).alias("wd_sum"),
        F.transform("mo_sum", lambda x, i: x + F.when(i == F.month(day) - 1, y).otherwise(0.0)).alias("mo_sum"),
    )
    return with_calendar(sums)
