"""Windowed aggregates over unbounded prescriptions.

State is bounded by the watermark. Nothing gathers a window's rows: statistics and sessions are partial
aggregates. Streams keep what can be merged (cells, counts), and what needs an order is put together from
their current tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.operators.windows import FEATURE_NAMES, feature_aggregates, pane_counts, sessions_of
from replenish.params import Params


def _marked(events: DataFrame, params: Params) -> DataFrame:
    return events.withWatermark("timestamp", params.watermark)


def value_counts(events: DataFrame, pane: int, params: Params = Params(), key: str = "medicine_id") -> DataFrame:
    """The stream side of exact window statistics: rows per key, pane and value, for update mode.

    State is one counter per value, spread over tasks by value, and a pane is held once however many windows
    overlap it. The windows, open ones too, are ``stats_of_counts`` of the current counts, medians included.
    """
    return pane_counts(_marked(events, params), pane, key)


COUNT_KEYS = ["pane", "quantity"]


def windowed(
    events: DataFrame, size: int, slide: int | None = None, params: Params = Params(), key: str = "medicine_id", accuracy: int | None = None
) -> DataFrame:
    """Tumbling (no slide) or hopping statistics per key and window as one aggregate, for sinks that take final rows.

    With ``accuracy`` the median is a mergeable sketch whose rank is off by 1 / ``accuracy`` of the window's rows at
    most, and state is bounded by it; without, the state of a window has a counter per distinct value.
    """
    middle = F.percentile_approx("quantity", 0.5, accuracy) if accuracy else F.median("quantity")
    window = F.window("timestamp", f"{size} seconds", f"{slide} seconds") if slide else F.window("timestamp", f"{size} seconds")
    stats = _marked(events, params).groupBy(key, window.alias("_w")).agg(
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
        F.count("*").alias("count"),
        F.sum("quantity").alias("sum"),
        F.avg("quantity").alias("mean"),
        middle.alias("median"),
        F.stddev_pop("quantity").alias("std"),
        F.min("quantity").alias("min"),
        F.max("quantity").alias("max"),
    )
    return stats.select(key, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *stats.columns[2:])


def features(events: DataFrame, size: int, params: Params = Params(), key: str = "medicine_id") -> DataFrame:
    """Emergency, necessity, location and age features per window; the location set is as large as the site list."""
    location = F.size(F.collect_set(F.coalesce(F.col("location"), F.lit("unknown")))).cast("bigint")
    window = F.window("timestamp", f"{size} seconds").alias("_w")
    stats = _marked(events, params).groupBy(key, window).agg(*feature_aggregates(size, location))
    return stats.select(key, F.col("_w.start").alias("window_start"), "count", *FEATURE_NAMES)


LOG_REGISTERS = 12


def diversity_panes(events: DataFrame, pane: int, params: Params = Params(), key: str = "medicine_id", registers: int = LOG_REGISTERS) -> DataFrame:
    """The stream side of location diversity: a mergeable sketch of the sites per key and pane, for update mode.

    State is 2^``registers`` small registers a pane at most, whatever the number of sites; a missing site is one of its own.
    """
    sites = F.hll_sketch_agg(F.coalesce(F.col("location"), F.lit("unknown")), registers)
    rows = _marked(events, params).groupBy(key, F.window("timestamp", f"{pane} seconds").alias("_p")).agg(F.count("*").alias("count"), sites.alias("sites"))
    return rows.select(key, F.unix_seconds(F.col("_p.start")).alias("pane"), "count", "sites")


def location_diversity(panes: DataFrame, size: int, slide: int, key: str = "medicine_id") -> DataFrame:
    """Sites per key and hopping window, by union of the current panes' sketches.

    With 2^12 registers the standard error is 1.6 % for many sites; a few dozen are counted exactly.
    """
    if size % slide:
        raise ValueError("size must be a multiple of slide")
    start = F.col("pane")
    starts = F.sequence(start - F.lit(size - slide), start, F.lit(slide).cast("bigint"))
    windows = panes.withColumn("_w", F.explode(starts)).groupBy(key, "_w")
    rows = windows.agg(F.sum("count").alias("count"), F.hll_sketch_estimate(F.hll_union_agg("sites")).alias("location_diversity"))
    return rows.select(key, F.timestamp_seconds("_w").alias("window_start"), "count", "location_diversity")


def hour_distribution(events: DataFrame, size: int, params: Params = Params(), key: str = "medicine_id") -> DataFrame:
    window = F.window("timestamp", f"{size} seconds").alias("_w")
    counts = _marked(events, params).groupBy(key, window, "hour_of_day").agg(F.count("*").alias("n"))
    return counts.select(key, F.col("_w.start").alias("window_start"), "hour_of_day", "n")


def session_cells(events: DataFrame, gap: int, params: Params = Params(), key: str = "medicine_id") -> DataFrame:
    """The stream side of sessions: span, count and sum of every (key, cell of ``gap`` seconds), for update mode.

    Events of a cell are of one session, so a session is a run of cells; state is four numbers a cell, and a hot key is
    spread over its cells. Sessions, open ones too, are :func:`live_sessions` of the current cells: a late event
    that fills a pause changes its cell, and the sessions on both sides are one from then on.
    """
    stats = _marked(events, params).groupBy(key, F.window("timestamp", f"{gap} seconds").alias("_c")).agg(
        F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), F.count("*").alias("count"), F.sum("quantity").alias("sum")
    )
    return stats.select(key, F.col("_c.start").alias("cell"), "first_event", "last_event", "count", "sum")


def live_sessions(cells: DataFrame, gap: int, params: Params = Params(), key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """Sessions of the current cells of a stream; ``is_open`` until the watermark has passed the end by ``gap`` seconds."""
    mark = cells.agg(F.date_trunc("millisecond", F.max("last_event")) - F.expr(f"INTERVAL {params.watermark}")).scalar()
    rows = sessions_of(cells, gap, key, parts)
    return rows.withColumn("is_open", F.col("session_end") + F.expr(f"INTERVAL {gap} SECONDS") > mark)


def unique_events(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Each prescription id once within the watermark."""
    return _marked(events, params).dropDuplicatesWithinWatermark(["prescription_id"])


def event_rate(events: DataFrame, seconds: int = 1, params: Params = Params()) -> DataFrame:
    """Events per fixed interval over all items; partial counts leave one row per task and interval."""
    window = F.window("timestamp", f"{seconds} seconds").alias("_w")
    return _marked(events, params).groupBy(window).agg(F.count("*").alias("events")).select(
        F.col("_w.start").alias("window_start"), (F.col("events") / F.lit(float(seconds))).alias("rate"), "events"
    )
