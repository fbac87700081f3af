"""Time windows and ordered per-key computations.

Row-level orders per key (running stock, arrival gaps, last-n features) are
computed in chunks: a chunk is a time span of a key (see ``_chunked``), chunks are
summarised to one row, the summaries are scanned in order per key, and each row
combines its chunk's carry-in with its rank inside the chunk. A key with a third
of all rows is therefore spread over its chunks; what runs per key in one task
is one row per chunk.

Daily series need no chunks: they have at most one row per item and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.functions.scalars import micros
from replenish.session import stored

MICRO = 1_000_000


# ---------------------------------------------------------------- tumbling and hopping windows


def pane_counts(rx: DataFrame, pane: int, key: str = "medicine_id") -> DataFrame:
    """(key, pane, quantity, n, first_event, last_event): rows per key, pane of ``pane`` seconds and value; batch or stream."""
    counts = rx.groupBy(key, F.window("timestamp", f"{pane} seconds").alias("_p"), "quantity").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event")
    )
    return counts.select(key, F.unix_seconds(F.col("_p.start")).alias("pane"), *counts.columns[2:])


def exact_median(counts: DataFrame, group: list[str], value: str = "quantity", n: str = "n", parts: int | None = None) -> DataFrame:
    """(group..., median) of values that come ``n`` times, of groups of any size.

    The counts are sorted by range of (group, value) and summed per chunk; the sums tell which chunks, two at most, hold a
    group's middle ranks, and only those are looked at row by row. No task has all values of a group. Rows
    without a value don't count; a group without values has no row.
    """
    rows = ranged(counts.filter(F.col(value).isNotNull()).select(F.struct(*group).alias("_g"), value, n), "_g", value, [], parts)
    sums = rows.groupBy("_g", "_chunk").agg(F.sum(n).alias("_sum"))
    whole = W.partitionBy("_g")
    before = F.sum("_sum").over(whole.orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")
    total = F.sum("_sum").over(whole)
    low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
    sums = sums.select("_g", "_chunk", "_sum", before.alias("_before"), low.alias("_low"), high.alias("_high"))
    middle = sums.filter((F.col("_before") < F.col("_high")) & (F.col("_before") + F.col("_sum") >= F.col("_low")))
    inside = W.partitionBy("_g", "_chunk").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    near = _carried(rows, middle.drop("_sum"), "_g").withColumn("_upto", F.col("_before") + F.sum(n).over(inside))
    near = near.filter((F.col("_upto") >= F.col("_low")) & (F.col("_upto") - F.col(n) < F.col("_high")))
    both = near.groupBy("_g").agg(((F.min(value) + F.max(value)) / 2).alias("median"))
    return both.select(*[F.col("_g")[c].alias(c) for c in group], "median")


def stats_of_counts(counts: DataFrame, size: int, slide: int | None = None, key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """count, sum, mean, median, population std, min, max and first/last time per key and window, from :func:`pane_counts`.

    A pane is the slide, or the whole window if there is none; its counts are copied to the windows over it.
    """
    if slide and size % slide:
        raise ValueError("size must be a multiple of slide")
    start = F.col("pane")
    if slide:
        # windows that contain the pane start at pane - k * slide for k below size / slide
        starts = F.sequence(start - F.lit(size - slide), start, F.lit(slide).cast("bigint"))
        counts = counts.withColumn("_w", F.explode(starts))
    else:
        counts = counts.withColumn("_w", start)
    n, v = F.col("n"), F.col("quantity")
    out = counts.groupBy(key, "_w").agg(
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.sum(n).alias("count"),
        F.sum(v * n).alias("sum"),
        F.sum(v * v * n).alias("_sq"),
        F.sum(F.when(v.isNotNull(), n)).alias("_valued"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    medians = exact_median(counts, [key, "_w"], parts=parts).withColumnsRenamed({key: "_k", "_w": "_mw"})
    out = out.join(medians, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_w") == F.col("_mw")), "left")
    mean = F.try_divide("sum", "_valued")
    return out.select(
        key,
        F.timestamp_seconds("_w").alias("window_start"),
        F.timestamp_seconds(F.col("_w") + F.lit(size)).alias("window_end"),
        "first_event",
        "last_event",
        "count",
        "sum",
        mean.alias("mean"),
        "median",
        F.when(F.col("_valued") > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide("_sq", "_valued") - mean * mean))).alias("std"),
        "min",
        "max",
    )


def window_stats(rx: DataFrame, size: int, slide: int | None = None, key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """Statistics per key and window, with exact medians; rows are first counted per (key, pane, value)."""
    return stats_of_counts(pane_counts(rx, slide or size, key), size, slide, key, parts)


def feature_aggregates(size: int, distinct: Column) -> list[Column]:
    """Emergency, necessity, location and age features of a window, for any groupBy."""
    rate = F.avg(F.coalesce(F.col("is_emergency"), F.lit(False)).cast("int"))
    return [
        F.count("*").alias("count"),
        rate.alias("emergency_rate"),
        (F.count("*") / F.lit(size / 3600.0) * (F.lit(1.0) + rate)).alias("necessity_score"),
        distinct.alias("location_diversity"),
        F.avg("patient_age").alias("avg_patient_age"),
        F.stddev_pop("patient_age").alias("age_std"),
    ]


def window_features(rx: DataFrame, size: int, key: str = "medicine_id") -> DataFrame:
    location = F.coalesce(F.col("location"), F.lit("unknown"))
    return (
        rx.groupBy(key, F.window("timestamp", f"{size} seconds").alias("_w"))
        .agg(*feature_aggregates(size, F.count_distinct(location)))
        .select(key, F.col("_w.start").alias("window_start"), "count", *FEATURE_NAMES)
    )


FEATURE_NAMES = ["emergency_rate", "necessity_score", "location_diversity", "avg_patient_age", "age_std"]


def hour_histogram(rx: DataFrame, size: int, key: str = "medicine_id") -> DataFrame:
    return (
        rx.groupBy(key, F.window("timestamp", f"{size} seconds")["start"].alias("window_start"), "hour_of_day")
        .agg(F.count("*").alias("n"))
    )


def numbered_sessions(spans: DataFrame, gap: int, key: str, parts: int | None = None) -> DataFrame:
    """Spans ``(first_event, last_event)`` of a key, in order and apart, with the number ``_session`` of their session.

    A span at most ``gap`` seconds behind the one before it continues its session. One range layout, so that a key which
    never pauses is still spread over its chunks: the first span of a chunk is held against the chunk summaries, which
    also carry the numbers of sessions on.
    """
    rows = ranged(spans, key, "first_event", [F.col("last_event")], parts)
    rows = rows.withColumn("_from", micros(F.col("first_event"))).withColumn("_to", micros(F.col("last_event")))
    inside = W.partitionBy(key, "_chunk").orderBy("_place")
    wait = F.col("_from") - F.lag("_to").over(inside)
    rows = rows.withColumn("_opens", F.coalesce((wait > gap * MICRO).cast("bigint"), F.lit(0)))
    chunks = rows.groupBy(key, "_chunk").agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.sum("_opens").alias("_more"))
    order = W.partitionBy(key).orderBy("_chunk")
    pause = F.col("_first") - F.lag("_last").over(order)
    chunks = chunks.withColumn("_new", F.coalesce(pause > gap * MICRO, F.lit(True)).cast("bigint"))
    upto = F.sum(F.col("_new") + F.col("_more")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_more")
    carry = chunks.select(key, "_chunk", upto.alias("_upto"))
    return _carried(rows, carry, key).withColumn(
        "_session", F.col("_upto") + F.sum("_opens").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )


def sessions_of(spans: DataFrame, gap: int, key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """One row per session of spans that carry ``count`` and ``sum``."""
    return (
        numbered_sessions(spans, gap, key, parts)
        .groupBy(key, "_session")
        .agg(
            F.min("first_event").alias("session_start"),
            F.max("last_event").alias("session_end"),
            F.sum("count").alias("count"),
            F.sum("sum").alias("sum"),
        )
        .withColumn("mean", F.try_divide("sum", "count"))
        .withColumn(
            "session_duration", (micros(F.col("session_end")) - micros(F.col("session_start"))) / F.lit(float(MICRO))
        )
        .drop("_session")
    )


def session_stats(rx: DataFrame, gap: int, key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """Sessions per key: an event at most ``gap`` seconds after the previous one continues its session.

    Events of one key inside one cell of ``gap`` seconds are of one session whatever lies between them, so
    cells are combined first and only their spans are put in order.
    """
    cell = F.floor(micros(F.col("timestamp")) / F.lit(gap * MICRO))
    spans = rx.groupBy(key, cell.alias("_cell")).agg(
        F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), F.count("*").alias("count"), F.sum("quantity").alias("sum")
    )
    return sessions_of(spans.drop("_cell"), gap, key, parts)


# ---------------------------------------------------------------- per-event sliding window


PARTIAL = {"n": F.sum, "v": F.sum, "s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max}


def _both(name: str, a: Column, b: Column) -> Column:
    """Two partial aggregates as one; either may be missing."""
    if name in ("lo", "hi"):
        return (F.least if name == "lo" else F.greatest)(a, b)
    return F.coalesce(a + b, a, b)


def sliding_stats(rx: DataFrame, size: int, key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """For every event time of a key: statistics of that key's events in the closed span [t - size, t].

    Equal times of a key share their result, so rows are first combined per (key, time). The axis is cut into cells
    of ``size`` seconds, so a span is the end of one cell and the beginning of the next: running aggregates from both
    ends of every cell give both, and the end that belongs to t is the first at or after t - size. The cost of
    an event doesn't depend on how many the span holds, nothing is subtracted, and a cell with any number of events is
    spread over the chunks of a range layout. Events without a time have no span.
    """
    at = rx.filter("timestamp is not null").groupBy(key, "timestamp").agg(
        F.count("*").alias("n"),
        F.count("quantity").alias("v"),
        F.sum("quantity").alias("s"),
        F.sum(F.col("quantity") * F.col("quantity")).alias("q"),
        F.min("quantity").alias("lo"),
        F.max("quantity").alias("hi"),
    )
    at = at.withColumn("_us", micros(F.col("timestamp")))
    at = at.withColumn("_cell", F.floor(F.col("_us") / F.lit(size * MICRO)).cast("bigint"))
    rows = ranged(at, key, "timestamp", [], parts)
    inside, cells = W.partitionBy(key, "_cell", "_chunk"), W.partitionBy(key, "_cell")
    upto, past = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    chunks = rows.groupBy(key, "_cell", "_chunk").agg(*[how(c).alias(c) for c, how in PARTIAL.items()])
    carry = chunks.select(
        key, "_cell", "_chunk",
        *[how(c).over(cells.orderBy("_chunk").rowsBetween(*past)).alias(f"_b_{c}") for c, how in PARTIAL.items()],
        *[how(c).over(cells.orderBy(F.desc("_chunk")).rowsBetween(*past)).alias(f"_a_{c}") for c, how in PARTIAL.items()],
    )
    begun = {c: how(c).over(inside.orderBy("_place").rowsBetween(*upto)) for c, how in PARTIAL.items()}
    left = {c: how(c).over(inside.orderBy(F.desc("_place")).rowsBetween(*upto)) for c, how in PARTIAL.items()}
    rows = rows.select("*", *[x.alias(f"_i_{c}") for c, x in begun.items()], *[x.alias(f"_l_{c}") for c, x in left.items()])
    rows = _carried(rows, carry, key, "_cell")
    head = F.struct(*[_both(c, F.col(f"_b_{c}"), F.col(f"_i_{c}")).alias(c) for c in PARTIAL]).alias("_head")
    tail = F.struct(*[_both(c, F.col(f"_a_{c}"), F.col(f"_l_{c}")).alias(c) for c in PARTIAL]).alias("_tail")
    rows = rows.select(key, "timestamp", "_us", "_cell", head, tail)
    # a tail serves times of the next cell up to its own time plus the size
    asks = rows.select(key, "_cell", "_us", F.lit(0).alias("_kind"), "timestamp", "_head", F.lit(None).cast(rows.schema["_tail"].dataType).alias("_tail"))
    ends = rows.select(
        key, F.col("_cell") + 1, F.col("_us") + F.lit(size * MICRO), F.lit(1), F.lit(None).cast("timestamp"), F.lit(None).cast(rows.schema["_head"].dataType), "_tail"
    )
    both = ranged(asks.union(ends), key, "_us", [F.col("_kind")], parts)
    firsts = both.groupBy(key, "_cell", "_chunk").agg(F.min_by("_tail", F.when(F.col("_tail").isNotNull(), F.col("_place"))).alias("_first"))
    later = F.last("_first", ignorenulls=True).over(cells.orderBy(F.desc("_chunk")).rowsBetween(*past))
    own = F.last("_tail", ignorenulls=True).over(inside.orderBy(F.desc("_place")).rowsBetween(*upto))
    found = both.withColumn("_own", own).filter("_kind = 0")
    found = _carried(found, firsts.select(key, "_cell", "_chunk", later.alias("_later")), key, "_cell")
    found = found.withColumn("_end", F.coalesce("_own", "_later"))
    whole = {c: _both(c, F.col("_head")[c], F.col("_end")[c]) for c in PARTIAL}
    out = found.select(key, "timestamp", *[x.alias(f"_{c}") for c, x in whole.items()])
    mean = F.try_divide("_s", "_v")
    std = F.when(F.col("_v") > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide("_q", "_v") - mean * mean)))
    return out.select(
        key, "timestamp", F.col("_n").alias("count"), F.col("_s").alias("sum"), mean.alias("mean"), std.alias("std"), F.col("_lo").alias("min"), F.col("_hi").alias("max")
    )


# ---------------------------------------------------------------- chunked scans


def ranged(df: DataFrame, key: str, time: str, ties: list[Column], parts: int | None = None) -> DataFrame:
    """The rows in the order of (key, time, ties), sorted by range once and stored for all scans of a query.

    ``_place`` grows along that order and ``_chunk`` is the part of the sort. Parts have about as many
    rows each whatever the keys and times are, so a hot key or instant is spread over many;
    ``ties`` should then identify a row. ``parts`` fixes their number.
    """
    order = [F.col(key), F.col(time), *ties]
    spread = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = spread.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return stored(placed.withColumn("_chunk", F.shiftright("_place", 33)), "range-layout")


def _carried(rows: DataFrame, carry: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows with the values that their chunk gets from those before it; a missing key is a key."""
    names = {key: "_carry_key", "_chunk": "_carry_chunk"} | {c: f"_carry{c}" for c in more}
    same = F.col(key).eqNullSafe(F.col("_carry_key")) & (F.col("_chunk") == F.col("_carry_chunk"))
    for c in more:
        same = same & (F.col(c) == F.col(f"_carry{c}"))
    return rows.join(carry.withColumnsRenamed(names), same).drop(*names.values())


COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    key: str,
    time: str,
    ties: list[Column],
    values: dict[str, tuple[str, Column]],
    parts: int | None = None,
) -> DataFrame:
    """Running sum, min or max per key in (time, ties) order, inclusive of the row.

    ``values`` maps an output name to ``(how, expression)``.
    """
    rows = ranged(df, key, time, ties, parts)
    for name, (_, expr) in values.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    per_chunk = rows.groupBy(key, "_chunk").agg(
        *[COMBINE[how](f"_v_{name}").alias(f"_c_{name}") for name, (how, _) in values.items()]
    )
    before = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = per_chunk.select(
        key, "_chunk", *[COMBINE[how](f"_c_{name}").over(before).alias(f"_b_{name}") for name, (how, _) in values.items()]
    )
    inside = W.partitionBy(key, "_chunk").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    out = _carried(rows, carry, key)
    for name, (how, _) in values.items():
        local, past = COMBINE[how](f"_v_{name}").over(inside), F.col(f"_b_{name}")
        if how == "sum":
            total = local + F.coalesce(past, F.lit(0))
        elif how == "min":
            total = F.least(local, past)
        else:
            total = F.greatest(local, past)
        out = out.withColumn(name, total)
    return out.drop("_chunk", "_place", *[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])


def with_previous(df: DataFrame, key: str, time: str, ties: list[Column], parts: int | None = None) -> DataFrame:
    """Adds ``previous``: the time (microseconds) of the key's preceding row, NULL for its first."""
    rows = ranged(df, key, time, ties, parts).withColumn("_us", micros(F.col(time)))
    ends = rows.groupBy(key, "_chunk").agg(F.max("_us").alias("_end"))
    carry = ends.select(key, "_chunk", F.lag("_end").over(W.partitionBy(key).orderBy("_chunk")).alias("_before"))
    inside = W.partitionBy(key, "_chunk").orderBy("_place")
    return (
        _carried(rows, carry, key)
        .withColumn("previous", F.coalesce(F.lag("_us").over(inside), F.col("_before")))
        .drop("_chunk", "_place", "_us", "_before")
    )


def arrival_gaps(rx: DataFrame, key: str = "medicine_id", parts: int | None = None) -> DataFrame:
    """Mean and population deviation of the seconds between consecutive events of a key; NULL for one event."""
    gaps = with_previous(rx.select(key, "timestamp"), key, "timestamp", [], parts).withColumn(
        "_gap", (micros(F.col("timestamp")) - F.col("previous")) / F.lit(float(MICRO))
    )
    return gaps.groupBy(key).agg(
        F.count("*").alias("count"),
        F.avg("_gap").alias("avg_inter_arrival_time"),
        F.stddev_pop("_gap").alias("std_inter_arrival_time"),
    )


def rolling_features(
    rx: DataFrame,
    ties: list[Column],
    sizes: tuple[int, ...] = (5, 10, 20),
    key: str = "medicine_id",
    parts: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """Mean, population std, max and min of the last n quantities of a key, once n of them exist.

    Rows get their exact rank per key from a chunked running count, are cut into
    blocks of ``block`` ranks, and the last ``max(sizes) - 1`` rows of a block are
    repeated at the head of the next one.
    """
    reach = max(sizes) - 1
    ranked = running(rx, key, "timestamp", ties, {"_rank": ("sum", F.lit(1).cast("bigint"))}, parts)
    home = F.floor((F.col("_rank") - 1) / F.lit(block)).cast("bigint")
    tail = F.col("_rank") > (F.col("_home") + 1) * block - reach
    blocks = F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))
    spread = ranked.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    out = spread
    for n in sizes:
        w = W.partitionBy(key, "_block").orderBy("_rank").rowsBetween(-(n - 1), 0)
        full = F.col("_rank") >= n
        out = (
            out.withColumn(f"rolling_mean_{n}", F.when(full, F.avg("quantity").over(w)))
            .withColumn(f"rolling_std_{n}", F.when(full, F.stddev_pop("quantity").over(w)))
            .withColumn(f"rolling_max_{n}", F.when(full, F.max("quantity").over(w)))
            .withColumn(f"rolling_min_{n}", F.when(full, F.min("quantity").over(w)))
        )
    return out.filter(F.col("_block") == F.col("_home")).drop("_rank", "_home", "_block")


# ---------------------------------------------------------------- daily series (calendar-bounded groups)


def moving_average(series: DataFrame, n: int = 7, key: str = "medicine_id") -> DataFrame:
    """Trailing mean, expanding at the start; series shorter than ``n`` stay as they are."""
    whole = W.partitionBy(key)
    trail = W.partitionBy(key).orderBy("date").rowsBetween(-(n - 1), 0)
    return series.withColumn(
        "moving_average",
        F.when(F.count("*").over(whole) < n, F.col("demand")).otherwise(F.avg("demand").over(trail)),
    )


def first_crossing(path: DataFrame, key: str = "medicine_id") -> DataFrame:
    """First day whose cumulative demand exceeds the stock, and the excess on that day.

    ``path`` has ``key, h, demand, current_inventory``: at most one row per day ahead.
    """
    cum = F.sum("demand").over(W.partitionBy(key).orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    over = path.withColumn("_cum", cum).filter(F.col("_cum") > F.col("current_inventory"))
    return over.groupBy(key).agg(
        F.min("h").alias("crossing_day"),
        F.min_by(F.col("_cum") - F.col("current_inventory"), "h").alias("overshoot"),
    )


def lag_matrix(series: DataFrame, lookback: int = 14, key: str = "medicine_id") -> DataFrame:
    """Supervised rows: the previous ``lookback`` values and the next one."""
    past = W.partitionBy(key).orderBy("date").rowsBetween(-lookback, -1)
    return (
        series.withColumn("features", F.collect_list("demand").over(past))
        .filter(F.size("features") == lookback)
        .select(key, "date", "features", F.col("demand").alias("target"))
    )


def scaled(series: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Standard and min-max scaling per series; a constant series scales to zero."""
    w = W.partitionBy(key)
    mean, std = F.avg("demand").over(w), F.stddev_pop("demand").over(w)
    low, high = F.min("demand").over(w), F.max("demand").over(w)
    return series.select(
        "*", mean.alias("mean"), std.alias("std"), low.alias("low"), high.alias("high")
    ).withColumn(
        "standard", F.coalesce(F.try_divide(F.col("demand") - F.col("mean"), F.col("std")), F.lit(0.0))
    ).withColumn(
        "minmax", F.coalesce(F.try_divide(F.col("demand") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    )


def unscaled(scaled_series: DataFrame) -> DataFrame:
    """Inverse of both scalings."""
    return scaled_series.withColumn("from_standard", F.col("standard") * F.col("std") + F.col("mean")).withColumn(
        "from_minmax", F.col("minmax") * (F.col("high") - F.col("low")) + F.col("low")
    )


def forward_fill(grid: DataFrame, value: str, keys: list[str], order: str = "h") -> DataFrame:
    """Last known value along the horizon ('edge' padding of a forecast vector)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return grid.withColumn(value, F.last(value, ignorenulls=True).over(w))


def cumulative_counts(counts: DataFrame, value: str = "value") -> DataFrame:
    """Half-open integer interval ``[lo, hi)`` of cumulative counts per distinct value.

    Values are ordered by the md5 of their text: any fixed order serves sampling, and
    this one is uniform, so the prefix sum runs in 4096 even groups whose totals
    are scanned first (4096 rows at most).
    """
    # a missing value has its own place
    named = counts.withColumn("_key", F.md5(F.coalesce(F.col(value).cast("string"), F.lit("\u0000")))).withColumn(
        "_group", F.substring("_key", 1, 3)
    )
    groups = named.groupBy("_group").agg(F.sum("n").alias("_total"))
    before = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.select("_group", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_group").orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    hi = F.col("_offset") + F.sum("n").over(inside)
    return (
        named.join(F.broadcast(offsets), "_group")  # at most 4096 rows
        .withColumn("hi", hi)
        .withColumn("lo", F.col("hi") - F.col("n"))
        .select(value, "n", "lo", "hi")
    )


def series_split(series: DataFrame, train_share: float = 0.8, key: str = "medicine_id") -> DataFrame:
    """First share of each series (by day) is train, the rest validation."""
    rank = F.row_number().over(W.partitionBy(key).orderBy("date"))
    size = F.count("*").over(W.partitionBy(key))
    return series.withColumn("split", F.when(rank <= F.floor(size * F.lit(train_share)), "train").otherwise("validation"))


# ---------------------------------------------------------------- stock walks


def stock_walk(
    changes: DataFrame, stock: DataFrame, ties: list[Column], clamp: bool = True, parts: int | None = None
) -> DataFrame:
    """Stock after every change of an item, clamped at zero after each one.

    ``changes`` has ``medicine_id, timestamp, delta``. With ``s`` the unclamped
    walk, the clamped one is ``s - least(0, running minimum of s)``. One range layout serves the sums and the
    minima of each chunk; the opening stock meets the chunk summaries only. Several opening rows of an item add up.
    An item without any starts at zero and has ``opening_known`` false; a missing item is an item of its own.
    """
    key = "medicine_id"
    rows = ranged(changes, key, "timestamp", ties, parts)
    inside = W.partitionBy(key, "_chunk").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("delta").over(inside))
    chunks = rows.groupBy(key, "_chunk").agg(F.sum("delta").alias("_all"), F.min("_sum").alias("_least"))
    before = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    start = stock.groupBy(F.col(key).alias("_item")).agg(F.sum("current_inventory").alias("_start"))
    opened = chunks.withColumn("_past", F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    opened = opened.join(start, F.col(key).eqNullSafe(F.col("_item")), "left")
    opened = opened.withColumn("_from", F.coalesce("_start", F.lit(0.0)) + F.col("_past"))
    carry = opened.select(key, "_chunk", "_from", F.col("_start").isNotNull().alias("opening_known"), F.min(F.col("_from") + F.col("_least")).over(before).alias("_low"))
    walked = _carried(rows, carry, key).withColumn("_s", F.col("_from") + F.col("_sum"))
    low = F.least(F.lit(0.0), F.col("_low"), F.col("_from") + F.min("_sum").over(inside))
    after = F.col("_s") - low if clamp else F.col("_s")
    return walked.withColumn("stock_after", after).drop("_sum", "_from", "_low", "_s", "_place", "_chunk")


def threshold_crossings(daily: DataFrame, stock: DataFrame) -> DataFrame:
    """Days on which an item's stock falls from at least to below its reorder point.

    Daily consumption is at most one row per item and day. The unclamped stock is
    used, as the live path does; items may cross once since stock only falls.
    """
    w = W.partitionBy("medicine_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    walked = daily.withColumn("_used", F.sum("demand").over(w)).join(
        stock.select("medicine_id", "medicine_name", "current_inventory", "reorder_point"), "medicine_id"
    )
    new = F.col("current_inventory") - F.col("_used")
    old = new + F.col("demand")
    return walked.withColumn("stock_before", old).withColumn("stock_after", new).filter(
        (F.col("stock_before") >= F.col("reorder_point")) & (F.col("stock_after") < F.col("reorder_point"))
    ).drop("_used")
