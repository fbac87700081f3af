"""Streaming operators drained over the event table, checked against the same SQL as their batch forms.

Windows, sessions and gaps are read from tables of changes (update mode), which have the last, still open ones too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from replenish.operators import aggregates as A
from replenish.operators import windows as W
from replenish.plans import inputs  # noqa: F401
from replenish.plans.registry import common, query
from replenish.plans.tidy import r, sql_ts, ts
from replenish.session import scratch_path
from replenish.sources import history as H
from replenish.sources.ids import first_of_each
from replenish.sources import streams as SR
from replenish.sources import tables as T
from replenish.streaming import gaps as SG
from replenish.streaming import sinks as SK
from replenish.streaming import sliding as SL
from replenish.streaming import stock as ST
from replenish.streaming import windows as SW

HOUR, QUARTER_HOUR = 3600, 900
common("mark", "SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS wm FROM ev", "ev")


def events(spark, d, key="event_type"):
    return T.stream_columns(SR.parquet_table(spark, d, "events"), key)


def appended(spark, df, label):
    base = scratch_path(spark, label)
    SK.drain(SK.append_table(df, f"{base}/table", f"{base}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{base}/table")


def changed(spark, df, label, keys):
    base = scratch_path(spark, label)
    SK.drain(SK.changes_table(df, f"{base}/table", f"{base}/checkpoint", keys))
    return SK.current(spark, f"{base}/table", keys)


WINDOW_KEYS = ["medicine_id", "window_start"]


def each_second(spark, df, label, keys):
    """A stream under a processing-time trigger, stopped once it has caught up."""
    base = scratch_path(spark, label)
    running = SK.every(SK.changes_table(df, f"{base}/table", f"{base}/checkpoint", keys), seconds=1)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return SK.current(spark, f"{base}/table", keys)


STATS_SQL = """count(*) AS "count", round(sum(quantity), 4) AS sum, round(avg(quantity), 6) AS mean, round(median(quantity), 4) AS median,
       round(stddev_pop(quantity), 4) AS std, min(quantity) AS min, max(quantity) AS max"""


def _windows(deliver, spark, d, label, size, slide=None):
    counts = deliver(spark, SW.value_counts(events(spark, d), slide or size), label, ["medicine_id", *SW.COUNT_KEYS])
    return W.stats_of_counts(counts, size, slide)


def _stats(df):
    return df.select("medicine_id", ts("window_start"), "count", r("sum"), r("mean", 6), r("median"), r("std"), "min", "max")


@query(
    "str1_tumbling",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, {STATS_SQL} FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM ev)
        GROUP BY medicine_id, w""",
    ("ev",),
)
def str1(spark, d):
    return _stats(_windows(changed, spark, d, "tumbling", HOUR))


@query(
    "str2_hopping",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, {STATS_SQL} FROM (
        SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS w FROM ev, (SELECT unnest(range(4)) AS k)) GROUP BY medicine_id, w""",
    ("ev",),
)
def str2(spark, d):
    return _stats(_windows(changed, spark, d, "hopping", HOUR, QUARTER_HOUR))


@query(
    "str3_sessions",
    f"""SELECT medicine_id, {sql_ts("min(ts)")} AS session_start, {sql_ts("max(ts)")} AS session_end, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS session_duration,
        count(*) AS "count", round(sum(quantity), 4) AS sum, round(avg(quantity), 6) AS mean, max(ts) + INTERVAL 15 MINUTE > (SELECT wm FROM mark) AS is_open FROM (
          SELECT *, sum(opens) OVER (PARTITION BY medicine_id ORDER BY ts, prescription_id) AS sid FROM (
            SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY medicine_id ORDER BY ts, prescription_id) <= 900e6 THEN 0 ELSE 1 END AS opens FROM ev))
        GROUP BY medicine_id, sid""",
    ("ev", "mark"),
)
def str3(spark, d):
    cells = changed(spark, SW.session_cells(events(spark, d), QUARTER_HOUR), "sessions", ["medicine_id", "cell"])
    s = SW.live_sessions(cells, QUARTER_HOUR)
    return s.select("medicine_id", ts("session_start"), ts("session_end"), r("session_duration", 6), "count", r("sum"), r("mean", 6), "is_open")


@query(
    "str4_window_features",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, count(*) AS "count", round(avg(CAST(is_emergency AS INT)), 6) AS emergency_rate,
        round(count(*) * (1 + avg(CAST(is_emergency AS INT))), 4) AS necessity_score, count(DISTINCT location) AS location_diversity,
        round(avg(patient_age), 4) AS avg_patient_age, round(stddev_pop(patient_age), 4) AS age_std
        FROM (SELECT * REPLACE (user_id AS medicine_id), time_bucket(INTERVAL 1 HOUR, ts) AS w FROM ev) GROUP BY medicine_id, w""",
    ("ev",),
)
def str4(spark, d):
    f = changed(spark, SW.features(events(spark, d, "user_id"), HOUR), "features", WINDOW_KEYS)
    return f.select(
        "medicine_id", ts("window_start"), "count", r("emergency_rate", 6), r("necessity_score"), "location_diversity",
        r("avg_patient_age"), r("age_std"),
    )


@query(
    "str4_location_diversity",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, count(*) AS "count", count(DISTINCT location) AS location_diversity FROM (
        SELECT * REPLACE (user_id AS medicine_id), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS w FROM ev, (SELECT unnest(range(4)) AS k)) GROUP BY medicine_id, w""",
    ("ev",),
)
def str4_diversity(spark, d):
    """Sites of hopping windows from one sketch a pane."""
    panes = changed(spark, SW.diversity_panes(events(spark, d, "user_id"), QUARTER_HOUR), "diversity", ["medicine_id", "pane"])
    rows = SW.location_diversity(panes, HOUR, QUARTER_HOUR)
    return rows.withColumn("window_start", ts("window_start"))


@query(
    "str4_arrival_gaps",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, count(*) AS "count", round(avg(g) + 0.00000123, 4) AS avg_inter_arrival_time, round(stddev_pop(g) + 0.00000123, 4) AS std_inter_arrival_time FROM (
        SELECT medicine_id, w, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY medicine_id, w ORDER BY ts)) / 1e6 AS g
        FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM ev)) GROUP BY medicine_id, w""",
    ("ev",),
)
def str4_gaps(spark, d):
    with SL.state_provider(spark):
        slots = changed(spark, SG.slot_gaps(events(spark, d), 60), "gaps", ["medicine_id", "slot"])
    g = SG.window_gaps(slots, HOUR, 60)
    off = F.lit(0.00000123)  # halves of whole microseconds sit on rounding ties, so both sides shift them off
    return g.select(
        "medicine_id", ts("window_start"), "count",
        r(F.col("avg_inter_arrival_time") + off, 4, "avg_inter_arrival_time"),
        r(F.col("std_inter_arrival_time") + off, 4, "std_inter_arrival_time"),
    )


@query(
    "str4_hour_distribution",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, hour_of_day, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM ev)
        GROUP BY 1, 2, 3""",
    ("ev",),
)
def str4_hours(spark, d):
    h = changed(spark, SW.hour_distribution(events(spark, d), 86400), "hours", [*WINDOW_KEYS, "hour_of_day"])
    return h.withColumn("window_start", ts("window_start"))


@query(
    "str5_trigger_each_slide",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, {STATS_SQL} FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM ev)
        GROUP BY medicine_id, w""",
    ("ev",),
)
def str5(spark, d):
    """The tumbling windows of a stream that a clock triggers."""
    return _stats(_windows(each_second, spark, d, "triggered", HOUR))


@query(
    "str6_late_events",
    f"""SELECT medicine_id, {sql_ts("w")} AS window_start, count(*) AS "count", round(sum(quantity), 4) AS sum FROM (
        SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM ev WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 15 DAY FROM ev)) GROUP BY medicine_id, w""",
    ("ev",),
)
def str6(spark, d):
    """Events that arrive after the watermark has passed their window change nothing: the newer half is delivered first."""
    base = scratch_path(spark, "late")
    rx = T.event_history(spark, d).select("prescription_id", "medicine_id", "quantity", "timestamp")
    half = rx.agg(F.date_trunc("day", F.min("timestamp")) + F.expr("INTERVAL 15 DAYS")).scalar()
    newer = F.col("timestamp") >= half
    feed = None
    for part in (newer, ~newer):
        rx.filter(part).write.mode("append").parquet(f"{base}/in")
        feed = feed or spark.readStream.schema(rx.schema).parquet(f"{base}/in")
        # a run per delivery: it ends with the watermark that the next one is held against
        SK.drain(SK.changes_table(SW.windowed(feed, HOUR), f"{base}/table", f"{base}/checkpoint"))
    rows = SK.current(spark, f"{base}/table", WINDOW_KEYS)
    return rows.select("medicine_id", ts("window_start"), "count", r("sum"))


@query(
    "str12_state_each_second",
    """SELECT user_id AS medicine_id, round(sum(quantity), 4) AS total_quantity, count(*) AS "count", round(sum(quantity) / count(*), 2) AS avg_per_rx FROM ev GROUP BY 1""",
    ("ev",),
)
def str12(spark, d):
    """Live totals delivered by a clock."""
    totals = each_second(spark, A.running_totals(events(spark, d, "user_id")), "live", ["medicine_id"])
    return totals.withColumn("total_quantity", r("total_quantity"))


@query(
    "str7_live_totals",
    """SELECT user_id AS medicine_id, round(sum(quantity), 4) AS total_quantity, count(*) AS "count", round(sum(quantity) / count(*), 2) AS avg_per_rx FROM ev GROUP BY 1""",
    ("ev",),
)
def str7(spark, d):
    totals = changed(spark, A.running_totals(events(spark, d, "user_id")), "totals", ["medicine_id"])
    return totals.withColumn("total_quantity", r("total_quantity"))


@query(
    "str7_event_rate",
    f"""SELECT {sql_ts("w")} AS window_start, round(count(*) / 60.0, 6) AS rate, count(*) AS events FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS w FROM ev)
        GROUP BY w""",
    ("ev",),
)
def str7_rate(spark, d):
    rate = changed(spark, SW.event_rate(events(spark, d), 60), "rate", ["window_start"])
    return rate.select(ts("window_start"), r("rate", 6), "events")


@query(
    "str8_sliding_per_event",
    """SELECT prescription_id, medicine_id, count(*) OVER w AS "count", round(sum(quantity) OVER w, 4) AS sum, min(quantity) OVER w AS min, max(quantity) OVER w AS max
       FROM ev WINDOW w AS (PARTITION BY medicine_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
    ("ev",),
)
def str8(spark, d):
    with SL.state_provider(spark):
        rows = appended(spark, SL.sliding_events(events(spark, d), HOUR), "sliding")
    return rows.select("prescription_id", "medicine_id", "count", r("sum"), "min", "max")


common(
    "evstock",
    """SELECT user_id AS medicine_id, 'item ' || user_id AS medicine_name, floor(sum(quantity) * (50 + user_id % 60) / 100) AS opening, avg(quantity) * 30 AS reorder_point FROM ev GROUP BY 1""",
    "ev",
)


def event_stock(spark, d):
    """Opening stock per user-keyed item: a share of what the stream will consume."""
    rx = T.event_history(spark, d, "user_id")
    return rx.groupBy("medicine_id").agg(F.sum("quantity").alias("total"), F.avg("quantity").alias("mean")).select(
        "medicine_id",
        F.concat(F.lit("item "), F.col("medicine_id").cast("string")).alias("medicine_name"),
        F.floor(F.col("total") * (F.lit(50) + F.col("medicine_id") % 60) / 100).cast("double").alias("current_inventory"),
        (F.col("mean") * 30).alias("reorder_point"),
    )


def _depleted(spark, d, stock=None, mode="first"):
    base = scratch_path(spark, "stock")
    with SL.state_provider(spark):
        SK.drain(ST.deplete(events(spark, d, "user_id"), stock or event_stock(spark, d), base, f"{base}/checkpoint", mode))
    return base


@query(
    "str9_stock_left",
    """SELECT s.medicine_id, round(greatest(0, opening - q), 4) AS current_inventory FROM evstock s JOIN (SELECT user_id, sum(quantity) AS q FROM ev GROUP BY 1) u ON u.user_id = s.medicine_id""",
    ("evstock",),
)
def str9_stock(spark, d):
    rows = SK.current(spark, f"{_depleted(spark, d)}/stock", ["medicine_id"])
    return rows.select("medicine_id", r("current_inventory"))


@query(
    "str9_stock_alerts",
    """SELECT s.medicine_id, 'LOW_STOCK' AS alert_type, 'WARNING' AS severity, medicine_name || ' below reorder point' AS message FROM evstock s
       JOIN (SELECT user_id, sum(quantity) AS q FROM ev GROUP BY 1) u ON u.user_id = s.medicine_id WHERE greatest(0, opening - q) < reorder_point""",
    ("evstock",),
)
def str9_alerts(spark, d):
    rows = spark.read.parquet(f"{_depleted(spark, d)}/alerts")
    return rows.select("medicine_id", "alert_type", "severity", "message")


@query(
    "str9_unknown_items",
    """SELECT user_id AS medicine_id, round(sum(quantity), 4) AS total_quantity, 'no opening stock' AS reason FROM ev WHERE user_id % 10 = 0 GROUP BY 1""",
    ("ev",),
)
def str9_unknown(spark, d):
    """Events of items that the stock table does not have are kept, with the reason."""
    base = _depleted(spark, d, event_stock(spark, d).filter("medicine_id % 10 <> 0"))
    rows = SK.current(spark, f"{base}/unknown", ["medicine_id"])
    return rows.select("medicine_id", r("total_quantity"), "reason")


@query("str11_unique_events", "SELECT prescription_id, medicine_id, quantity FROM ev", ("ev",))
def str11(spark, d):
    """The event stream delivered twice in each of two runs keeps each event once; the second run finds all ids stored."""
    base = scratch_path(spark, "unique")
    twice = events(spark, d).unionByName(events(spark, d)).select("prescription_id", "medicine_id", "quantity")
    SK.drain(SK.unique_table(twice, f"{base}/table", f"{base}/c1", "prescription_id"))
    again = spark.read.parquet(f"{base}/table").drop(SK.BATCH)
    first_of_each(again, "prescription_id", f"{base}/table_ids", 1).write.parquet(f"{base}/table/{SK.BATCH}=1")
    return spark.read.parquet(f"{base}/table").select("prescription_id", "medicine_id", "quantity")


@query(
    "src3_src4_json_topic",
    f"""SELECT CAST(prescription_id AS VARCHAR) AS prescription_id, medicine_id, quantity, {sql_ts("ts")} AS "timestamp" FROM ev""",
    ("ev",),
)
def src3_src4(spark, d):
    """Events encoded as a topic's JSON values into files, then decoded by the stream reader."""
    base = scratch_path(spark, "topic")
    out = events(spark, d).select(F.col("prescription_id").cast("string"), "medicine_id", "quantity", "timestamp")
    messages = SR.encode(out).select("value")
    SK.drain(messages.writeStream.format("text").option("path", f"{base}/topic").option("checkpointLocation", f"{base}/c1"))
    back = SR.text_folder(spark, f"{base}/topic", out.schema)
    return appended(spark, back, "topic-rows").withColumn("timestamp", ts("timestamp"))


@query(
    "src5_stream_append",
    """SELECT medicine_id, count(*) AS n, count(DISTINCT prescription_id) AS ids FROM ev GROUP BY 1""",
    ("ev",),
)
def src5_stream(spark, d):
    """Prescriptions saved per micro-batch with their defaults."""
    base = scratch_path(spark, "saved")
    raw = events(spark, d).select("prescription_id", "medicine_id", "quantity", "timestamp")
    writer = raw.writeStream.foreachBatch(lambda b, i: H.append_prescriptions(b, f"{base}/rows", i))
    SK.drain(writer.option("checkpointLocation", f"{base}/checkpoint"))
    rows = spark.read.parquet(f"{base}/rows")
    return rows.groupBy("medicine_id").agg(F.count("*").alias("n"), F.count_distinct("prescription_id").alias("ids"))
