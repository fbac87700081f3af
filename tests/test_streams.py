"""Several micro-batches, late and repeated events, alerts and orders as files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from replenish.operators import forecast as FC
from replenish.operators import orders as O
from replenish.operators import windows as WN
from replenish.params import Params
from replenish.schema import PRESCRIPTIONS
from replenish.sources import history as H
from replenish.sources import interchange as X
from replenish.sources import streams as SR
from replenish.streaming import sinks as SK
from replenish.streaming import sliding as SL
from replenish.streaming import stock as ST
from replenish.streaming import windows as SW

START = dt.datetime(2024, 1, 1)


def event(i, second, item="a", quantity=1):
    at = START + dt.timedelta(seconds=second)
    return {
        "prescription_id": f"R{i}", "timestamp": at.isoformat() + ".000000+00:00", "medicine_id": item, "quantity": quantity,
        "is_emergency": i % 4 == 0, "patient_age": 20 + i % 50, "location": f"Store{i % 3}", "hour_of_day": at.hour,
    }


def write(folder, name, events, age):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)
    os.utime(path, (age, age))


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [[event(b * 100 + i, b * 600 + i * 20, "ab"[i % 2], 1 + i % 5) for i in range(30)] for b in range(4)]
    for n, events in enumerate(batches):
        write(str(folder), f"{n}.json", events, 1_700_000_000 + n)
    return str(folder)


def read(spark, feed):
    return SR.decode(spark.readStream.option("maxFilesPerTrigger", 1).text(feed))


def flat(rows):
    return sorted(tuple(r) for r in rows)


def test_tumbling_stream_equals_batch(spark, feed, tmp_path):
    params = Params().but(watermark="1 minute")
    SK.drain(SK.append_table(SW.windowed(read(spark, feed), 300, None, params), f"{tmp_path}/out", f"{tmp_path}/cp"))
    cols = ["medicine_id", "window_start", "count", "sum", "median", "min", "max"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*cols)
    batch = WN.window_stats(SR.decode(spark.read.text(feed)), 300).filter("window_end <= timestamp'2024-01-01 00:38:40'")
    assert flat(got.collect()) == flat(batch.select(*cols).collect())


def test_hopping_stats_in_two_ways(spark, feed):
    rx = SR.decode(spark.read.text(feed))
    cols = ["medicine_id", "window_start", "count", "sum", "median"]
    got = WN.window_stats(rx, 300, 60).select(*cols)
    assert flat(got.collect()) == flat(SW.windowed(rx, 300, 60).select(*cols).collect())


def test_update_mode_totals(spark, feed, tmp_path):
    from replenish.operators.aggregates import running_totals

    SK.drain(SK.changes_table(running_totals(read(spark, feed)), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = SK.current(spark, f"{tmp_path}/out", ["medicine_id"])
    want = running_totals(SR.decode(spark.read.text(feed)))
    assert flat(got.select(want.columns).collect()) == flat(want.collect())


def test_sliding_state_equals_batch(spark, feed, tmp_path):
    rx = read(spark, feed).select("prescription_id", "medicine_id", F.col("quantity").cast("double"), "timestamp")
    query = SK.drain(SK.append_table(SL.sliding_events(rx, 300), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert query.exception() is None
    got = {r["prescription_id"]: (r["count"], r["sum"], r["max"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = SR.decode(spark.read.text(feed)).select("prescription_id", "medicine_id", F.col("quantity").cast("double"), "timestamp")
    want = WN.sliding_stats(batch, 300).join(batch.select("prescription_id", "medicine_id", "timestamp"), ["medicine_id", "timestamp"])
    assert got == {r["prescription_id"]: (r["count"], r["sum"], r["max"]) for r in want.collect()}


def test_late_rows_are_counted_and_repeats_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(str(folder), "0.json", [event(1, 0), event(2, 7200)], 1_700_000_000)
    write(str(folder), "1.json", [event(2, 7200), event(3, 7201), event(4, 10)], 1_700_000_001)
    write(str(folder), "2.json", [event(5, 7300), event(6, 20)], 1_700_000_002)
    query = SK.drain(SK.append_table(SW.unique_events(read(spark, str(folder))), f"{tmp_path}/out", f"{tmp_path}/cp"))
    ids = [r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("prescription_id").collect()]
    assert len(ids) == len(set(ids)) and {"R1", "R2", "R3", "R5"} <= set(ids)
    assert SK.late_rows(query) == 6 - len(ids)


def test_depletion_alerts_once_over_batches(spark, feed, tmp_path):
    stock = spark.createDataFrame(
        [("a", "A", 100.0, 60.0), ("b", "B", 1000.0, 10.0)],
        "medicine_id string, medicine_name string, current_inventory double, reorder_point double",
    )
    SK.drain(ST.deplete(read(spark, feed), stock, str(tmp_path), f"{tmp_path}/cp"))
    alerts = spark.read.parquet(f"{tmp_path}/alerts").collect()
    assert [(r["medicine_id"], r["message"]) for r in alerts] == [("a", "A below reorder point")]
    left = {r["medicine_id"]: r["current_inventory"] for r in SK.current(spark, f"{tmp_path}/stock", ["medicine_id"]).collect()}
    used = SR.decode(spark.read.text(feed)).groupBy("medicine_id").agg(F.sum("quantity").alias("q")).collect()
    assert left == {r["medicine_id"]: max(0.0, {"a": 100.0, "b": 1000.0}[r["medicine_id"]] - r["q"]) for r in used}


def test_processing_time_trigger(spark, feed, tmp_path):
    query = SK.every(SK.append_table(read(spark, feed), f"{tmp_path}/out", f"{tmp_path}/cp"), seconds=1)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 120


def test_corrupt_csv_lines_are_kept(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("prescription_id,medicine_id,quantity\nR1,a,3\nR2,b,many\n")
    from pyspark.sql import types as T

    schema = T.StructType([f for f in PRESCRIPTIONS.fields if f.name in ("prescription_id", "medicine_id", "quantity")])
    rows = H.read_history_csv(spark, str(path), T.StructType([schema["prescription_id"], schema["medicine_id"], schema["quantity"]])).cache()
    assert [r["prescription_id"] for r in rows.filter(F.col(H.CORRUPT).isNotNull()).collect()] == ["R2"]


def test_edi_of_a_foreign_system(spark):
    text = "ST*850*0001~\nBEG*00*SA*PO77**20240101~\nPO1*1*12*EA*9.5**VP*MED1~\n"
    row = X.parse_edi(spark.createDataFrame([(text,), ("ST*850~",)], "value string")).collect()
    assert tuple(row[0]) == ("PO77", 12.0, 9.5, "MED1") and tuple(row[1]) == ("", 0.0, 0.0, "")


def test_order_rules_and_defaults(spark):
    df = spark.createDataFrame(
        [("a", 100.0, 10.5), ("b", 5.0, 10.0), ("c", None, 1.0), ("d", 20.0, 1.0)], "medicine_id string, quantity double, unit_cost double"
    )
    got = {r["medicine_id"]: r["message"] for r in O.validate(df).collect()}
    assert got == {
        "a": "Order validated successfully", "b": "Order quantity below minimum: 10",
        "c": "Missing required field: quantity", "d": "Order value below minimum: $100",
    }
    rec = spark.createDataFrame([("a", 100.0, 10.5, "HIGH")], "medicine_id string, order_quantity double, unit_cost double, urgency string")
    po = O.purchase_orders(rec, F.lit("2024-01-01").cast("timestamp")).first()
    assert (po["total_cost"], po["supplier"], po["status"], po["priority"]) == (1050.0, "Supplier_A", "PENDING", 0.5)
    assert po["expected_delivery_date"] == dt.datetime(2024, 1, 8)


def test_bounds_hold_around_forecasts(spark, folder):
    from replenish.operators.aggregates import daily_demand
    from replenish.sources import tables as T

    stats = FC.series_stats(daily_demand(T.dispensing(spark, folder)))
    best = FC.best_forecast(FC.component_forecasts(FC.fit_components(stats)))
    assert best.filter("lower > upper or lower < 0 or forecast < 0").count() == 0
    assert best.count() == 30 * stats.count()


def test_rows_without_id_are_all_stored(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", 1, at)] * 3 + [(f"i{k % 7}", k, at) for k in range(2000)] + [(None, 1, at), ("a", None, at)]
    df = spark.createDataFrame(rows, "medicine_id string, quantity int, timestamp timestamp").repartition(3)
    H.append_prescriptions(df, f"{tmp_path}/rx", 4)
    H.append_prescriptions(df, f"{tmp_path}/rx", 5)
    stored = spark.read.parquet(f"{tmp_path}/rx")
    assert stored.count() == stored.select("prescription_id").distinct().count() == 2 * 2003
    rejected = spark.read.parquet(f"{tmp_path}/rx_rejects").collect()
    assert sorted(r["reject_reason"] for r in rejected) == ["missing: medicine_id"] * 2 + ["missing: quantity"] * 2
    # ids of the sender are stored once
    given = df.filter("medicine_id = 'a'").withColumn("prescription_id", F.when(F.col("quantity") == 1, "R1"))
    H.append_prescriptions(given, f"{tmp_path}/given", 0)
    assert spark.read.parquet(f"{tmp_path}/given").count() == 1


def test_bad_records_are_kept_apart(spark):
    good = json.dumps(event(1, 0))
    no_item = json.dumps({k: v for k, v in event(2, 5).items() if k != "medicine_id"})
    raw = spark.createDataFrame([(good,), (no_item,), ("{broken",), (None,)], "value string")
    assert sorted(r["medicine_id"] for r in SR.decode(raw).collect()) == ["a", "unknown"]
    assert {(r["value"], r["reason"]) for r in SR.undecodable(raw).collect()} == {("{broken", "no JSON of the schema"), (None, "no value")}


def test_table_of_one_file_and_of_many(spark, tmp_path):
    df = spark.range(50)
    df.repartition(4).write.parquet(f"{tmp_path}/many.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/part")
    one = next(p for p in os.listdir(f"{tmp_path}/part") if p.endswith(".parquet"))
    os.rename(f"{tmp_path}/part/{one}", f"{tmp_path}/one.parquet")
    for name in ("many", "one"):
        SK.drain(SK.append_table(SR.parquet_table(spark, str(tmp_path), name), f"{tmp_path}/out-{name}", f"{tmp_path}/cp-{name}"))
        assert spark.read.parquet(f"{tmp_path}/out-{name}").count() == 50


def test_compacted_changes_keep_the_newest_rows(spark, feed, tmp_path):
    from replenish.operators.aggregates import running_totals

    SK.drain(SK.changes_table(running_totals(read(spark, feed)), f"{tmp_path}/out", f"{tmp_path}/cp"))
    before = flat(SK.current(spark, f"{tmp_path}/out", ["medicine_id"]).collect())
    assert len(SK.batches(spark, f"{tmp_path}/out")) == 4
    for _ in range(2):
        SK.compact(spark, f"{tmp_path}/out", ["medicine_id"])
        assert len(SK.batches(spark, f"{tmp_path}/out")) == 2
        assert flat(SK.current(spark, f"{tmp_path}/out", ["medicine_id"]).collect()) == before


@pytest.mark.parametrize("mode, items", [("first", ["a", "b"]), ("crossing", ["a"]), ("every", ["a", "a", "b", "b", "b", "b"])])
def test_alert_modes(spark, feed, tmp_path, mode, items):
    stock = spark.createDataFrame(
        [("a", "A", 160.0, 60.0), ("b", "B", 5.0, 10.0)],
        "medicine_id string, medicine_name string, current_inventory double, reorder_point double",
    )
    SK.drain(ST.deplete(read(spark, feed), stock, str(tmp_path), f"{tmp_path}/cp", mode))
    assert sorted(r["medicine_id"] for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) == items


def test_missing_items_are_drawn_too(spark):
    counts = spark.createDataFrame([("a", 5), (None, 3)], "value string, n bigint")
    got = {r["value"]: (r["lo"], r["hi"]) for r in WN.cumulative_counts(counts).collect()}
    assert set(got) == {"a", None} and sorted(got.values())[0][0] == 0 and max(h for _, h in got.values()) == 8


def _one_by_one(spark, tmp_path, seconds, items=None):
    """A stream whose batches are the given lists of event times."""
    folder = tmp_path / "in"
    folder.mkdir()
    n = 0
    for k, batch in enumerate(seconds):
        write(str(folder), f"{k}.json", [event(n + i, s, (items or {}).get(s, "a")) for i, s in enumerate(batch)], 1_700_000_000 + k)
        n += len(batch)
    return read(spark, str(folder))


def test_late_events_join_sessions(spark, tmp_path):
    # 0-60 and 200-230 are apart by more than 100 s until 130 arrives; 400 stays alone
    feed = _one_by_one(spark, tmp_path, [[0, 60, 200], [230, 400], [130]])
    SK.drain(SK.changes_table(SW.session_cells(feed, 100), f"{tmp_path}/out", f"{tmp_path}/cp"))
    cells = SK.current(spark, f"{tmp_path}/out", ["medicine_id", "cell"])
    got = sorted((r["session_duration"], r["count"], r["is_open"]) for r in SW.live_sessions(cells, 100).collect())
    assert got == [(0.0, 1, True), (230.0, 5, True)]
    # as the batch form has it, also over several chunks
    batch = SR.decode(spark.read.text(str(tmp_path / "in")))
    for parts in (None, 3):
        assert sorted((r["session_duration"], r["count"]) for r in WN.session_stats(batch, 100, parts=parts).collect()) == [(0.0, 1), (230.0, 5)]
    old = spark.read.parquet(f"{tmp_path}/out").filter("batch_id = 0").drop("batch_id")
    assert sorted(r["count"] for r in SW.live_sessions(old, 100).collect()) == [1, 2]


def test_sessions_that_are_over(spark, tmp_path):
    feed = _one_by_one(spark, tmp_path, [[0, 10], [2000]])
    SK.drain(SK.changes_table(SW.session_cells(feed, 100, Params().but(watermark="1 minute")), f"{tmp_path}/out", f"{tmp_path}/cp"))
    cells = SK.current(spark, f"{tmp_path}/out", ["medicine_id", "cell"])
    got = SW.live_sessions(cells, 100, Params().but(watermark="1 minute")).collect()
    assert sorted((r["count"], r["is_open"]) for r in got) == [(1, True), (2, False)]


def test_gaps_of_slots_that_late_events_change(spark, tmp_path):
    from replenish.streaming import gaps as SG

    batches = [[0, 3, 31, 299], [45, 2, 301], [7, 30, 650]]
    feed = _one_by_one(spark, tmp_path, batches, {650: "b", 301: "b"})
    query = SK.drain(SK.changes_table(SG.slot_gaps(feed, 10), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert query.exception() is None
    slots = SK.current(spark, f"{tmp_path}/out", ["medicine_id", "slot"])
    got = {(r["medicine_id"], r["window_start"].minute): (r["count"], r["avg_inter_arrival_time"], r["std_inter_arrival_time"]) for r in SG.window_gaps(slots, 300).collect()}
    times = sorted(s for b in batches for s in b if s < 300)
    steps = [b - a for a, b in zip(times, times[1:])]
    mean = sum(steps) / len(steps)
    std = (sum((s - mean) ** 2 for s in steps) / len(steps)) ** 0.5
    assert got[("a", 0)] == (len(times), pytest.approx(mean), pytest.approx(std))
    assert got[("b", 5)] == (1, None, None) and got[("b", 10)] == (1, None, None)


def test_items_without_opening_stock_are_kept(spark, feed, tmp_path):
    columns = "medicine_id string, medicine_name string, current_inventory double, reorder_point double"
    # two opening rows of one item add up, one without reorder point never alerts
    stock = spark.createDataFrame([("a", "A", 60.0, None), ("a", "A", 40.0, None)], columns)
    SK.drain(ST.deplete(read(spark, feed), stock, str(tmp_path), f"{tmp_path}/cp"))
    used = {r["medicine_id"]: r["q"] for r in SR.decode(spark.read.text(feed)).groupBy("medicine_id").agg(F.sum("quantity").alias("q")).collect()}
    left = SK.current(spark, f"{tmp_path}/stock", ["medicine_id"]).collect()
    assert [(r["medicine_id"], r["total_quantity"], r["current_inventory"]) for r in left] == [("a", used["a"], max(0.0, 100 - used["a"]))]
    unknown = SK.current(spark, f"{tmp_path}/unknown", ["medicine_id"]).collect()
    assert [tuple(r) for r in unknown] == [("b", used["b"], "no opening stock")]
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 0


def test_live_windows_with_exact_medians(spark, feed, tmp_path):
    SK.drain(SK.changes_table(SW.value_counts(read(spark, feed), 60), f"{tmp_path}/out", f"{tmp_path}/cp"))
    counts = SK.current(spark, f"{tmp_path}/out", ["medicine_id", *SW.COUNT_KEYS])
    cols = ["medicine_id", "window_start", "count", "sum", "median", "min", "max", "first_event", "last_event"]
    got = WN.stats_of_counts(counts, 300, 60).select(*cols)
    assert flat(got.collect()) == flat(SW.windowed(SR.decode(spark.read.text(feed)), 300, 60).select(*cols).collect())


def test_sketched_median_keeps_its_rank(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 60)
    df = spark.range(20_000).select(F.lit("a").alias("medicine_id"), at.alias("timestamp"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("quantity"))
    values = sorted(r["quantity"] for r in df.collect())
    for accuracy in (100, 1000):
        row = SW.windowed(df, 3600, accuracy=accuracy).first()
        assert abs(values.index(row["median"]) - len(values) / 2) <= len(values) / accuracy + 1


def test_tables_of_changes_compact_themselves(spark, feed, tmp_path):
    from replenish.operators.aggregates import running_totals

    SK.drain(SK.changes_table(running_totals(read(spark, feed)), f"{tmp_path}/out", f"{tmp_path}/cp", ["medicine_id"], 2))
    assert any("." in n for n in SK.batches(spark, f"{tmp_path}/out"))
    want = running_totals(SR.decode(spark.read.text(feed)))
    got = SK.current(spark, f"{tmp_path}/out", ["medicine_id"])
    assert flat(got.select(want.columns).collect()) == flat(want.collect())


def test_sketched_sites_of_hopping_windows(spark, feed, tmp_path):
    SK.drain(SK.changes_table(SW.diversity_panes(read(spark, feed), 60), f"{tmp_path}/out", f"{tmp_path}/cp"))
    panes = SK.current(spark, f"{tmp_path}/out", ["medicine_id", "pane"])
    got = SW.location_diversity(panes, 300, 60)
    from pyspark.sql import functions as F

    rows = SR.decode(spark.read.text(feed)).groupBy("medicine_id", F.window("timestamp", "300 seconds", "60 seconds").alias("w"))
    want = rows.agg(F.count("*"), F.count_distinct("location")).select("medicine_id", "w.start", "count(1)", "count(DISTINCT location)")
    assert flat(got.collect()) == flat(want.collect())
    # many sites: a fixed size and the stated error
    many = spark.range(60_000).select(F.lit("a").alias("medicine_id"), F.lit(START).alias("timestamp"), F.concat(F.lit("S"), F.col("id") % 20_000).alias("location"))
    panes = SW.diversity_panes(many, 60)
    assert panes.select(F.octet_length("sites")).first()[0] < 2**12 * 2
    assert SW.location_diversity(panes, 60, 60).first()["location_diversity"] == pytest.approx(20_000, rel=0.05)
