"""The paths taken for hot keys, forced on small data and compared with plain forms."""

import itertools
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replenish.operators import graph as G
from replenish.operators import joins as J
from replenish.operators import ranking as R
from replenish.operators import windows as WN

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield
    spark.conf.set(THRESHOLD, before)


def test_salted_join_keeps_every_row(spark, no_broadcast):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = J.skew_safe_join(facts, dim, "k", how, J.hot_keys(facts, "k", 10))
        plain = J.skew_safe_join(facts, dim, "k", how)
        assert plain.count() == got.count()
        want = facts.join(dim, "k", how)
        assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=repr) == sorted(
            map(tuple, want.select("id", "k", "v").collect()), key=repr
        )


def test_hot_keys_are_bounded(spark):
    facts = spark.range(2000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"))
    assert [r[0] for r in J.hot_keys(facts, "k", 10).collect()] == [1]


def test_giant_basket_pairs_once(spark, no_broadcast):
    rows = [(1, i) for i in range(60)] + [(2, i) for i in range(3)] + [(3, 5)]
    items = spark.createDataFrame(rows, "basket_id bigint, medicine_id bigint")
    got = sorted(map(tuple, G.basket_pairs(items, block=8).collect()))
    want = sorted([(1, *p) for p in itertools.combinations(range(60), 2)] + [(2, *p) for p in itertools.combinations(range(3), 2)])
    assert got == want


def test_association_of_two_items(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "a")]
    items = G.basket_items(spark.createDataFrame(rows, "basket_id int, medicine_id string"))
    row = G.association_scores(G.edge_counts(G.basket_pairs(items)), G.vertex_counts(items)).first()
    assert (row["n"], row["n1"], row["n2"], row["score"]) == (2, 3, 2, 1.0)


@pytest.mark.parametrize("parts", [None, 7])
def test_running_values_over_chunks(spark, parts):
    """Parts of a range sort, with many rows of one key at one instant."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else "cold", 1_700_000_000 + (0 if i < 60 else rng.randint(0, 900)), rng.randint(-9, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t bigint, v int").withColumn("ts", F.timestamp_seconds("t"))
    got = WN.running(
        df, "k", "ts", [F.col("id")], {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "x": ("max", F.col("v"))},
        parts,
    )
    w = W.partitionBy("k").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w), F.min("v").over(w), F.max("v").over(w))
    assert sorted(map(tuple, got.select("id", "s", "m", "x").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [None, 7])
def test_previous_event_over_chunks(spark, parts):
    rows = [(i, i % 2, 1_700_000_000 + 37 * i * (i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, k int, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = WN.with_previous(df, "k", "ts", [F.col("id")], parts).select("id", "previous")
    w = W.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lag(F.unix_micros("ts")).over(w))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [None, 9])
def test_clamped_walk_never_negative(spark, parts):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), i * 40_000, float(rng.randint(-20, 15))) for i in range(120)]
    changes = spark.createDataFrame(rows, "id int, medicine_id string, t bigint, delta double").withColumn("timestamp", F.timestamp_seconds("t"))
    stock = spark.createDataFrame([("a", 30.0), ("b", 0.0)], "medicine_id string, current_inventory double")
    got = {r["id"]: r["stock_after"] for r in WN.stock_walk(changes, stock, [F.col("id")], parts=parts).collect()}
    level = {"a": 30.0, "b": 0.0}
    for i, item, _, delta in rows:
        level[item] = max(0.0, level[item] + delta)
        assert got[i] == pytest.approx(level[item])


def test_global_position_with_ties(spark):
    df = spark.range(0, 500, 1, 7).select("id", (F.col("id") % 3).alias("p"))
    got = R.global_position(df, [F.desc("p"), F.asc("id")]).collect()
    want = sorted(((r["p"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [x[1] for x in want] == [r["id"] for r in sorted(got, key=lambda r: r["position"])]
    assert sorted(r["position"] for r in got) == list(range(500))


def test_interval_join_picks_one_value_per_draw(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 1), ("c", 99)], "value string, n bigint")
    intervals = WN.cumulative_counts(counts)
    draws = spark.range(1000).withColumnRenamed("id", "d")
    got = J.pick_by_interval(draws, intervals, "d", F.lit(1000), F.lit(64)).groupBy("value").count()
    assert {r[0]: r[1] for r in got.collect()} == {"a": 900, "b": 1, "c": 99}


@pytest.mark.parametrize("parts", [None, 3])
def test_sessions_join_at_the_gap(spark, parts):
    rows = [(1, "a", 0, 1.0), (2, "a", 60, 1.0), (3, "a", 121, 1.0)]
    df = spark.createDataFrame(rows, "prescription_id int, medicine_id string, t bigint, quantity double").withColumn(
        "timestamp", F.timestamp_seconds("t")
    )
    got = sorted((r["count"], r["session_duration"]) for r in WN.session_stats(df, 60, parts=parts).collect())
    assert got == [(1, 0.0), (2, 60.0)]


def test_short_series_is_not_averaged(spark):
    df = spark.createDataFrame([("a", d, float(d)) for d in (1, 2, 3)], "medicine_id string, date int, demand double")
    assert sorted(r["moving_average"] for r in WN.moving_average(df).collect()) == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_sliding_spans_over_chunks(spark, parts):
    """One cell with most of the events, spans that begin on an event, ties, missing values, keys and times."""
    rng = random.Random(9)
    events = [(rng.choice(["a", None]), t, rng.choice([1.0, 2.5, -3.0, None])) for t in [rng.randrange(100, 200) for _ in range(80)] + list(range(0, 700, 50))]
    df = spark.createDataFrame(events, "medicine_id string, s long, quantity double").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {(r["medicine_id"], r["timestamp"].timestamp()): tuple(r)[2:] for r in WN.sliding_stats(df, 100, parts=parts).collect()}
    assert WN.sliding_stats(df.withColumn("timestamp", F.lit(None).cast("timestamp")), 100).count() == 0
    want = {}
    for key, t, _ in events:
        span = [q for k, u, q in events if k == key and t - 100 <= u <= t]
        known = [q for q in span if q is not None]
        mean = sum(known) / len(known) if known else None
        std = max(0.0, sum(q * q for q in known) / len(known) - mean * mean) ** 0.5 if known else None
        want[key, t] = (len(span), sum(known) if known else None, mean, std, min(known, default=None), max(known, default=None))
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == tuple(x if x is None else pytest.approx(x, abs=1e-9) for x in w)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_exact_medians_over_chunks(spark, parts):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(8)), rng.randrange(1, 5)) for g in ["x", "y", None] for _ in range(30)] + [("one", 5.0, 1), ("two", 1.0, 2), ("two", 4.0, 2), ("none", None, 3)]
    df = spark.createDataFrame(rows, "g string, quantity double, n long")
    got = {r["g"]: r["median"] for r in WN.exact_median(df, ["g"], parts=parts).collect()}
    import statistics

    want = {g: statistics.median([v for k, v, n in rows if k == g for _ in range(n)]) for g in ("x", "y", None, "one", "two")}
    assert got == want
