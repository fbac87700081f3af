"""Ids that are stored once over batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.sources import history as H
from replenish.sources import ids as I


def test_filters_know_all_and_little_more():
    rng = np.random.default_rng(1)
    for n in (1, 63, 5000):
        h1, h2 = rng.integers(-(2**63), 2**63, (2, n))
        filter_ = I.bloom(h1, h2)
        assert len(filter_) * 8 < 2 * max(I.BITS_AN_ID * n, 64) + 8 and I.may_hold(filter_, h1, h2).all()
    other = rng.integers(-(2**63), 2**63, (2, 20_000))
    assert I.may_hold(filter_, *other).mean() < 0.02


def test_only_buckets_that_may_hold_ids_are_read(spark, tmp_path):
    path = str(tmp_path / "ids")
    ids = spark.range(3000).select(F.concat(F.lit("R"), "id").alias("id"))
    first = I.keyed(F.col("id"), ids)
    assert I.unseen(first, path, 0) == (first, [])
    I.record(first, path, 0)
    fresh = I.keyed(F.concat(F.lit("X"), "id"), ids.limit(20))
    new, read = I.unseen(fresh, path, 1)
    assert new.count() == 20 and len(read) < 5
    mixed = I.keyed(F.col("id"), ids.limit(3)).union(fresh)
    new, read = I.unseen(mixed, path, 1)
    assert {r["id"] for r in new.collect()} == {r["id"] for r in fresh.collect()} and 1 <= len(read) < 10
    # a retried batch doesn't know itself
    I.record(fresh, path, 1)
    assert I.unseen(fresh, path, 1)[0].count() == 20 and I.unseen(fresh, path, 2)[0].count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_an_id_of_two_batches_is_stored_once(spark, tmp_path, order):
    at = dt.datetime(2024, 1, 1)
    schema = "prescription_id string, medicine_id string, quantity int, timestamp timestamp"
    loads = [
        [("R1", "a", 1, at), ("R1", "a", 9, at), ("R2", "b", 2, at), (None, "c", 3, at), (None, "c", 3, at), ("R9", None, 3, at)],
        [("R2", "b", 2, at), ("R3", "b", 4, at), (None, "c", 3, at)],
        [("R1", "a", 1, at), ("R9", "d", 5, at), ("", "e", 1, at)],
    ]
    for n in (*order, order[-1]):
        H.append_prescriptions(spark.createDataFrame(loads[n], schema).repartition(2), f"{tmp_path}/rx", n)
    stored = [r["prescription_id"] for r in spark.read.parquet(f"{tmp_path}/rx").collect()]
    made = [i for i in stored if i.startswith("RX")]
    # a rejected row does not use its id up
    assert sorted(set(stored) - set(made)) == ["", "R1", "R2", "R3", "R9"] and len(stored) == len(set(stored)) == 8 and len(made) == 3
    assert spark.read.parquet(f"{tmp_path}/rx_rejects").count() == 1


def test_empty_batches(spark, tmp_path):
    rows = spark.createDataFrame([], "prescription_id string, v int")
    for n in range(2):
        assert I.first_of_each(rows, "prescription_id", str(tmp_path / "ids"), n).count() == 0
    assert I.first_of_each(spark.createDataFrame([("a", 1), (None, 2), (None, 2)], rows.schema), "prescription_id", str(tmp_path / "ids"), 2).count() == 3
