"""Arrival gaps of open and closed windows of a stream.

Groups are (key, slot of a few seconds), so a hot key is spread over its slots. A slot's state is its sorted
times as one binary value; it takes part in no other slot and goes by an event-time timer once the watermark has
passed its end. Every batch gives the summaries of the slots that it changed: count, first and last time,
squared gaps. Windows are folded from the current summaries, gaps between slots included.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from replenish.functions.scalars import micros
from replenish.params import Params

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MICRO = 1_000_000


class SlotTimes(StatefulProcessor):
    """Sorted event times of one (key, slot); emits the slot's summary whenever it changes."""

    def __init__(self, slot_us: int, key: str):
        self.slot_us, self.key = slot_us, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", StructType([StructField("us", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r["us"].to_numpy(np.int64) for r in rows]
        if self.times.exists():
            held.append(np.frombuffer(self.times.get()[0], np.int64))
        else:
            end = (int(key[1]) + 1) * self.slot_us // 1000
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs()) + 1)
        us = np.sort(np.concatenate(held))
        self.times.update((us.tobytes(),))
        gaps = np.diff(us) / MICRO
        yield pd.DataFrame(
            {self.key: [key[0]], "slot": [key[1]], "n": [len(us)], "first": [us[0]], "last": [us[-1]], "squares": [float(gaps @ gaps)]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def slot_gaps(events: DataFrame, slot: int = 10, params: Params = Params(), key: str = "medicine_id") -> DataFrame:
    """(key, slot, n, first, last, squares) of the changed slots of each batch, for update mode.

    Rows without a time belong to no slot; a missing key is a key. Needs the state provider of ``sliding``.
    """
    us = micros(F.col("timestamp"))
    placed = events.withWatermark("timestamp", params.watermark).select(
        key, F.floor(us / F.lit(slot * MICRO)).cast("bigint").alias("slot"), us.alias("us"), "timestamp"
    )
    kind = events.schema[key].dataType.simpleString()
    return placed.filter("us is not null").groupBy(key, "slot").transformWithStateInPandas(
        statefulProcessor=SlotTimes(slot * MICRO, key),
        outputStructType=f"{key} {kind}, slot bigint, n bigint, first bigint, last bigint, squares double",
        outputMode="Update",
        timeMode="EventTime",
    )


def _fold(slots: Column) -> Column:
    """Sum of squared gaps over ordered slots ``(first, last, squares)``, gaps between slots included."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0.0).alias("squares"))

    def step(acc: Column, slot: Column) -> Column:
        between = F.coalesce((slot["first"] - acc["last"]) / F.lit(1e6), F.lit(0.0))
        return F.struct(slot["last"].alias("last"), (acc["squares"] + slot["squares"] + between * between).alias("squares"))

    return F.aggregate(slots, start, step)["squares"]


def window_gaps(slots: DataFrame, size: int, slot: int = 10, key: str = "medicine_id") -> DataFrame:
    """Mean and population deviation of arrival gaps per window of ``size`` seconds, from current slots.

    A window has ``size / slot`` slots at most. The mean is ``(last - first) / (n - 1)``, the deviation follows from
    the squares; both are NULL for a single event.
    """
    if size % slot:
        raise ValueError("size must be a multiple of slot")
    start = F.floor(F.col("slot") * F.lit(slot) / F.lit(size)).cast("bigint") * F.lit(size)
    whole = slots.groupBy(key, start.alias("_w")).agg(
        F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct("first", "last", "squares"))).alias("_slots")
    )
    first, last = F.get("_slots", F.lit(0))["first"], F.get("_slots", F.size("_slots") - 1)["last"]
    pairs = F.col("count") - 1
    mean = F.try_divide((last - first) / F.lit(1e6), pairs)
    square = F.try_divide(_fold(F.col("_slots")), pairs)
    return whole.select(
        key,
        F.timestamp_seconds("_w").alias("window_start"),
        "count",
        mean.alias("avg_inter_arrival_time"),
        F.when(pairs > 0, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))).alias("std_inter_arrival_time"),
    )
