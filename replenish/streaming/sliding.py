"""Per-event sliding statistics on a stream, with explicit keyed state.

Groups are (key, cell of one window length) rather than key: an event updates its own cell and is kept as
history for the next one, so a group's state is two window lengths and expires with the watermark. Windows
and sessions do not need this; it exists for callers that want a result for every event.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from replenish.functions.scalars import micros
from replenish.params import Params

# The processor travels to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """The state provider that keyed processors need, for queries that are started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


SLOTS = 64
PLACE = StructType([StructField("slot", IntegerType())])
PACKED = StructType([StructField("value", BinaryType())])


class SlidingSlots(StatefulProcessor):
    """Events of one (key, cell) in slots of a 64th of the window; emits count, sum, mean, min and max per home event.

    A span [t - size, t] is 63 whole slots, of which only count, sum, least and greatest are read, and parts of the
    two slots at its ends. So a batch reads and writes the slots that its events and the far ends of their spans
    lie in and the 128 summaries, whatever the window holds.
    """

    def __init__(self, size_us: int):
        self.size_us, self.slot_us = size_us, size_us // SLOTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", PLACE, PACKED)
        self.sums = handle.getValueState("sums", PACKED)

    def _slot(self, k: int) -> np.ndarray:
        """(us, quantity) rows of a slot in the order of time."""
        if not self.slots.containsKey((k,)):
            return np.empty((2, 0))
        return np.frombuffer(self.slots.getValue((k,))[0], np.float64).reshape(2, -1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("us", kind="stable")
        # times from the start of the cell before, exact as floats
        start = (int(key[1]) - 1) * self.size_us
        us, qty = (fresh["us"].to_numpy(np.int64) - start).astype(float), fresh["quantity"].to_numpy(float)
        if self.sums.exists():
            sums = np.frombuffer(self.sums.get()[0], np.float64).reshape(4, 2 * SLOTS).copy()
        else:
            sums = np.array([[0.0], [0.0], [np.inf], [-np.inf]]).repeat(2 * SLOTS, axis=1)
            cell_end = (int(key[1]) + 1) * self.size_us // 1000
            self.handle.registerTimer(max(cell_end, timerValues.getCurrentWatermarkInMs()) + 1)
        place = (us // self.slot_us).astype(int)
        held: dict[int, np.ndarray] = {}
        for k in np.unique(place).tolist():
            own = place == k
            both = np.concatenate([self._slot(k), np.stack([us[own], qty[own]])], axis=1)
            held[k] = both[:, both[0].argsort(kind="stable")]
            self.slots.updateValue((k,), (held[k].tobytes(),))
            known = held[k][1][~np.isnan(held[k][1])]
            sums[:, k] = held[k].shape[1], known.sum(), known.min(initial=np.inf), known.max(initial=-np.inf)
        self.sums.update((sums.tobytes(),))
        home = fresh[fresh["is_home"]]
        if len(home):
            yield self._spans(key, home, us[fresh["is_home"].to_numpy()], sums, held)

    def _spans(self, key, home: pd.DataFrame, at: np.ndarray, sums: np.ndarray, held: dict[int, np.ndarray]) -> pd.DataFrame:
        out = np.empty((4, len(at)))
        place = (at // self.slot_us).astype(int)
        for k in np.unique(place).tolist():
            far = k - SLOTS
            if far not in held:
                held[far] = self._slot(far)
            whole = sums[:, far + 1 : k]
            base = whole[0].sum(), whole[1].sum(), whole[2].min(initial=np.inf), whole[3].max(initial=-np.inf)
            mine = place == k
            begin, end = held[far], held[k]
            first = np.searchsorted(begin[0], at[mine] - self.size_us, "left")
            last = np.searchsorted(end[0], at[mine], "right")
            tail, head = np.nan_to_num(begin[1], nan=0.0), np.nan_to_num(end[1], nan=0.0)
            total = np.concatenate([[0.0], tail[::-1].cumsum()])[::-1][first] + np.concatenate([[0.0], head.cumsum()])[last]
            least = [np.fmin.accumulate(np.concatenate([[np.inf], x])) for x in (begin[1][::-1], end[1])]
            most = [np.fmax.accumulate(np.concatenate([[-np.inf], x])) for x in (begin[1][::-1], end[1])]
            left = begin.shape[1] - first
            out[0, mine] = base[0] + left + last
            out[1, mine] = base[1] + total
            out[2, mine] = np.minimum(base[2], np.minimum(least[0][left], least[1][last]))
            out[3, mine] = np.maximum(base[3], np.maximum(most[0][left], most[1][last]))
        known = np.isfinite(out[2])
        count, total = out[0].astype(np.int64), np.where(known, out[1], np.nan)
        return pd.DataFrame(
            {
                "prescription_id": home["prescription_id"].to_numpy(), "medicine_id": key[0], "count": count, "sum": total,
                "mean": total / count, "min": np.where(known, out[2], np.nan), "max": np.where(known, out[3], np.nan),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.slots.clear()
        self.sums.clear()
        return iter([])

    def close(self) -> None:
        pass


def sliding_events(events: DataFrame, size: int, params: Params = Params()) -> DataFrame:
    """Needs ``spark.sql.streaming.stateStore.providerClass`` set to ``STATE_PROVIDER``."""
    size_us = size * 1_000_000
    us = micros(F.col("timestamp"))
    home = F.floor(us / F.lit(size_us)).cast("bigint")
    spread = (
        events.withWatermark("timestamp", params.watermark)
        .withColumn("us", us)
        .withColumn("_home", home)
        .withColumn("cell", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
        .withColumn("is_home", F.col("cell") == F.col("_home"))
        .select("medicine_id", "cell", "prescription_id", "us", "quantity", "is_home", "timestamp")
    )
    kind = events.schema["medicine_id"].dataType.simpleString()
    ident = events.schema["prescription_id"].dataType.simpleString()
    schema = f"prescription_id {ident}, medicine_id {kind}, count bigint, sum double, mean double, min double, max double"
    return spread.groupBy("medicine_id", "cell").transformWithStateInPandas(
        statefulProcessor=SlidingSlots(size_us), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
