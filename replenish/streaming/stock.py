"""Stream-driven stock: depletion, transactions and low-stock alerts.

The state of an item is what is left of it. It starts from the opening stock, which is read once, when the
stream starts; every batch takes the quantities of its events off, and whether the item has been alerted is
part of the state, so no earlier output is read again. Events are added up per item and Arrow batch before
they are shuffled, so a hot item sends a few rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from replenish.operators.alerts import ALERT_COLUMNS, raise_low_stock

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODES = ("first", "crossing", "every")
STATE = "opening double, reorder_point double, medicine_name string, total_quantity double, alerted boolean"
UNKNOWN = "no opening stock"


class StockLevel(StatefulProcessor):
    """Stock of one item; emits its level after every batch that changes it, and whether that raises an alert."""

    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # several opening rows of one item are stock at several places
        known = initialState["reorder_point"].dropna()
        names = initialState["medicine_name"].dropna()
        self.level.update(
            (
                float(initialState["current_inventory"].fillna(0.0).sum()),
                float(known.max()) if len(known) else None,
                str(names.min()) if len(names) else None,
                0.0,
                False,
            )
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = float(sum(r["quantity"].sum() for r in rows))
        opening, point, name, total, alerted = tuple(self.level.get()) if self.level.exists() else (None, None, None, 0.0, False)
        total += used
        left = None if opening is None else max(0.0, opening - total)
        low = left is not None and point is not None and left < point
        if self.mode == "crossing":
            low = low and opening >= point
        raised = low and (self.mode == "every" or not alerted)
        self.level.update((opening, point, name, total, alerted or raised))
        yield pd.DataFrame(
            {
                "medicine_id": [key[0]], "medicine_name": [name], "total_quantity": [total], "opening": [opening],
                "current_inventory": [left], "reorder_point": [point], "raised": [raised],
            }
        )

    def close(self) -> None:
        pass


def _added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.groupby("medicine_id", dropna=False, as_index=False)["quantity"].sum()


def stock_levels(events: DataFrame, stock: DataFrame, mode: str = "first") -> DataFrame:
    """Level of every item that a batch changes, in update mode; ``opening`` is NULL for items without opening stock."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    kind = events.schema["medicine_id"].dataType.simpleString()
    used = events.select("medicine_id", F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"))
    used = used.mapInPandas(_added_up, used.schema)
    start = stock.select(
        F.col("medicine_id").cast(kind).alias("medicine_id"), "medicine_name", F.col("current_inventory").cast("double"), F.col("reorder_point").cast("double")
    )
    return used.groupBy("medicine_id").transformWithStateInPandas(
        statefulProcessor=StockLevel(mode),
        outputStructType=f"medicine_id {kind}, medicine_name string, total_quantity double, opening double, current_inventory double, reorder_point double, raised boolean",
        outputMode="Update",
        timeMode="None",
        initialState=start.groupBy("medicine_id"),
    )


def deplete(events: DataFrame, stock: DataFrame, folder: str, checkpoint: str, mode: str = "first") -> DataStreamWriter:
    """Keep stock levels and alerts current while events arrive. Each micro-batch writes, under its own id,

    * ``stock``: total consumed and stock left (clamped at zero) of the changed items with opening stock;
    * ``unknown``: total consumed of the changed items without, and the reason;
    * ``alerts``: low-stock alerts of the changed items that are below their reorder point. By ``mode``, ``first``
      alerts an item once; ``crossing`` once, and only if it was not below at the opening (stock only falls, so an
      item crosses once); ``every`` in each batch in which it was dispensed.

    Batches that are retried overwrite their own directories. Needs the state provider of ``sliding``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(f"{folder}/levels/{at}")
        levels = spark.read.schema(batch.schema).parquet(f"{folder}/levels/{at}")
        known = levels.filter("opening is not null")
        known.drop("raised").write.mode("overwrite").parquet(f"{folder}/stock/{at}")
        unknown = levels.filter("opening is null").select("medicine_id", "total_quantity", F.lit(UNKNOWN).alias("reason"))
        unknown.write.mode("overwrite").parquet(f"{folder}/unknown/{at}")
        raised = raise_low_stock(known.filter("raised"), F.current_timestamp(), "warning").select(*ALERT_COLUMNS)
        raised.write.mode("overwrite").parquet(f"{folder}/alerts/{at}")

    return stock_levels(events, stock, mode).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
