"""Reading and writing history, catalog, forecast and export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.functions import scalars as S
from replenish.operators.projections import history_between
from replenish.schema import PRESCRIPTIONS
from replenish.sources.ids import first_of_each

CORRUPT = "_corrupt_record"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # text files keep microseconds


def read_history_csv(spark: SparkSession, path: str, schema: T.StructType = PRESCRIPTIONS) -> DataFrame:
    """History CSV under an explicit schema; unparsable lines keep their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("timestampFormat", MICROS).csv(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_history(rx: DataFrame, path: str, mode: str = "overwrite") -> None:
    """History as parquet partitioned by day. Small days share a writer task, a large one is split over as many as its size asks for."""
    dated = rx.withColumn("date", F.to_date("timestamp"))
    dated.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def write_history_csv(rx: DataFrame, path: str, mode: str = "overwrite") -> None:
    rx.write.mode(mode).option("header", True).option("timestampFormat", MICROS).csv(path)


def _rejected() -> Column:
    return F.col("medicine_id").isNull() | F.col("quantity").isNull()


def rejected_rows(raw: DataFrame) -> DataFrame:
    """The rows that the prescription table can't take, as they came, with the reason."""
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("medicine_id", "quantity")])
    return raw.filter(_rejected()).withColumn("reject_reason", F.concat(F.lit("missing: "), missing))


def prescription_rows(raw: DataFrame, now: Column | None = None, batch_id: int = 0) -> DataFrame:
    """Rows as the prescription table stores them: defaults for what is missing, item and quantity required.

    A row without an id gets one from its time, the batch and its place in it, so equal rows stay apart and a
    retried batch gives the same ids. What lacks item or quantity is in :func:`rejected_rows`.
    """
    now = F.current_timestamp() if now is None else now

    def default(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value) if name in raw.columns else value

    stamp = default("timestamp", now)
    place = F.lit(batch_id).cast("bigint"), F.monotonically_increasing_id()
    ident = F.concat_ws("-", S.millis_id("RX", stamp), *[c.cast("string") for c in place])
    return raw.filter(~_rejected()).select(
        (F.coalesce(F.col("prescription_id").cast("string"), ident) if "prescription_id" in raw.columns else ident).alias(
            "prescription_id"
        ),
        "medicine_id",
        "quantity",
        default("patient_age", F.lit(0)).cast("bigint").alias("patient_age"),
        default("is_emergency", F.lit(False)).alias("is_emergency"),
        default("insurance", F.lit("No")).alias("insurance"),
        default("location", F.lit("Store1")).alias("location"),
        stamp.alias("timestamp"),
    )


def append_prescriptions(batch: DataFrame, path: str, batch_id: int) -> None:
    """Micro-batch append that is safe to retry: a batch owns its directory.

    Rows that repeat an id of their sender are stored once over all batches (the ids lie under ``<path>_ids``); ids made
    here are unique and rows that need one all stay. Rejects are kept with their reason under ``<path>_rejects``.
    """
    if "prescription_id" in batch.columns:
        good = batch.filter(~_rejected()).withColumn("prescription_id", F.col("prescription_id").cast("string"))
        rows = prescription_rows(first_of_each(good, "prescription_id", f"{path}_ids", batch_id), batch_id=batch_id)
    else:
        rows = prescription_rows(batch, batch_id=batch_id)
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    rejected_rows(batch).write.mode("overwrite").parquet(f"{path}_rejects/batch={batch_id}")


def medicine_rows(medicines: DataFrame) -> DataFrame:
    """The catalog projection that item lists are served from."""
    return medicines.select("medicine_id", "medicine_name", "category", "unit_price")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality reaches the parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def write_forecasts(forecasts: DataFrame, path: str, run_date: str) -> None:
    """One directory per run, replaced as a whole when the run is repeated."""
    forecasts.write.mode("overwrite").parquet(f"{path}/run_date={run_date}")


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def not_yet_forecast(items: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Items that no stored run covers (the rest is served from the table)."""
    return items.join(forecasts.select("medicine_id").distinct(), "medicine_id", "left_anti")


def export_history(rx: DataFrame, start: str, end: str, fmt: str, path: str) -> None:
    if fmt not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"unsupported format: {fmt}")
    writer = history_between(rx, start, end).write.mode("overwrite").format(fmt).option("timestampFormat", MICROS)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
