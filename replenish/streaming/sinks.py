"""Table sinks for streams, and runners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from replenish.params import Params
from replenish.sources.ids import first_of_each

BATCH = "batch_id"


def append_table(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Final rows, each written once (append mode)."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def _write_batch(path: str, keys: list[str] | None, every: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        if keys and batch_id % every == every - 1:
            compact(batch.sparkSession, path, keys)

    return write


def changes_table(df: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, every: int = 64) -> DataStreamWriter:
    """Changed groups per micro-batch (update mode); a retried batch overwrites its own directory.

    With ``keys`` the table is brought down to the newest rows after each ``every`` batches, so that what
    :func:`current` reads is the groups and ``every`` batches, however long the stream has run.
    """
    write = _write_batch(path, keys, every)
    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def unique_table(df: DataFrame, path: str, checkpoint: str, key: str) -> DataStreamWriter:
    """Rows whose id came in no batch before, at any distance; rows without an id all stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        first_of_each(batch, key, f"{path}_ids", batch_id).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def batches(spark: SparkSession, path: str) -> list[str]:
    """Folder values of the batches that a table of changes has, in order; merged ones end in a half."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    return sorted((n.split("=")[1] for n in names if n.startswith(f"{BATCH}=")), key=float)


def compact(spark: SparkSession, path: str, keys: list[str], keep: int = 1) -> None:
    """Bring a table of changes down to the newest row of each group, but for its last ``keep`` batches.

    The merged rows appear by one rename, as a batch between the newest that they come from and the next, and
    the older folders go after that. Whenever it is broken off, the newest row of every group is still there.
    """
    old = batches(spark, path)[: -keep or None]
    if len(old) < 2:
        return
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{BATCH}={n}" for n in old])
    latest(rows, keys).write.mode("overwrite").parquet(f"{path}/_merged")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    merged = f"{int(float(old[-1]))}.5"
    if merged in old:
        merged = f"{merged}5"
    fs.rename(at(f"{path}/_merged"), at(f"{path}/{BATCH}={merged}"))
    for n in old:
        fs.delete(at(f"{path}/{BATCH}={n}"), True)


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state of a table of changes: its last merged batch and the newer ones."""
    names = batches(spark, path)
    merged = [i for i, n in enumerate(names) if "." in n]
    wanted = names[merged[-1] if merged else 0 :]
    return latest(spark.read.option("basePath", path).parquet(*[f"{path}/{BATCH}={n}" for n in wanted]), keys)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each group."""
    rest = [c for c in rows.columns if c not in keys and c != BATCH]
    newest = F.max_by(F.struct(*rest), BATCH)
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def every(writer: DataStreamWriter, params: Params = Params(), seconds: int | None = None) -> StreamingQuery:
    """Start with a processing-time trigger, by default the slide interval."""
    return writer.trigger(processingTime=f"{seconds or params.slide} seconds").start()


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is available now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped for lateness over the progress reports kept by the query."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
