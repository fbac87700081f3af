"""Stream readers and writers: a JSON topic, or a folder of files under the same contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from replenish.schema import PRESCRIPTIONS
from replenish.sources.history import CORRUPT, MICROS

TEXT = {"timestampFormat": MICROS}


UNKNOWN = "unknown"


def _parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**TEXT, "columnNameOfCorruptRecord": CORRUPT}
    text = F.col("value").cast("string")
    return raw.select(text.alias("_text"), F.from_json(text, full, options).alias("_e"))


def _broken() -> Column:
    return F.col("_e").isNull() | F.col(f"_e.{CORRUPT}").isNotNull()


def decode(raw: DataFrame, schema: T.StructType = PRESCRIPTIONS) -> DataFrame:
    """JSON bytes or text in ``value`` to typed columns. A record without item counts as ``unknown``; what is no
    JSON of the schema is in :func:`undecodable`."""
    good = _parsed(raw, schema).filter(~_broken()).select("_e.*").drop(CORRUPT)
    if isinstance(good.schema["medicine_id"].dataType, T.StringType):
        good = good.withColumn("medicine_id", F.coalesce("medicine_id", F.lit(UNKNOWN)))
    return good


def undecodable(raw: DataFrame, schema: T.StructType = PRESCRIPTIONS) -> DataFrame:
    """(value, reason): the records that :func:`decode` can't take, for a table of their own."""
    reason = F.when(F.col("_text").isNull(), "no value").otherwise("no JSON of the schema")
    return _parsed(raw, schema).filter(_broken()).select(F.col("_text").alias("value"), reason.alias("reason"))


def encode(events: DataFrame) -> DataFrame:
    """Events as JSON in ``value``, keyed by item so that a topic partitions by it."""
    return events.select(
        F.col("medicine_id").cast("string").alias("key"), F.to_json(F.struct(*events.columns), TEXT).alias("value")
    )


def topic_reader(
    spark: SparkSession, servers: str, topic: str = "prescriptions", schema: T.StructType = PRESCRIPTIONS, start: str = "latest"
) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", start).load()
    )
    return decode(raw, schema)


def topic_writer(events: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (
        encode(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def json_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def text_folder(spark: SparkSession, path: str, schema: T.StructType = PRESCRIPTIONS) -> DataFrame:
    """Folder of JSON lines decoded exactly like a topic."""
    return decode(spark.readStream.text(path), schema)


def json_writer(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Spark's file systems is a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
