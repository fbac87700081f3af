"""Orders as interchange text (EDI 850) and JSON, one column expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.sources.history import MICROS

SEGMENT_END = "~"
MESSAGES_A_FILE = 200_000


def _line(number: Column, item: Column, quantity: Column, cost: Column) -> Column:
    """PO1 segment of one order line."""
    parts = ["PO1", number.cast("string"), quantity.cast("string"), "EA", F.coalesce(cost, F.lit(0.0)).cast("string"), "", "VP", item.cast("string")]
    return F.concat_ws("*", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def edi_850_of_lines(lines: DataFrame) -> DataFrame:
    """(order_id, value): one message per order with a PO1 segment for each of its lines.

    ``lines`` has ``order_id, line, medicine_id, quantity, unit_cost, created_at`` and is dated by its first line. An
    order's lines are put together in one row, as the message needs them; lines are ordered by number, then item.
    """
    line = F.struct("line", "medicine_id", "quantity", "unit_cost")
    orders = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.min("created_at").alias("created_at"))
    numbered = F.transform("lines", lambda x, i: _line(i + 1, x["medicine_id"], x["quantity"], x["unit_cost"]))
    return orders.select("order_id", edi_850(orders, numbered).alias("value"))


def edi_850(orders: DataFrame, lines: Column | None = None) -> Column:
    """Purchase order message per row, dated by ``created_at``; ``lines`` are PO1 segments if there is not just one."""
    if lines is None:
        lines = F.array(_line(F.lit(1), F.col("medicine_id"), F.col("quantity"), F.col("unit_cost")))
    at = F.col("created_at")
    day, short_day, time = F.date_format(at, "yyyyMMdd"), F.date_format(at, "yyMMdd"), F.date_format(at, "HHmm")

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in orders.columns else F.lit(default)

    def segment(*parts) -> Column:
        return F.concat_ws("*", *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    blank, sender, receiver = " " * 10, "SENDER", "RECEIVER"
    segments = [
        segment("ISA", "00", blank, "00", blank, "ZZ", sender.ljust(15), "ZZ", receiver.ljust(15),
                short_day, time, "U", "00401", "000000001", "0", "P", ">"),
        segment("GS", "PO", sender, receiver, day, time, "1", "X", "004010"),
        segment("ST", "850", "0001"),
        segment("BEG", "00", "SA", F.col("order_id"), "", day),
        segment("REF", "DP", text("department", "PHARMACY")),
        segment("PER", "BD", text("contact_name", "Pharmacy Manager"), "TE", text("contact_phone", "000-000-0000")),
        F.concat_ws(SEGMENT_END + "\n", lines),
        segment("CTT", F.size(lines).cast("string")),
        segment("SE", (F.size(lines) + 6).cast("string"), "0001"),
        segment("GE", "1", "1"),
        segment("IEA", "1", "000000001"),
    ]
    return F.concat(F.concat_ws(SEGMENT_END + "\n", *segments), F.lit(SEGMENT_END))


def write_messages(messages: DataFrame, path: str) -> None:
    """One message (``value``) per record, compressed; the record separator cannot occur inside a message.

    A compressed file is read by one task, so a file ends after ``MESSAGES_A_FILE`` messages.
    """
    out = messages.select("value").write.mode("overwrite").option("lineSep", "\n\n")
    out.option("compression", "gzip").option("maxRecordsPerFile", MESSAGES_A_FILE).text(path)


def export_edi(orders: DataFrame, path: str) -> None:
    write_messages(orders.select(edi_850(orders).alias("value")), path)


def read_edi(spark: SparkSession, path: str) -> DataFrame:
    """Messages of plain or compressed files."""
    return spark.read.option("lineSep", "\n\n").text(path)


def parse_edi(messages: DataFrame, column: str = "value") -> DataFrame:
    """A row per order line of each message; segments are trimmed before they are recognised.

    A message without any line gives one row, with zeros and empty texts for what it lacks.
    """
    segments = F.transform(F.split(F.col(column), SEGMENT_END), lambda s: F.trim(F.regexp_replace(s, "[\r\n]", "")))

    def tagged(tag: str) -> Column:
        return F.filter(segments, lambda s: s.startswith(tag + "*"))

    def field(match: Column, index: int) -> Column:
        return F.get(F.split(match, r"\*"), F.lit(index))

    lines = messages.select(
        F.coalesce(field(F.get(tagged("BEG"), F.lit(0)), 3), F.lit("")).alias("order_id"), F.explode_outer(tagged("PO1")).alias("_line")
    )
    return lines.select(
        "order_id",
        F.coalesce(field(F.col("_line"), 2).try_cast("double"), F.lit(0.0)).alias("quantity"),
        F.coalesce(field(F.col("_line"), 4).try_cast("double"), F.lit(0.0)).alias("unit_cost"),
        F.coalesce(field(F.col("_line"), 7), F.lit("")).alias("medicine_id"),
    )


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": MICROS}).alias(name))


def from_json(df: DataFrame, schema: T.StructType | str, name: str = "json") -> DataFrame:
    return df.select(F.from_json(name, schema, {"timestampFormat": MICROS}).alias("_r")).select("_r.*")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", MICROS).json(path)


def import_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", MICROS).json(path)
