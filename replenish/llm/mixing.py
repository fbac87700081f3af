"""Mixing sources to target weights with nested hash thresholds.

A row's hash decides whether the mix takes it: a source takes all rows below its threshold. The
threshold is found from sums of tokens by source and hash bucket. Only the bucket that holds the
budget's boundary is divided again, into as many parts, until it holds one hash; rows are never
sorted, and a growing budget only ever adds rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replenish.llm.tables import WORD, broadcast_if_small
from replenish.session import stored

HASH_BITS = 60
LEVEL_BITS = 10
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
# sources up to which their thresholds are sent to every executor; more are joined by a shuffle
BROADCAST_SOURCES = 100_000


def row_hash(*columns: str) -> Column:
    """The first 60 bits of the MD5 of the columns' texts."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash("doc_id", "text").alias("h"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight, target): ``share`` of all sizes by weight, none above ``most`` times its own.

    Sources get the weights in turn, by code point and null last. What a source can't take goes to
    the others by weight until none is above; the driver sees three sums a round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    # one row a source
    sources = stored(totals.withColumn("weight", pick), "mix-sources")
    cap = F.col("source_size") * most
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > cap
        seen = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, cap).otherwise(0)).alias("given"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("long")).alias("capped"),
        ).first()
        if not seen["all"] or not seen["open"] or seen["capped"] == capped:
            break
        capped = seen["capped"]
        level = (share * seen["all"] - seen["given"]) / seen["open"]
    aim = F.lit(0.0) if level is None else F.least(cap.cast("double"), F.col("weight") * level)
    return sources.withColumn("target", aim)


def thresholds(sizes: DataFrame, targets: DataFrame, level_bits: int = LEVEL_BITS) -> DataFrame:
    """``targets`` with ``copies`` taken of every row and ``cut``: rows whose hash is below it are taken once more.

    The row at the boundary is in if that brings the source nearer to its target. Rows with one hash
    (equal rows) are in or out together.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("copies", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("source_size")
    )
    # [low, low + 2^bits) holds the boundary; ``rest`` is the budget from low on
    state = state.withColumn("low", F.lit(0).cast("long")).withColumn("cut", F.lit(None).cast("long"))
    bits = HASH_BITS
    by_source = Window.partitionBy("source").orderBy("bucket")
    while bits > 0:
        state = stored(state, "mix-level")
        open_ = state.filter("cut is null")
        if open_.isEmpty():
            break
        step = min(level_bits, bits)
        near = _with_state(sizes, open_.select("source", "low")).filter(
            (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << bits))
        )
        bits -= step
        histogram = near.groupBy("source", F.shiftright(F.col("h") - F.col("low"), bits).alias("bucket")).agg(
            F.sum("size").alias("mass"), F.min("h").alias("first"), F.max("h").alias("last")
        )
        # at most 2^step rows a source
        run = histogram.withColumn("upto", F.sum("mass").over(by_source)).withColumn("from", F.col("upto") - F.col("mass"))
        run = run.join(open_.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        hit = run.filter("upto > rest").groupBy(F.col("source").alias("s")).agg(
            F.min_by(F.struct("bucket", "from", "mass", "first", "last"), "bucket").alias("b")
        )
        state = state.join(hit, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        nearer = F.col("b.mass") - F.col("rest") + F.col("b.from") < F.col("rest") - F.col("b.from")
        found = (
            F.when(F.col("cut").isNotNull(), F.col("cut"))
            .when(F.col("b").isNull(), F.lit(1 << HASH_BITS))
            .when(F.col("b.first") == F.col("b.last"), F.col("b.first") + nearer.cast("long"))
        )
        state = state.select(
            "source", "source_size", "weight", "target", "copies",
            F.when(F.col("b").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("b.from")).alias("rest"),
            F.when(F.col("b").isNull(), F.col("low")).otherwise(F.col("low") + F.shiftleft(F.col("b.bucket"), bits)).alias("low"),
            found.alias("cut"),
        )
    return state.select("source", "source_size", "target", "copies", "cut")


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the columns of their source's state; sources match null to null."""
    state = broadcast_if_small(state.withColumnRenamed("source", "its_source"), BROADCAST_SOURCES)
    return rows.join(state, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    A null text has size 0 and is taken with 0 words. An empty table gives no rows. Other columns are
    not read.
    """
    sizes = stored(sized(docs), "mix-sizes")
    limits = thresholds(sizes, source_targets(sizes, weights, share, most))
    times = F.col("copies") + (F.col("h") < F.col("cut")).cast("long")
    return _with_state(sizes, limits).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def apply(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns only, whatever these are called.

    Null sources are a source; a null text has size 0; repeated rows are taken each. An empty table gives no rows.
    """
    sizes = stored(sized(docs), "mix-sizes")
    limits = thresholds(sizes, source_targets(sizes, weights, share, most)).select("source", "copies", "cut")
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], "source", row_hash("doc_id", "text").alias("h"))
    times = F.col("copies") + (F.col("h") < F.col("cut")).cast("long")
    rows = _with_state(rows, limits).withColumn("times", times).filter("times > 0")
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()])
