"""Co-occurrence of items in baskets, as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.operators.joins import skew_safe_join, spread_by_item
from replenish.operators.ranking import first_per_group
from replenish.session import stored


def basket_items(rx: DataFrame) -> DataFrame:
    """Distinct items per basket, stored for the steps that read them."""
    return stored(rx.select("basket_id", "medicine_id").distinct(), "basket-items")


def basket_pairs(items: DataFrame, block: int = 256) -> DataFrame:
    """Item pairs ``a < b`` of each basket, every pair once.

    A basket of up to ``block`` items is put together in one row, which gives its pairs without a
    join. A larger one is cut into hash blocks and its pairs are produced per pair of blocks, so even
    one giant basket is spread over many tasks of at most about ``block * block`` pairs. Items that
    several steps read (see :func:`basket_items`) are stored first.
    """
    # a basket's pairs are many times its rows: a fixed number of tasks, which aren't merged by size
    items = spread_by_item(items, "basket_id")
    big = items.groupBy("basket_id").agg(F.count("*").alias("_k")).filter(F.col("_k") > block)
    sized = skew_safe_join(items, big, "basket_id", "left")
    own = sized.filter("_k is null and basket_id is not null and medicine_id is not null")
    whole = own.groupBy("basket_id").agg(F.sort_array(F.collect_list("medicine_id")).alias("_items"))
    firsts = whole.select("basket_id", "_items", F.posexplode("_items").alias("_at", "med1"))
    after = F.slice("_items", F.col("_at") + 2, F.size("_items"))
    near = firsts.select("basket_id", "med1", F.explode(after).alias("med2")).filter("med1 < med2")
    sized = sized.filter("_k is not null")
    blocks = F.ceil(F.col("_k") / F.lit(block)).cast("int")
    cut = sized.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("medicine_id"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = cut.select("basket_id", F.col("medicine_id").alias("med1"), F.col("_own").alias("_i"), other.alias("_j"))
    right = cut.select("basket_id", F.col("medicine_id").alias("med2"), other.alias("_i"), F.col("_own").alias("_j"))
    far = left.join(right, ["basket_id", "_i", "_j"]).filter("med1 < med2").select("basket_id", "med1", "med2")
    return near.union(far)


def vertex_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("medicine_id").agg(F.count("*").alias("n"))


def edge_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("med1", "med2").agg(F.count("*").alias("n"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; mirrored after counting, so only counted edges are doubled."""
    there, back = F.struct("med1", "med2"), F.struct(F.col("med2").alias("med1"), F.col("med1").alias("med2"))
    return edges.select(F.explode(F.array(there, back)).alias("_e"), "n").select("_e.med1", "_e.med2", "n")


def association_scores(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge count over the smaller of the two item counts."""
    first = vertices.select(F.col("medicine_id").alias("med1"), F.col("n").alias("n1"))
    second = vertices.select(F.col("medicine_id").alias("med2"), F.col("n").alias("n2"))
    joined = skew_safe_join(skew_safe_join(edges, first, "med1"), second, "med2")
    score = F.coalesce(F.try_divide(F.col("n"), F.least("n1", "n2")), F.lit(0.0))
    return joined.select("med1", "med2", "n", "n1", "n2", score.alias("score"))


def top_partners(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent partners of every item; ties by partner id."""
    return first_per_group(symmetric(edges), ["med1"], [F.desc("n"), F.asc("med2")], k)
