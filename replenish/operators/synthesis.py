"""Synthetic data as functions of hashed row numbers, generated in parallel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.functions import draws
from replenish.functions import scalars as S
from replenish.operators.joins import pick_by_interval
from replenish.operators.windows import cumulative_counts
from replenish.params import Params
from replenish.session import stored


@dataclass
class Marginals:
    numeric: DataFrame
    medicine: DataFrame
    location: DataFrame
    hour: DataFrame
    category_of: DataFrame


def fit(rx: DataFrame) -> Marginals:
    """Marginals of a history, counted in one pass over it and stored, so that sampling never rescans it."""
    sides = ["medicine_id", "category", "location", "hour"]
    numeric = ["quantity", "patient_age"]
    moments = [
        F.struct(
            F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        )
        for c in numeric
    ]
    rows = rx.select(*sides[:3], F.hour("timestamp").alias("hour"), *numeric)
    counted = rows.groupingSets([sides[:2], ["location"], ["hour"], []], *sides).agg(
        F.grouping_id().alias("without"), F.count("*").alias("n"), F.array(*moments).alias("m")
    )
    cells = stored(counted, "fit-cells")

    def kept(*columns: str) -> DataFrame:
        return cells.filter(F.col("without") == sum(1 << k for k, c in enumerate(reversed(sides)) if c not in columns))

    def shares(counts: DataFrame, column: str) -> DataFrame:
        counts = counts.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"))
        return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())

    pairs = kept("medicine_id", "category")
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("category")))
    return Marginals(
        numeric=kept().select(F.inline("m")),
        medicine=shares(pairs, "medicine_id"),
        location=shares(kept("location"), "location"),
        hour=shares(kept("hour"), "hour"),
        category_of=pairs.groupBy("medicine_id").agg(best["category"].alias("category")),
    )


def fitted_table(m: Marginals) -> DataFrame:
    """All categorical marginals in one long table ``(column, value, n, share)``."""
    out = None
    for name, df in (("medicine_id", m.medicine), ("location", m.location), ("hour", m.hour)):
        part = df.select(F.lit(name).alias("column"), F.col("value").cast("string").alias("value"), "n", "share")
        out = part if out is None else out.unionByName(part)
    return out


def _pick(rows: DataFrame, counts: DataFrame, name: str, seed: str) -> DataFrame:
    """Adds ``name`` drawn from counted values by inverse distribution function."""
    intervals = cumulative_counts(counts).select(F.col("value").alias(name), "lo", "hi")
    facts = counts.agg(F.struct(F.sum("n").alias("total"), F.count("*").alias("values"))).scalar()
    drawn = rows.withColumn("_draw", draws.below(facts["total"], seed, F.lit(name), F.col("id")))
    cells = F.greatest(facts["values"], F.lit(4096))  # enough cells to spread draws over a few hot values
    return pick_by_interval(drawn, intervals, "_draw", facts["total"], cells).drop("_draw")


def _clipped_normal(numeric: DataFrame, column: str, seed: str) -> Column:
    m = numeric.filter(F.col("column") == column).agg(F.first(F.struct("mean", "std", "min", "max"))).scalar()
    value = m["mean"] + F.coalesce(m["std"], F.lit(0.0)) * draws.normal(f"{seed}{column}", F.col("id"))
    return S.clip_int(value, m["min"], m["max"])


def sample(spark: SparkSession, n: int, m: Marginals, params: Params = Params()) -> DataFrame:
    """``n`` rows drawn from the fitted marginals."""
    seed = f"syn{params.seed}"
    rows = spark.range(n)
    rows = _pick(rows, m.medicine, "medicine_id", seed)
    rows = _pick(rows, m.location, "location", seed)
    rows = _pick(rows, m.hour, "hour", seed)
    of = m.category_of.withColumnRenamed("medicine_id", "_item")
    rows = rows.join(of, F.col("medicine_id").eqNullSafe(F.col("_item")), "left").drop("_item")
    day = F.floor(draws.uniform(seed, F.lit("day"), F.col("id")) * 365).cast("int")
    base = F.lit("2024-01-01").cast("timestamp")
    return rows.select(
        "id",
        F.format_string("SYNTH%06d", "id").alias("prescription_id"),
        "medicine_id",
        "category",
        _clipped_normal(m.numeric, "quantity", seed).alias("quantity"),
        _clipped_normal(m.numeric, "patient_age", seed).alias("patient_age"),
        "location",
        (base + F.make_dt_interval(day, F.col("hour").cast("int"))).alias("timestamp"),
        (draws.uniform(seed, F.lit("emergency"), F.col("id")) < 0.05).alias("is_emergency"),
        F.when(draws.uniform(seed, F.lit("insurance"), F.col("id")) < 0.7, "Yes").otherwise("No").alias("insurance"),
    )


def correlate(rows: DataFrame, strength: float = 0.5) -> DataFrame:
    """Quantity shifted by the age's z-score times ``strength`` deviations, truncated, at least 1."""
    m = rows.agg(
        F.struct(
            F.avg("patient_age").alias("age"),
            F.stddev_samp("patient_age").alias("age_std"),
            F.stddev_samp("quantity").alias("std"),
        )
    ).scalar()
    effect = F.coalesce(F.try_divide(F.col("patient_age") - m["age"], m["age_std"]), F.lit(0.0))
    shifted = F.col("quantity") + effect * F.lit(strength) * m["std"]
    return rows.withColumn("quantity", F.greatest(F.lit(1.0), shifted).cast("bigint"))


def augment(rx: DataFrame, factor: float = 1.5, params: Params = Params()) -> DataFrame:
    """History followed by ``int(n * (factor - 1))`` synthetic rows; columns missing on one side are NULL."""
    n = int(rx.count() * (factor - 1))
    synthetic = sample(rx.sparkSession, n, fit(rx), params).drop("id")
    marked = rx.withColumn("is_synthetic", F.lit(False)).withColumn("prescription_id", F.col("prescription_id").cast("string"))
    return marked.unionByName(synthetic.withColumn("is_synthetic", F.lit(True)), allowMissingColumns=True)
