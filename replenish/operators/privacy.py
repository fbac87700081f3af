"""Utility and disclosure measures of a synthetic or perturbed release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import draws
from replenish.functions import scalars as S
from replenish.operators.aggregates import value_share
from replenish.operators.joins import align_shares
from replenish.params import Params


def common_categories(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Categories that both have."""
    # each side's few values meet, not its rows
    return original.select("category").distinct().intersect(synthetic.select("category").distinct())


def numeric_similarity(original: DataFrame, synthetic: DataFrame, columns: tuple[str, ...] = ("quantity", "patient_age")) -> DataFrame:
    """``1 - |a - b| / a`` of mean and sample deviation, one row per measure; NULL where ``a`` is zero."""

    def moments(df: DataFrame) -> Column:
        parts = [F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns]
        return df.agg(F.struct(*parts)).scalar()

    one = original.sparkSession.range(1).select(moments(original).alias("a"), moments(synthetic).alias("b"))
    rows = [
        F.struct(
            F.lit(f"{c}_{m}_similarity").alias("metric"),
            (F.lit(1.0) - F.try_divide(F.abs(F.col(f"a.{c}.{m}") - F.col(f"b.{c}.{m}")), F.col(f"a.{c}.{m}"))).alias("value"),
        )
        for c in columns
        for m in ("mean", "std")
    ]
    return one.select(F.inline(F.array(*rows)))


def distribution_similarity(original: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """``exp(-KL)`` of the value shares over common values."""
    both = align_shares(value_share(original, column), value_share(synthetic, column), "value", outer=False)
    kl = F.sum(F.col("share_a") * F.ln(F.col("share_a") / F.col("share_b")))
    return both.agg(F.exp(-F.coalesce(kl, F.lit(0.0))).alias("value")).select(
        F.lit(f"{column}_distribution_similarity").alias("metric"), "value"
    )


def hourly_shares(df: DataFrame) -> DataFrame:
    return value_share(df.select(F.hour("timestamp").alias("hour")), "hour", "hour")


def temporal_similarity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Correlation of the hourly shares, hours of either side included."""
    both = align_shares(hourly_shares(original), hourly_shares(synthetic), "hour", outer=True)
    return both.agg(F.corr("share_a", "share_b").alias("value")).select(
        F.lit("temporal_pattern_similarity").alias("metric"), "value"
    )


def utility_metrics(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    out = numeric_similarity(original, synthetic)
    for column in ("category", "location"):
        out = out.unionByName(distribution_similarity(original, synthetic, column))
    return out.unionByName(temporal_similarity(original, synthetic))


def with_overall(metrics: DataFrame) -> DataFrame:
    """The measures plus their mean, undefined ones left out."""
    defined = F.when(~F.isnan("value"), F.col("value"))
    overall = metrics.agg(F.avg(defined).alias("value")).select(F.lit("overall_utility").alias("metric"), "value")
    return metrics.unionByName(overall)


def unique_ratio(df: DataFrame) -> DataFrame:
    return df.agg((F.count_distinct("prescription_id") / F.count("*")).alias("unique_identifier_ratio"))


def rare_combinations(df: DataFrame) -> DataFrame:
    groups = df.groupBy("medicine_id", "patient_age").agg(F.count("*").alias("n"))
    return groups.agg((F.count_if(F.col("n") == 1) / F.count("*")).alias("rare_combination_ratio"))


def k_anonymity(df: DataFrame) -> DataFrame:
    groups = df.groupBy("patient_age", "location").agg(F.count("*").alias("n"))
    return groups.agg(F.min("n").alias("min_k_anonymity"), F.avg("n").alias("avg_k_anonymity"))


def privacy_risk(df: DataFrame) -> DataFrame:
    """One row of disclosure measures; independent aggregates joined as scalars."""
    groups = df.groupBy("patient_age", "location").agg(F.count("*").alias("n"))
    kk = groups.agg(F.struct(F.min("n").alias("low"), F.avg("n").alias("mean"))).scalar()
    rare = rare_combinations(df).scalar()
    return unique_ratio(df).select(
        "unique_identifier_ratio",
        rare.alias("rare_combination_ratio"),
        kk["low"].alias("min_k_anonymity"),
        kk["mean"].alias("avg_k_anonymity"),
    ).withColumn("overall_privacy_score", F.lit(1.0) - F.col("rare_combination_ratio"))


def laplace_release(rx: DataFrame, key: list[Column], params: Params = Params(), sensitivity: float = 1.0) -> DataFrame:
    """Differentially private copy: noisy quantity (truncated, at least 1) and an age band."""
    noise = draws.laplace(sensitivity / params.epsilon, draws.uniform(f"dp{params.seed}", *key))
    noisy = (F.col("quantity") + noise).cast("bigint")
    return rx.withColumn("quantity", F.greatest(F.lit(1), noisy)).withColumn("age_group", S.age_band(F.col("patient_age")))


def assessment(utility: Column, privacy: Column, params: Params = Params()) -> Column:
    good_utility, good_privacy = utility >= params.utility_threshold, privacy >= params.privacy_threshold
    return (
        F.when(good_utility & good_privacy, "EXCELLENT: High utility with strong privacy guarantees")
        .when(good_utility, "GOOD: Meets utility threshold, privacy can be improved")
        .when(good_privacy, "FAIR: Good privacy, but utility below threshold")
        .otherwise("NEEDS IMPROVEMENT: Both utility and privacy need attention")
    )


def privacy_report(original: DataFrame, synthetic: DataFrame, params: Params = Params()) -> DataFrame:
    metrics = with_overall(utility_metrics(original, synthetic))
    utility = metrics.filter("metric = 'overall_utility'").select("value").scalar()
    return (
        privacy_risk(synthetic)
        .withColumn("epsilon", F.lit(params.epsilon))
        .withColumn("original_rows", original.agg(F.count("*")).scalar())
        .withColumn("synthetic_rows", synthetic.agg(F.count("*")).scalar())
        .withColumn("overall_utility", utility)
        .withColumn("meets_utility_threshold", F.col("overall_utility") >= params.utility_threshold)
        .withColumn("assessment", assessment(F.col("overall_utility"), F.col("overall_privacy_score"), params))
    )
