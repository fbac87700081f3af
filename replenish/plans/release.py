"""Privacy measures, synthetic data and co-occurrence over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from replenish.operators import aggregates as A
from replenish.operators import graph as G
from replenish.operators import joins as J
from replenish.operators import privacy as PV
from replenish.operators import synthesis as SY
from replenish.operators import windows as W
from replenish.params import Params
from replenish.plans import inputs  # noqa: F401
from replenish.plans.basics import u_sql
from replenish.plans.registry import common, query
from replenish.plans.tidy import big, r, sql_ts, ts
from replenish.session import stored
from replenish.sources import tables as T

common("evu", "SELECT * REPLACE (user_id AS medicine_id) FROM ev", "ev")


def _intervals(column: str) -> str:
    return f"""SELECT v, n, CAST(sum(n) OVER (ORDER BY md5(CAST(v AS VARCHAR))) AS BIGINT) AS hi FROM (SELECT {column} AS v, count(*) AS n FROM evu GROUP BY 1)"""


def _normal_sql(seed: str, key: str = "id") -> str:
    a, b = u_sql(f"'{seed}a'", key), u_sql(f"'{seed}b'", key)
    return f"sqrt(-2 * ln({a})) * cos(2 * pi() * {b})"


common("iv_med", _intervals("medicine_id"), "evu")
common("iv_loc", _intervals("location"), "evu")
common("iv_hour", _intervals("hour(ts)"), "evu")
common(
    "modal",
    """SELECT medicine_id, category FROM (SELECT medicine_id, category, row_number() OVER (PARTITION BY medicine_id ORDER BY count(*) DESC, category) AS rn
       FROM evu GROUP BY 1, 2) WHERE rn = 1""",
    "evu",
)
common(
    "syn",
    f"""SELECT id, printf('SYNTH%06d', id) AS prescription_id, m.v AS medicine_id, category, greatest(qlo, least(qhi, trunc(qm + qs * {_normal_sql("syn42quantity")}))) AS quantity,
        greatest(alo, least(ahi, trunc(am + asd * {_normal_sql("syn42patient_age")}))) AS patient_age, l.v AS location,
        TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(floor({u_sql("'syn42'", "'day'", "id")} * 365) AS INT) + INTERVAL 1 HOUR * CAST(h.v AS INT) AS ts,
        {u_sql("'syn42'", "'emergency'", "id")} < 0.05 AS is_emergency, CASE WHEN {u_sql("'syn42'", "'insurance'", "id")} < 0.7 THEN 'Yes' ELSE 'No' END AS insurance
        FROM (SELECT id, n, floor({u_sql("'syn42'", "'medicine_id'", "id")} * n) AS d1, floor({u_sql("'syn42'", "'location'", "id")} * n) AS d2, floor({u_sql("'syn42'", "'hour'", "id")} * n) AS d3,
                qm, qs, qlo, qhi, am, asd, alo, ahi FROM (SELECT unnest(range((SELECT count(*) FROM evu))) AS id),
                (SELECT count(*) AS n, avg(quantity) AS qm, stddev_samp(quantity) AS qs, min(quantity) AS qlo, max(quantity) AS qhi, avg(patient_age) AS am,
                   stddev_samp(patient_age) AS asd, min(patient_age) AS alo, max(patient_age) AS ahi FROM evu)) x
        ASOF JOIN (SELECT v, hi - n AS lo FROM iv_med) m ON d1 >= m.lo ASOF JOIN (SELECT v, hi - n AS lo FROM iv_loc) l ON d2 >= l.lo ASOF JOIN (SELECT v, hi - n AS lo FROM iv_hour) h ON d3 >= h.lo
        JOIN modal ON modal.medicine_id = m.v""",
    "evu",
    "iv_med",
    "iv_loc",
    "iv_hour",
    "modal",
)


def history(spark, d):
    return T.event_history(spark, d, "user_id")


def synthetic(spark, d):
    """As many synthetic rows as the history has, stored because every measure reads them."""
    rx = history(spark, d)
    return stored(SY.sample(spark, rx.count(), SY.fit(rx)), "synthetic")


# ---------------------------------------------------------------- synthesis


@query(
    "syn1_fitted_marginals",
    """SELECT 'medicine_id' AS "column", CAST(medicine_id AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM evu), 8) AS share FROM evu GROUP BY 2
       UNION ALL SELECT 'location', location, count(*), round(count(*) / (SELECT count(*) FROM evu), 8) FROM evu GROUP BY 2
       UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*), round(count(*) / (SELECT count(*) FROM evu), 8) FROM evu GROUP BY 2""",
    ("evu",),
)
def syn1(spark, d):
    return SY.fitted_table(SY.fit(history(spark, d))).withColumn("share", r("share", 8))


@query(
    "syn2_sample",
    f"""SELECT prescription_id, medicine_id, category, quantity, patient_age, location, {sql_ts("ts")} AS "timestamp", is_emergency, insurance FROM syn""",
    ("syn",),
)
def syn2(spark, d):
    return synthetic(spark, d).drop("id").withColumn("timestamp", ts("timestamp"))


@query("join8_category_of_sampled_item", "SELECT category, count(*) AS n FROM syn GROUP BY 1", ("syn",))
def join8(spark, d):
    return synthetic(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "join12_interval_join",
    f"""SELECT id, medicine_id FROM (SELECT unnest(range((SELECT count(*) FROM disp))) AS id, (SELECT count(*) FROM disp) AS n) x
        JOIN (SELECT medicine_id, n AS k, CAST(sum(n) OVER (ORDER BY md5(CAST(medicine_id AS VARCHAR))) AS BIGINT) AS hi FROM (SELECT medicine_id, count(*) AS n FROM disp GROUP BY 1)) m
        ON floor({u_sql("'pick42'", "id")} * x.n) >= hi - k AND floor({u_sql("'pick42'", "id")} * x.n) < hi""",
    ("disp",),
)
def join12(spark, d):
    """Items drawn in proportion to their history, as many draws as there are prescriptions."""
    from replenish.functions import draws

    rx = T.dispensing(spark, d)
    counts = rx.groupBy("medicine_id").agg(F.count("*").alias("n"))
    facts = counts.agg(F.struct(F.sum("n").alias("total"), F.count("*").alias("values"))).scalar()
    rows = spark.range(rx.count()).withColumn("_draw", draws.below(facts["total"], "pick42", F.col("id")))
    intervals = W.cumulative_counts(counts, "medicine_id").select("medicine_id", "lo", "hi")
    cells = F.greatest(facts["values"], F.lit(4096))
    return J.pick_by_interval(rows, intervals, "_draw", facts["total"], cells).select("id", "medicine_id")


@query(
    "syn3_correlated",
    """SELECT prescription_id, CAST(trunc(greatest(1, quantity + coalesce((patient_age - am) / nullif(asd, 0), 0) * 0.5 * qs)) AS BIGINT) AS quantity
       FROM syn, (SELECT avg(patient_age) AS am, stddev_samp(patient_age) AS asd, stddev_samp(quantity) AS qs FROM syn)""",
    ("syn",),
)
def syn3(spark, d):
    return SY.correlate(synthetic(spark, d)).select("prescription_id", "quantity")


@query(
    "set1_augmented",
    """SELECT false AS is_synthetic, CAST(prescription_id AS VARCHAR) AS prescription_id, medicine_id, quantity, location FROM evu
       UNION ALL SELECT true, prescription_id, medicine_id, quantity, location FROM syn WHERE id < (SELECT trunc(count(*) * 0.5) FROM evu)""",
    ("evu", "syn"),
)
def set1(spark, d):
    return SY.augment(history(spark, d), 1.5).select("is_synthetic", "prescription_id", "medicine_id", "quantity", "location")


@query(
    "set2_common_categories",
    "SELECT DISTINCT category FROM evu INTERSECT SELECT DISTINCT category FROM syn",
    ("evu", "syn"),
)
def set2(spark, d):
    return PV.common_categories(history(spark, d), synthetic(spark, d))


# ---------------------------------------------------------------- privacy

NUMERIC_SQL = """SELECT 'quantity_mean_similarity' AS metric, 1 - abs(a.qm - b.qm) / a.qm AS value FROM a, b UNION ALL
   SELECT 'quantity_std_similarity', 1 - abs(a.qs - b.qs) / a.qs FROM a, b UNION ALL SELECT 'patient_age_mean_similarity', 1 - abs(a.am - b.am) / a.am FROM a, b
   UNION ALL SELECT 'patient_age_std_similarity', 1 - abs(a.asd - b.asd) / a.asd FROM a, b"""
for name, source in (("a", "evu"), ("b", "syn")):
    common(
        name,
        f"SELECT avg(quantity) AS qm, stddev_samp(quantity) AS qs, avg(patient_age) AS am, stddev_samp(patient_age) AS asd FROM {source}",
        source,
    )


def _share_sql(source: str, expr: str) -> str:
    return f"(SELECT {expr} AS v, count(*) / (SELECT count(*) FROM {source}) AS p FROM {source} GROUP BY 1)"


def _kl_sql(column: str) -> str:
    return f"""SELECT '{column}_distribution_similarity' AS metric, exp(-coalesce(sum(x.p * ln(x.p / y.p)), 0)) AS value
      FROM {_share_sql("evu", column)} x JOIN {_share_sql("syn", column)} y ON y.v = x.v"""


common("kl", f"{_kl_sql('category')} UNION ALL {_kl_sql('location')}", "evu", "syn")
common(
    "temporal",
    f"""SELECT 'temporal_pattern_similarity' AS metric, corr(coalesce(x.p, 0), coalesce(y.p, 0)) AS value
        FROM {_share_sql("evu", "hour(ts)")} x FULL JOIN {_share_sql("syn", "hour(ts)")} y ON y.v = x.v""",
    "evu",
    "syn",
)
common("numeric", NUMERIC_SQL, "a", "b")
common("metrics", "SELECT * FROM numeric UNION ALL SELECT * FROM kl UNION ALL SELECT * FROM temporal", "numeric", "kl", "temporal")
common(
    "risk",
    """SELECT (SELECT count(DISTINCT prescription_id) / count(*) FROM syn) AS uniq, (SELECT sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) FROM (SELECT count(*) AS n FROM syn GROUP BY medicine_id, patient_age)) AS rare,
       min(n) AS low, avg(n) AS mean FROM (SELECT count(*) AS n FROM syn GROUP BY patient_age, location)""",
    "syn",
)


@query("prv1_numeric_similarity", "SELECT metric, round(value, 6) AS value FROM numeric", ("numeric",))
def prv1(spark, d):
    return PV.numeric_similarity(history(spark, d), synthetic(spark, d)).select("metric", r("value", 6))


@query("prv2_join9_distribution_similarity", "SELECT metric, round(value, 6) AS value FROM kl", ("kl",))
def prv2(spark, d):
    a, b = history(spark, d), synthetic(spark, d)
    both = PV.distribution_similarity(a, b, "category").unionByName(PV.distribution_similarity(a, b, "location"))
    return both.select("metric", r("value", 6))


@query("prv3_temporal_similarity", "SELECT metric, round(value, 6) AS value FROM temporal", ("temporal",))
def prv3(spark, d):
    return PV.temporal_similarity(history(spark, d), synthetic(spark, d)).select("metric", r("value", 6))


@query(
    "join10_hourly_alignment",
    f"""SELECT coalesce(x.v, y.v)::INT AS hour, round(coalesce(x.p, 0), 8) AS share_a, round(coalesce(y.p, 0), 8) AS share_b
        FROM {_share_sql("evu", "hour(ts)")} x FULL JOIN {_share_sql("syn", "hour(ts)")} y ON y.v = x.v""",
    ("evu", "syn"),
)
def join10(spark, d):
    both = J.align_shares(PV.hourly_shares(history(spark, d)), PV.hourly_shares(synthetic(spark, d)), "hour", outer=True)
    return both.select("hour", r("share_a", 8), r("share_b", 8))


@query(
    "prv4_utility",
    "SELECT metric, round(value, 6) AS value FROM metrics UNION ALL SELECT 'overall_utility', round(avg(value), 6) FROM metrics",
    ("metrics",),
)
def prv4(spark, d):
    return PV.with_overall(PV.utility_metrics(history(spark, d), synthetic(spark, d))).select("metric", r("value", 6))


@query("prv5_unique_ratio", "SELECT round(count(DISTINCT prescription_id) / count(*), 8) AS unique_identifier_ratio FROM rx", ("rx",))
def prv5(spark, d):
    return PV.unique_ratio(T.prescriptions(spark, d)).select(r("unique_identifier_ratio", 8))


@query(
    "prv6_rare_combinations",
    "SELECT round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 8) AS rare_combination_ratio FROM (SELECT count(*) AS n FROM rx GROUP BY medicine_id, patient_age)",
    ("rx",),
)
def prv6(spark, d):
    return PV.rare_combinations(T.prescriptions(spark, d)).select(r("rare_combination_ratio", 8))


@query(
    "prv7_k_anonymity",
    "SELECT min(n) AS min_k_anonymity, round(avg(n), 6) AS avg_k_anonymity FROM (SELECT count(*) AS n FROM rx GROUP BY patient_age, location)",
    ("rx",),
)
def prv7(spark, d):
    return PV.k_anonymity(T.prescriptions(spark, d)).select("min_k_anonymity", r("avg_k_anonymity", 6))


@query(
    "prv8_privacy_score",
    "SELECT round(uniq, 8) AS unique_identifier_ratio, low AS min_k_anonymity, round(1 - rare, 8) AS overall_privacy_score FROM risk",
    ("risk",),
)
def prv8(spark, d):
    return PV.privacy_risk(synthetic(spark, d)).select(
        r("unique_identifier_ratio", 8), "min_k_anonymity", r("overall_privacy_score", 8)
    )


@query(
    "prv9_private_release",
    f"""SELECT prescription_id, greatest(1, CAST(trunc(quantity - sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))) AS BIGINT)) AS quantity,
        CASE WHEN patient_age < 18 THEN '0-17' WHEN patient_age < 35 THEN '18-34' WHEN patient_age < 50 THEN '35-49' WHEN patient_age < 65 THEN '50-64' ELSE '65+' END AS age_group
        FROM (SELECT *, {u_sql("'dp42'", "prescription_id")} AS u FROM evu)""",
    ("evu",),
)
def prv9(spark, d):
    return PV.laplace_release(history(spark, d), [F.col("prescription_id")]).select("prescription_id", big("quantity"), "age_group")


@query(
    "prv10_report",
    """SELECT round(u, 6) AS overall_utility, round(1 - rare, 8) AS overall_privacy_score, (SELECT count(*) FROM evu) AS original_rows, (SELECT count(*) FROM syn) AS synthetic_rows,
       u >= 0.85 AS meets_utility_threshold, CASE WHEN u >= 0.85 AND 1 - rare >= 0.8 THEN 'EXCELLENT: High utility with strong privacy guarantees' WHEN u >= 0.85 THEN 'GOOD: Meets utility threshold, privacy can be improved'
       WHEN 1 - rare >= 0.8 THEN 'FAIR: Good privacy, but utility below threshold' ELSE 'NEEDS IMPROVEMENT: Both utility and privacy need attention' END AS assessment
       FROM risk, (SELECT avg(value) AS u FROM metrics)""",
    ("risk", "metrics", "evu", "syn"),
)
def prv10(spark, d):
    rep = PV.privacy_report(history(spark, d), synthetic(spark, d))
    return rep.select(
        r("overall_utility", 6), r("overall_privacy_score", 8), "original_rows", "synthetic_rows", "meets_utility_threshold", "assessment"
    )


# ---------------------------------------------------------------- co-occurrence

common("bi", "SELECT DISTINCT basket_id, medicine_id FROM disp", "disp")
common(
    "edge",
    """SELECT x.medicine_id AS med1, y.medicine_id AS med2, count(*) AS n FROM bi x JOIN bi y ON y.basket_id = x.basket_id AND x.medicine_id < y.medicine_id GROUP BY 1, 2""",
    "bi",
)
common("vertex", "SELECT medicine_id, count(*) AS n FROM bi GROUP BY 1", "bi")


def pairs(spark, d):
    return G.basket_pairs(G.basket_items(T.dispensing(spark, d)))


@query(
    "join7_basket_pairs",
    "SELECT x.basket_id, x.medicine_id AS med1, y.medicine_id AS med2 FROM bi x JOIN bi y ON y.basket_id = x.basket_id AND x.medicine_id < y.medicine_id",
    ("bi",),
)
def join7(spark, d):
    return pairs(spark, d)


@query("grf1_vertices", "SELECT medicine_id, n FROM vertex", ("vertex",))
def grf1_vertices(spark, d):
    return G.vertex_counts(G.basket_items(T.dispensing(spark, d)))


@query("grf1_edges", "SELECT med1, med2, n FROM edge", ("edge",))
def grf1_edges(spark, d):
    return G.edge_counts(pairs(spark, d))


@query("set3_symmetric_edges", "SELECT med1, med2, n FROM edge UNION ALL SELECT med2, med1, n FROM edge", ("edge",))
def set3(spark, d):
    return G.symmetric(G.edge_counts(pairs(spark, d)))


@query(
    "grf2_association",
    """SELECT med1, med2, edge.n, a.n AS n1, b.n AS n2, round(edge.n / least(a.n, b.n), 6) AS score FROM edge JOIN vertex a ON a.medicine_id = med1 JOIN vertex b ON b.medicine_id = med2""",
    ("edge", "vertex"),
)
def grf2(spark, d):
    items = G.basket_items(T.dispensing(spark, d))
    s = G.association_scores(G.edge_counts(G.basket_pairs(items)), G.vertex_counts(items))
    return s.withColumn("score", r("score", 6))


@query(
    "grf3_top_partners",
    """SELECT med1, med2, n, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY med1 ORDER BY n DESC, med2) AS rn FROM (
       SELECT med1, med2, n FROM edge UNION ALL SELECT med2, med1, n FROM edge)) WHERE rn <= 5""",
    ("edge",),
)
def grf3(spark, d):
    return G.top_partners(G.edge_counts(pairs(spark, d))).select("med1", "med2", "n", big("rank"))
