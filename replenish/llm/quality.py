"""Quality rules whose cutoffs limit the share of good documents that they reject.

Counts of each text feed a few rules; a rule rejects what lies beyond its cutoff. Cutoffs come from
labelled documents, apart for each language. A quarter of the labels, by a hash of the id, proposes: rule by rule, the
cutoff that catches most of the junk which the rules before it let pass, where that is worth the good
documents lost. The other labels, which had no say in that, hold out: the union of the first rule, then of the
first two and so on is tested at the whole limit by the exact binomial tail, and the first union that
fails ends the sequence, so testing several costs no level. The level is divided by the number of strata. So with
the stated confidence no stratum loses more of its good documents than the limit. Languages whose labels are too
few to certify even rules that lose nothing form one stratum together, whose limit holds for them as a whole.
All DataFrame work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.llm.tables import broadcast_if_small, words
from replenish.session import stored

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
BLANKS = " \t\n\x0b\x0c\r"
# share of a stratum's good documents that all rules together may reject, and the chance of breaking it
LIMIT = 0.05
RISK = 0.05
# labelled junk that must be caught for each good document lost
WORTH = 20
# first hex digits of an id's hash that make its label one that proposes: below 4, a quarter
PROPOSING = "4"
# strata up to which their cutoffs are sent to every executor
BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Rule:
    """Rejects where ``amount`` is above cutoff times ``base`` (or below it, if ``low``)."""

    name: str
    amount: str
    base: str
    cutoffs: tuple[float, ...]
    low: bool = False

    def rejects(self, cutoff: Column) -> Column:
        bound = F.col(self.base) * cutoff
        return F.col(self.amount) < bound if self.low else F.col(self.amount) > bound


RULES = (
    Rule("symbols", "n_symbols", "n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    Rule("duplicate_lines", "n_dup_lines", "n_words", (0.005, 0.01, 0.02, 0.05, 0.1)),
    Rule("repetition", "n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15)),
    Rule("long_words", "word_chars", "n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
    Rule("short_words", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0, 3.5), low=True),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shift(f: str, value: Column, bits: Column) -> Column:
    return F.call_function(f, value, bits)


def _alike_next(keys: str, bits: str) -> Column:
    """Members of a sorted array that equal a neighbour but for the low ``bits``."""

    def at(i: Column) -> Column:
        return _shift("shiftrightunsigned", F.get(keys, i), F.col(bits))

    return F.filter(keys, lambda x, i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))


def with_counts(docs: DataFrame) -> DataFrame:
    """The rows with the five counts and base_failed.

    Repeated windows are found inside a row: if its window hashes aren't all different, they are sorted with their positions in the low
    bits, neighbours with equal upper bits are tried again by their other bits, and the positions left
    are those of windows that come twice or more.
    """
    line_has_word = lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0
    text = F.coalesce("text", F.lit(""))
    out = docs.select("*", words(F.col("text")).alias("_w"), F.filter(F.split(text, "\n"), line_has_word).alias("_lines"))
    out = out.select(
        "*",
        F.size("_w").cast("long").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
        F.when(
            F.size("_w") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - WINDOW),
                lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]),
            ),
        ).alias("_h"),
        F.length(F.bin(F.size("_w").cast("long"))).alias("_bits"),
    )
    bits = F.col("_bits")
    upper = lambda h, i: _shift("shiftleft", _shift("shiftrightunsigned", h, bits), bits).bitwiseOR(i.cast("long"))
    # most texts repeat no window and need no more than this
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.select("*", F.when(repeats, F.sort_array(F.transform("_h", upper))).alias("_k"))
    out = out.select("*", _alike_next("_k", "_bits").alias("_maybe"), (_shift("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("_mask"))
    place = lambda x: x.bitwiseAND(F.col("_mask"))
    lower = lambda x: _shift("shiftleft", F.get("_h", place(x).cast("int")), bits).bitwiseOR(place(x))
    out = out.select("*", F.sort_array(F.transform("_maybe", lower)).alias("_k2"))
    out = out.select("*", F.sort_array(F.transform(_alike_next("_k2", "_bits"), place)).alias("_p"))
    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "_p", start, lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(WINDOW), p - s["last"])).alias("total")), lambda s: s["total"]
    )
    out = out.select(
        *docs.columns, F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _log_factorial(x: Column) -> Column:
    """Exact below 16, by Stirling's series from there (relative error under 1e-15)."""
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.ln(y) - y + 0.5 * F.ln(2 * F.pi() * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 16, F.ln(F.factorial(F.least(x, F.lit(15)).cast("int")))).otherwise(series)


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(at most k of n) at a true ``rate``; summed downward from k, for k below n * rate only, 1 beyond."""
    at_k = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(F.lit(rate)) + (n - k) * F.log1p(F.lit(-rate))
    )
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i + 1) * (1 - rate) / ((n - k + i) * rate)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    below = F.aggregate(F.sequence(F.lit(1).cast("long"), k), one, add, lambda s: s["total"])
    total = F.when(k >= n * rate, 1.0).when(k == 0, at_k).otherwise(at_k * below)
    return F.least(F.lit(1.0), total)


def least_labels(strata: int, limit: float = LIMIT, risk: float = RISK) -> int:
    """Good holdout labels from which a stratum can certify rules that lose none of them."""
    return math.ceil(math.log(risk / strata) / math.log1p(-limit))


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows past the base rules with ``q`` and whether they propose or hold out.

    ``labels`` has doc_id and quality (1 good, 0 junk); of several labels of a document the lowest counts, null ones don't.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    held = counted.filter("not base_failed").join(known, "doc_id")
    return held.select("lang", *COUNTS, "q", (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < PROPOSING).alias("proposes"))


def cutoffs(counted: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """(pooled, stratum, cut_<rule>...) of every stratum with labels; null where no cutoff is certified.

    ``stratum`` is a language with labels enough, null for documents without one and for the pooled rest.
    """
    held = stored(labelled(counted, labels), "quality-held")
    good, junk = F.col("q") == 1, F.col("q") == 0
    holds = good & ~F.col("proposes")
    langs = stored(held.groupBy(F.col("lang").alias("own")).agg(F.count_if(holds).alias("holds")), "quality-languages")
    strata = langs.count() + 1
    large = langs.filter(F.col("holds") >= least_labels(strata, limit, risk)).select("own", F.lit(True).alias("large"))
    held = held.join(broadcast_if_small(large, BROADCAST_STRATA), F.col("lang").eqNullSafe(F.col("own")), "left")
    pooled = F.col("large").isNull()
    held = held.withColumn("pooled", pooled).withColumn("stratum", F.when(~pooled, F.col("lang"))).drop("lang", "own", "large")
    held = stored(held, "quality-held-strata")
    key = ["pooled", "stratum"]

    def with_chosen(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        chosen = broadcast_if_small(chosen.withColumnsRenamed({"pooled": "_p", "stratum": "_s"}), BROADCAST_STRATA)
        return rows.join(chosen, (F.col("pooled") == F.col("_p")) & F.col("stratum").eqNullSafe(F.col("_s"))).drop("_p", "_s")

    def union(some) -> Column:
        out = F.lit(False)
        for r in some:
            out = out | F.coalesce(r.rejects(F.col(f"cut_{r.name}")), F.lit(False))
        return out

    chosen = stored(held.groupBy(*key).agg(F.count_if(holds).alias("n")), "quality-strata")
    for number, rule in enumerate(rules):
        left = F.col("proposes") & ~union(rules[:number])
        sums = []
        for i, c in enumerate(rule.cutoffs):
            out = left & rule.rejects(F.lit(c))
            sums += [F.count_if(which & out).alias(f"{name}_{i}") for name, which in (("lost", good), ("caught", junk))]
        seen = with_chosen(held, chosen).groupBy(*key).agg(*sums)
        tried = F.array(*[F.struct(F.col(f"lost_{i}").alias("lost"), F.col(f"caught_{i}").alias("caught"), F.lit(c).alias("cutoff")) for i, c in enumerate(rule.cutoffs)])
        seen = seen.select(*key, F.explode(tried).alias("t")).select(*key, "t.*")
        gain = F.col("caught") - WORTH * F.col("lost")
        # of equal gains the loosest
        loose = F.col("cutoff") if rule.low else -F.col("cutoff")
        best = seen.filter(gain > 0).groupBy(F.col("pooled").alias("_p"), F.col("stratum").alias("_s")).agg(F.min_by("cutoff", F.struct(-gain, loose)).alias(f"cut_{rule.name}"))
        same = (F.col("pooled") == F.col("_p")) & F.col("stratum").eqNullSafe(F.col("_s"))
        chosen = stored(chosen.join(best, same, "left").drop("_p", "_s"), "quality-cutoffs")
    lost = [F.count_if(holds & union(rules[: k + 1])).alias(f"lost_{k}") for k in range(len(rules))]
    tested = with_chosen(held, chosen).groupBy(*key).agg(*lost).withColumnsRenamed({"pooled": "_p", "stratum": "_s"})
    tested = chosen.join(tested, (F.col("pooled") == F.col("_p")) & F.col("stratum").eqNullSafe(F.col("_s")))
    certified, out = F.lit(True), []
    for k, rule in enumerate(rules):
        certified = certified & (binomial_tail(F.col("n"), F.col(f"lost_{k}"), limit) <= risk / strata)
        out.append(F.when(certified, F.col(f"cut_{rule.name}")).alias(f"cut_{rule.name}"))
    return stored(tested.select(*key, *out), "quality-certified")


def with_verdict(counted: DataFrame, cuts: DataFrame, rules=RULES) -> DataFrame:
    """The rows with ``kept``; a language without cutoffs of its own goes by the pooled ones."""
    names = [f"cut_{r.name}" for r in rules]
    pool = cuts.filter("pooled").agg(F.first(F.struct(*names))).scalar()
    own = broadcast_if_small(cuts.filter("not pooled").select("stratum", "pooled", *names), BROADCAST_STRATA)
    joined = counted.join(own, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.col("base_failed")
    for r, name in zip(rules, names):
        cut = F.when(F.col("pooled").isNull(), pool[name]).otherwise(F.col(name))
        rejected = rejected | F.coalesce(r.rejects(cut), F.lit(False))
    return joined.withColumn("kept", ~rejected).drop("stratum", "pooled", *names)


def judge(docs: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept) of every row.

    A null text has no words and fails. Documents without a language form a stratum. Repeated rows are
    judged each; other columns are not read. Without labels only the base rules reject.
    """
    counted = stored(with_counts(docs.select("doc_id", "text", "lang")).drop("text"), "quality-counts")
    return with_verdict(counted, cutoffs(counted, labels, rules, limit, risk), rules).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    counted = stored(with_counts(docs.select(*own, "doc_id", "text", "lang")).drop("text"), "quality-rows")
    kept = with_verdict(counted, cutoffs(counted, labels, rules, limit, risk), rules).filter("kept")
    return kept.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
