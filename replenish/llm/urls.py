"""URL filters: pattern rules found through their rarest literal token.

A rule names a host with its subdomains and a start of the path, or gives a regular expression with
literal tokens that every fitting URL has; one with several forms, whose tokens differ, is filed for
each form. The tokens of all rules are counted over all URLs, each form is filed under the one that fewest URLs have, and a URL's own tokens fetch the rules to try.
Only those run their regular expression. All of it is DataFrame work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.llm.tables import LOWER, UPPER, broadcast_if_small

# runs of ASCII characters other than letters and digits part the tokens
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# rules up to which the index is sent to every executor; more are joined by a shuffle
BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``name`` is what results show; in every URL that ``regex`` fits ``tokens``, or those of one of ``others``, stand alone."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    explicit: bool
    others: tuple[tuple[str, ...], ...] = ()


def prefix_rule(verdict: str, place: str) -> Rule:
    """A rule like ``example.org/en/1``: the host, its subdomains, and paths that start so."""
    host, slash, rest = place.partition("/")
    # the last part of the path may go on in a URL, so it is no token of its own
    whole = re.split(BREAK, host) + re.split(BREAK, rest)[:-1]
    return Rule(place, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}", tuple(t for t in whole if t), verdict, True)


def word_rule(verdict: str, *tokens: str) -> Rule:
    """A rule on neighbouring parts of a host name, as in ``cheap-pills``, ``cheap.pills`` or ``cheappills``."""
    regex = rf"^([^/]*[.-])?{'[-.]?'.join(map(re.escape, tokens))}[.-][^/]*(/|$)"
    # each gap apart or joined; the first form has all apart
    gaps = product(" ", *[(" ", "")] * (len(tokens) - 1))
    forms = [tuple("".join(g + t for g, t in zip(gap, tokens)).split()) for gap in gaps]
    return Rule("*" + "-".join(tokens) + "*", regex, forms[0], verdict, False, tuple(forms[1:]))


EXPLICIT = (
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
)
# hosts of junk by the words in their names
JUNK = (
    word_rule("block", "ads", "track"),
    word_rule("block", "adult"),
    word_rule("block", "casino"),
    word_rule("block", "cheap", "pills"),
    word_rule("block", "free", "bets"),
    word_rule("block", "spam", "farm"),
    word_rule("block", "link", "farm"),
    word_rule("block", "malware"),
    word_rule("block", "phishing"),
)
OTHERWISE = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Both are empty for a null or one without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    parts = F.concat(F.split(host, BREAK), F.split(path, BREAK))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def rule_index(spark: SparkSession, urls: DataFrame, rules) -> DataFrame:
    """(token, name, regex, verdict, explicit): each form of a rule under its token with the fewest URLs; ties go by code point."""
    forms = [(r, form) for r in rules for form in (r.tokens, *r.others)]
    rows = [(i, r.name, r.regex, list(form), r.verdict, r.explicit) for i, (r, form) in enumerate(forms)]
    table = spark.createDataFrame(
        rows, "form_id int, name string, regex string, tokens array<string>, verdict string, explicit boolean"
    )
    listed = table.withColumn("token", F.explode("tokens"))
    wanted = broadcast_if_small(listed.select("token").distinct(), BROADCAST_RULES)
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    counted = listed.join(seen, "token", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    best = counted.groupBy("form_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return table.drop("tokens").join(best, "form_id").drop("form_id")


def judge(pages: DataFrame, rules=EXPLICIT + JUNK, otherwise: str = OTHERWISE) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row.

    Among explicit rules that fit, the longest decides (of equal ones, the first by code point);
    without one, a pattern that fits, blocking before allowing; without either, ``otherwise``. A null
    or broken URL fits nothing. Repeated rows are judged each. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    index = broadcast_if_small(rule_index(pages.sparkSession, urls, rules), BROADCAST_RULES)
    # the number holds a row's tokens together until the aggregate below, whose partial step has them all
    tried = urls.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "page_id", "host", "path", F.explode_outer("tokens").alias("token")
    ).join(index, "token", "left")
    fits = F.expr("concat(host, path) rlike regex")
    rank = F.struct(-F.length("name"), F.col("name"), F.col("verdict"))
    judged = tried.groupBy("row", "page_id", "host", "path").agg(
        F.min(F.when(fits & F.col("explicit"), rank)).alias("e"),
        F.max(F.when(fits & ~F.col("explicit"), F.struct("verdict", "name"))).alias("p"),
    )
    return judged.select(
        "page_id", "host", "path", F.col("e.name").alias("rule"),
        F.coalesce("e.verdict", "p.verdict", F.lit(otherwise)).alias("verdict"), F.col("p.name").alias("pattern"),
    )
