"""Benchmark decontamination by templates, which also finds re-parameterised questions.

Texts are made canonical: numbers with their separators, names (runs of capitalised words inside a sentence) and
units after numbers become typed placeholders, the rest is lower-cased and split at anything but letters and
digits. Windows of template tokens are hashed and joined to those of the benchmark. Windows that are mostly slots
count only with the same values; items shorter than a window are looked for as a whole, word for word. Where windows
meet, the values that stood in the slots are compared along the alignment: a question that was only
re-parameterised replaces each value by one other everywhere. Slots that clash with that take the
windows that hold them out of what is covered, never the rest. All of it is DataFrame work.

The corpus is read twice: once to find the ids with a matching window, which needs hashes only, and
once to align those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.llm.tables import broadcast_if_small
from replenish.session import stored

WINDOW = 8
# of a window's tokens, those that must not be slots
LEAST_LITERAL = 4
# items below this number of tokens can't be told from chance; below a window, whole items are looked for
LEAST_TOKENS = 4
# a document holds an item from this share of its tokens, or this many, whichever is less
SHARE = 0.5
RUN = 13
# benchmark windows and found ids up to which they are sent to every executor; more are shuffled
BROADCAST_WINDOWS = 2_000_000
BROADCAST_IDS = 1_000_000

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres "
    "kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ml l litre litres liter liters gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years kmh mph percent dollar dollars cent cents euro euros degree degrees "
    "hz khz mhz ghz w kw v kv a j kj cal kcal pa kpa bar k c f"
).split()
# joints inside a number and inside a name, which keep its parts in one token
_IN_NUMBER, _IN_NAME = "\u0005", "\u0006"
_NUMBER_JOINT = r"(?<=\p{Nd})[.,](?=\p{Nd})"
_NAME_JOINT = r" (?=\p{Lu})(?<=[\p{L}\p{Nd},;] \p{Lu}[\p{L}\p{M}]{0,30} )"
_NAME = r"\p{Lu}(?<=[\p{L}\p{Nd},;] .)[\p{L}\p{M}\x06]*+"
_UNIT = r"(?i)(\x02[\p{Nd}\x05]*+ {1,2})(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}\p{Nd}])"


def canonical(text: Column, values: bool = False) -> Column:
    """Tokens of the template; with ``values``, a slot's token is its mark and what stood there."""
    own = "$0" if values else ""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBER_JOINT, _IN_NUMBER)
    joined = F.regexp_replace(joined, _NAME_JOINT, _IN_NAME)
    named = F.regexp_replace(joined, _NAME, NAME + own)
    numbered = F.regexp_replace(named, r"\p{Nd}[\p{Nd}\x05]*+", f" {NUMBER}{own} ")
    marked = F.regexp_replace(numbered, _UNIT, f"$1{UNIT}" + ("$2" if values else ""))
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{M}\p{Nd}\x01-\x03\x05\x06]+"), lambda t: t != "")


def _slot(token: Column) -> Column:
    return token < F.lit("\u0004")


def _template(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.when(_slot(t), F.substring(t, 1, 1)).otherwise(t))


def window_hashes(tokens: str, width: int) -> Column:
    """Hash of every window; none for fewer tokens."""
    at = F.sequence(F.lit(1), F.size(tokens) - (width - 1))
    return F.when(F.size(tokens) >= width, F.transform(at, lambda i: F.xxhash64(F.slice(tokens, i, width))))


def _clashing(pairs: str) -> Column:
    """Of distinct (asked, held, n) those against a one-to-one map, where n slots have the pair.

    Of a value's several replacements the value itself stands, else the most frequent; the others clash.
    Of what stands, different values with one replacement all clash.
    """
    rank = lambda p: F.struct(p["asked"] == p["held"], p["n"], p["held"])
    stands = lambda p: ~F.exists(pairs, lambda q: (q["asked"] == p["asked"]) & (rank(q) > rank(p)))
    shared = lambda p: F.exists(
        pairs, lambda q: (q["held"] == p["held"]) & (q["asked"] != p["asked"]) & stands(q)
    )
    return F.filter(pairs, lambda p: ~stands(p) | shared(p))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW, literal: int = LEAST_LITERAL) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, item_tokens) and their windows (h, item, j, rich).

    ``rich`` windows have fewer than ``literal`` tokens that are no slots; they count with the same values only.
    Items shorter than a window have none. Repeated items stay apart.
    """
    items = benchmark.select(
        F.monotonically_increasing_id().alias("item"), "item_id", canonical(F.col("text"), True).alias("item_tokens")
    )
    items = stored(items, "decontaminate-items")
    tokens = items.withColumn("template", _template("item_tokens"))
    placed = tokens.select("item", "template", F.posexplode(window_hashes("template", width)).alias("j", "h"))
    literals = F.size(F.filter(F.slice("template", F.col("j") + 1, width), lambda t: ~_slot(t)))
    return items, placed.select("h", "item", "j", (literals < literal).alias("rich"))


def _whole_items(rows: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """Rows that hold an item of fewer tokens than a window word for word, as ``contaminated`` gives them."""
    short = items.filter(F.size("item_tokens").isin(widths)).select("item", "item_id", "item_tokens", F.xxhash64("item_tokens").alias("h"))

    def slices(w: int) -> Column:
        at = F.sequence(F.lit(1), F.size("tokens") - (w - 1))
        return F.when(F.size("tokens") >= w, F.transform(at, lambda i: F.slice("tokens", i, w)))

    held = rows.select("row", "doc_id", "text_hash", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[slices(w) for w in widths]))))).alias("held"))
    met = held.withColumn("h", F.xxhash64("held")).join(broadcast_if_small(short, BROADCAST_WINDOWS), "h").filter("held = item_tokens")
    n = F.size("item_tokens")
    slots = F.size(F.filter("item_tokens", _slot)).cast("long")
    return met.select(
        "doc_id", "item_id", F.lit("verbatim").alias("kind"), n.alias("n_covered"), n.alias("n_tokens"), slots.alias("n_slots"), F.lit(0).cast("long").alias("n_changed"), "text_hash"
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    literal: int = LEAST_LITERAL,
    share: float = SHARE,
    run: int = RUN,
) -> DataFrame:
    """(doc_id, item_id, kind, n_covered, n_tokens, n_slots, n_changed, text_hash): each document with an item it holds.

    kind is ``verbatim`` where all slots agree, else ``reparameterised``; windows with slots whose values
    don't map one to one are not covered, unless they lie in a run of equal tokens as long as is needed. Null and short texts hold nothing; repeated rows are found each.
    Other columns are not read. Empty tables give no rows.
    """
    items, windows = benchmark_windows(benchmark, width, literal)
    windows = stored(windows, "decontaminate-windows")
    # the few lengths of items that are shorter than a window
    sizes = items.select(F.size("item_tokens").alias("n")).filter(F.col("n").between(LEAST_TOKENS, width - 1)).distinct()
    widths = sorted(r["n"] for r in sizes.collect())
    whole_hashes = items.filter(F.size("item_tokens").isin(widths)).select(F.xxhash64(_template("item_tokens")).alias("h"))
    # first reading: ids with a matching window
    keys = broadcast_if_small(windows.select("h").union(whole_hashes).distinct(), BROADCAST_WINDOWS)
    hashed = docs.select("doc_id", canonical(F.col("text")).alias("tokens"))
    hashes = window_hashes("tokens", width)
    if widths:
        hashes = F.flatten(F.array_compact(F.array(hashes, *[window_hashes("tokens", w) for w in widths])))
    hashed = hashed.select("doc_id", F.explode(hashes).alias("h"))
    found = stored(hashed.join(keys, "h", "left_semi").select(F.col("doc_id").alias("found_id")).distinct(), "decontaminate-ids")
    # second reading: rows of those ids with their values
    rows = docs.select("doc_id", "text").join(
        broadcast_if_small(found, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("found_id")), "left_semi"
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"),
        canonical(F.col("text"), True).alias("tokens"),
    )
    rows = stored(rows, "decontaminate-rows")
    placed = rows.withColumn("template", _template("tokens")).select(
        "row", "doc_id", "text_hash", "tokens", F.posexplode(window_hashes("template", width)).alias("i", "h")
    )
    placed = placed.withColumn("held", F.slice("tokens", F.col("i") + 1, width)).drop("tokens")
    met = placed.join(broadcast_if_small(windows, BROADCAST_WINDOWS), "h")
    met = met.join(broadcast_if_small(items, BROADCAST_WINDOWS // 20), "item")
    # slots of a window: place in the item, type, its value and the document's
    pairs = F.filter(
        F.arrays_zip(
            F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda o: o + F.col("j")).alias("at"),
            F.slice("item_tokens", F.col("j") + 1, width).alias("asked"),
            F.col("held"),
        ),
        lambda p: _slot(p["asked"]),
    )
    met = met.select(
        "row", "doc_id", "text_hash", "item", "item_id", F.size("item_tokens").alias("n_tokens"),
        (F.col("i") - F.col("j")).alias("offset"), "j", pairs.alias("slots"), "rich",
    )
    met = met.filter(~F.col("rich") | ~F.exists("slots", lambda s: s["asked"] != s["held"]))
    place = ["row", "item", "offset"]
    # an alignment has at most the item's tokens
    aligned = met.groupBy(*place).agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("item_id").alias("item_id"),
        F.first("n_tokens").alias("n_tokens"), F.collect_set("j").alias("starts"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    both = F.transform("slots", lambda s: F.struct(s["asked"].alias("asked"), s["held"].alias("held")))
    aligned = aligned.withColumn("both", both).withColumn("kinds", F.array_distinct("both"))
    one_to_one = F.size("kinds") == F.size(F.array_distinct(F.transform("kinds", lambda k: k["asked"])))
    one_to_one &= F.size("kinds") == F.size(F.array_distinct(F.transform("kinds", lambda k: k["held"])))
    counted = F.transform(
        "kinds",
        lambda k: F.struct(k["asked"].alias("asked"), k["held"].alias("held"), F.size(F.filter("both", lambda x: x == k)).alias("n")),
    )
    aligned = aligned.withColumn("counted", F.when(~one_to_one, counted))
    bad = F.transform(_clashing("counted"), lambda p: F.struct(p["asked"].alias("asked"), p["held"].alias("held")))
    aligned = aligned.withColumn("bad", F.coalesce(bad, F.array().cast("array<struct<asked:string,held:string>>")))
    # the places of an item whose slots clash, and those whose slots changed
    of_bad = lambda s: F.array_contains("bad", F.struct(s["asked"].alias("asked"), s["held"].alias("held")))
    changed = F.filter("slots", lambda s: s["asked"] != s["held"])
    at = lambda slots: F.transform(slots, lambda s: s["at"])
    aligned = aligned.withColumn("clash_at", at(F.filter("slots", of_bad))).withColumn("changed_at", at(changed))
    free = lambda places: F.filter("starts", lambda j: ~F.exists(places, lambda k: (k >= j) & (k < j + width)))
    spots_of = lambda starts: F.array_distinct(F.flatten(F.transform(starts, lambda j: F.sequence(j, j + (width - 1)))))
    aligned = aligned.withColumn("good", spots_of(free("clash_at")))
    # runs of equal tokens: windows without a change that meet or overlap, as (first place, place after the last)
    nothing = F.array().cast("array<struct<low:int,high:int>>")
    runs = F.aggregate(
        F.array_sort(free("changed_at")),
        nothing,
        lambda r, j: F.when(
            (F.size(r) > 0) & (j <= F.element_at(r, -1)["high"]),
            F.concat(F.slice(r, 1, F.size(r) - 1), F.array(F.struct(F.element_at(r, -1)["low"].alias("low"), (j + width).cast("int").alias("high")))),
        ).otherwise(F.concat(r, F.array(F.struct(j.cast("int").alias("low"), (j + width).cast("int").alias("high"))))),
    )
    need = F.least(F.lit(run), F.ceil(F.col("n_tokens") * share))
    long_ = F.filter(runs, lambda r: r["high"] - r["low"] >= need)
    verbatim = F.flatten(F.transform(long_, lambda r: F.sequence(r["low"], r["high"] - 1)))
    aligned = aligned.withColumn("verbatim", F.when(~one_to_one, verbatim).otherwise(F.array().cast("array<int>")))
    # the places that an alignment covers; alignments of one item and row are put together
    aligned = aligned.select(
        "row", "item", "doc_id", "text_hash", "item_id", "n_tokens", F.array_union("good", "verbatim").alias("spots"),
        F.size("slots").alias("n_slots"), F.size("changed_at").alias("n_changed"),
    ).filter(F.size("spots") > 0)
    whole = aligned.groupBy("row", "item").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("item_id").alias("item_id"),
        F.first("n_tokens").alias("n_tokens"), F.size(F.array_distinct(F.flatten(F.collect_set("spots")))).alias("n_covered"),
        F.sum("n_slots").alias("n_slots"), F.sum("n_changed").alias("n_changed"),
    )
    enough = F.col("n_covered") >= need
    kind = F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim")
    found = whole.filter(enough).select(
        "doc_id", "item_id", kind.alias("kind"), "n_covered", "n_tokens", "n_slots", "n_changed", "text_hash"
    )
    return found.union(_whole_items(rows, items, widths)) if widths else found


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns only, whatever these are called.

    Null and empty texts hold nothing and stay; of rows with one id only those with a found text go. An empty table or
    benchmark takes nothing out.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    held = contaminated(docs, benchmark).select(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_text")).distinct()
    held = broadcast_if_small(stored(held, "decontaminate-held"), BROADCAST_IDS)
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()])
    same = F.col(own["doc_id"]).eqNullSafe(F.col("held_id")) & (F.xxhash64(own["text"]) == F.col("held_text"))
    return rows.join(held, same, "left_anti").select(*[F.col(n).alias(c) for c, n in own.items()])
