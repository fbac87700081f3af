"""Phrases whose words keep together, counted in quotient filters.

A text is lower-cased, cut into pieces at marks and line ends, and pieces into words. A phrase can only
be frequent if its words are, so words get dense numbers from the exact counts of all of them, and
everything below the least count gets none. A phrase of m numbers of w bits is one number of m * w
bits; an invertible permutation spreads these evenly, the upper bits are a slot (the quotient), and the
rest is kept in full (the remainder). A filter is then the bits of the slots in use, a bit that ends each slot's
run, packed remainders and packed counts, in the order of the permuted numbers. Nothing is lost: the
permutation backwards gives the phrase. Tasks build filters of their own texts for ranges of slots, and the
filters of a range are merged in order. Longer phrases are only counted where both phrases that are one
shorter have a slot in use by a frequent one; this prunes by at most 2^27 slots (16 MB), which also bounds what is
broadcast, and never loses a phrase.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replenish.session import stored

# fixed values of the contract
MARKS = b",;:!?\n\x0b\x0c\r"
LONGEST, LEAST, FIRST = 4, 30, 2000
SCALE, ABSORBED = 2_000_000, (100, 80)

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + MARKS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(MARKS))
BLOCK_WORDS = 1 << 20
_SLICE = 1 << 20
SLOT_BITS = 27
_HELD = 1 << 21
SHARES = 64
_ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<QBBBB")
_PLAIN = 255


# ---------------------------------------------------------------- filters


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ROUNDS[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ROUNDS[2])
    return x ^ (x >> np.uint64(31))


class Shape:
    """Phrases of ``length`` numbers below 2^``width`` (even), as two halves of ``half`` bits."""

    def __init__(self, length: int, width: int):
        self.length, self.width, self.half = length, width, length * width // 2
        self.mask = np.uint64((1 << self.half) - 1)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w = np.uint64(self.width)
        if self.length == 2:
            high, low = words
        elif self.length == 3:
            part = np.uint64(self.width // 2)
            high = words[0] << part | words[1] >> part
            low = (words[1] & np.uint64((1 << self.width // 2) - 1)) << w | words[2]
        else:
            high, low = words[0] << w | words[1], words[2] << w | words[3]
        for c in _ROUNDS:
            high, low = low, high ^ (_mix(low + np.uint64(c)) & self.mask)
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        for c in reversed(_ROUNDS):
            high, low = low ^ (_mix(high + np.uint64(c)) & self.mask), high
        w, one = np.uint64(self.width), np.uint64((1 << self.width) - 1)
        if self.length == 2:
            return [high, low]
        if self.length == 3:
            part = np.uint64(self.width // 2)
            middle = (high & np.uint64((1 << self.width // 2) - 1)) << part | low >> w
            return [high >> part, middle, low & one]
        return [high >> w, high & one, low >> w, low & one]

    def top(self, high: np.ndarray, bits: int) -> np.ndarray:
        return high >> np.uint64(self.half - bits)

    def counted(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None):
        """Distinct numbers in order with their counts."""
        if not len(high):
            return high, low, np.zeros(0, np.int64)
        if 2 * self.half <= 64:
            key = high << np.uint64(self.half) | low
            if counts is None:
                key.sort()
                order = slice(None)
            else:
                order = key.argsort(kind="stable")
                key = key[order]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            high, low = key[new] >> np.uint64(self.half), key[new] & self.mask
        else:
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            new = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
            high, low = high[new], low[new]
        if counts is None:
            total = np.diff(np.append(new, len(order) if isinstance(order, np.ndarray) else len(key)))
        else:
            total = np.add.reduceat(counts[order], new)
        return high, low, total.astype(np.int64)


def _bytes(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8].tobytes()


def _values(raw: memoryview, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = (bits + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return wide.view(np.uint64).ravel(), at + n * size


def pack_filter(shape: Shape, base: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """The quotient filter of distinct numbers in order that agree in their upper ``base`` bits."""
    n = len(high)
    slots = min(max(n.bit_length(), 3), shape.half - base) if shape.half > base else 0
    quotient = shape.top(high, base + slots) & np.uint64((1 << slots) - 1)
    used = np.zeros(1 << slots, bool)
    used[quotient.astype(np.int64)] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    rest = shape.half - base - slots
    left = high & np.uint64((1 << rest) - 1)
    whole = rest + shape.half <= 64
    remainders = _bytes(left << np.uint64(shape.half) | low, rest + shape.half) if whole else _bytes(left, rest) + _bytes(low, shape.half)
    large = counts >= _PLAIN
    return b"".join(
        [
            _HEAD.pack(n, shape.length, shape.width, base, slots),
            struct.pack("<Q", int(high[0]) >> (shape.half - base) if n and base else 0),
            np.packbits(used).tobytes(), np.packbits(ends).tobytes(), remainders,
            np.minimum(counts, _PLAIN).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes(),
        ]
    )


def unpack_filter(raw: bytes) -> tuple[Shape, np.ndarray, np.ndarray, np.ndarray]:
    """(shape, high, low, counts) of a filter, in order."""
    raw = memoryview(raw)
    n, length, width, base, slots = _HEAD.unpack_from(raw)
    shape, at = Shape(length, width), _HEAD.size
    (prefix,) = struct.unpack_from("<Q", raw, at)
    at += 8
    size = ((1 << slots) + 7) // 8
    used = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=1 << slots))
    at += size
    size = (n + 7) // 8
    ends = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n)
    at += size
    run = np.cumsum(ends, dtype=np.int64) - ends
    rest = shape.half - base - slots
    if rest + shape.half <= 64:
        both, at = _values(raw, at, n, rest + shape.half)
        left, low = both >> np.uint64(shape.half) if shape.half < 64 else np.zeros_like(both), both & shape.mask
    else:
        left, at = _values(raw, at, n, rest)
        low, at = _values(raw, at, n, shape.half)
    quotient = used[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
    upper = (np.uint64(prefix) << np.uint64(slots)) | quotient if base else quotient
    high = upper << np.uint64(rest) | left if rest < 64 else left
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    at += n
    large = counts == _PLAIN
    counts[large] = np.frombuffer(raw, "<i8", int(large.sum()), at)
    return shape, high, low, counts


def merge_filters(parts: list[tuple], shape: Shape):
    """Sorted sums of unpacked filters."""
    high, low, counts = (np.concatenate(x) for x in zip(*parts))
    return shape.counted(high, low, counts)


# ---------------------------------------------------------------- words


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _slices(raw: bytes):
    """Parts of a folded text that cut no word."""
    at = 0
    while len(raw) - at > 2 * _SLICE:
        stop = raw.find(b" ", at + _SLICE)
        if stop < 0:
            break
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def _encode(size: int):
    """Blocks of about ``size`` words of one language: their distinct words with counts, and the places of all words in that list."""

    def rows(batches):
        part, number, held, open_ = TaskContext.get().partitionId(), 0, 0, {}

        def done():
            nonlocal number
            for lang, (numbers, lists) in open_.items():
                seq = np.concatenate(lists)
                counts = np.bincount(seq, minlength=len(numbers))[1:]
                yield pa.RecordBatch.from_pylist(
                    [{"block": part << 32 | number, "lang": lang, "words": list(numbers)[1:], "counts": counts.tolist(), "seq": seq.astype("<i4").tobytes()}],
                    schema=_BLOCKS,
                )
                number += 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                numbers, lists = open_.setdefault(lang, (_Numbers({b".": 0}), []))
                for piece in _slices(text.as_py().translate(_FOLD)):
                    words = piece.replace(b".", b" . ").split()
                    lists.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    held += len(words)
                lists.append(np.zeros(1, np.int32))
                if held >= size:
                    yield from done()
                    held, open_ = 0, {}
        yield from done()

    return rows


_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("seq", pa.binary())])


def _number(batches):
    """Places in a block's own list to numbers of the whole vocabulary; 0 for breaks and rare words."""
    for batch in batches:
        out = []
        for seq, size, at, ids in zip(*(batch.column(i) for i in range(4))):
            table = np.zeros(size.as_py() + 1, np.uint32)
            if at.is_valid:
                table[at.values.to_numpy(zero_copy_only=False) + 1] = ids.values.to_numpy(zero_copy_only=False)
            out.append(table[np.frombuffer(seq.as_buffer(), "<i4")].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])


def _dense(df: DataFrame, label: str) -> DataFrame:
    """The rows with ``id`` from 1 on without gaps."""
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), label)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(before, "_part").select(*df.columns, (F.col("_before") + inside + 1).alias("id"))


# ---------------------------------------------------------------- counting


def _grams(ids: np.ndarray, shapes: dict, slots: list, bits: int, length: int):
    """Packed phrases of ``length`` words of one block that may be frequent."""
    n = len(ids) - length + 1
    if n <= 0:
        return None
    known = ids > 0
    at = known[:n].copy()
    for k in range(1, length):
        at &= known[k : k + n]
    at = np.flatnonzero(at)
    wide = ids.astype(np.uint64)
    for shorter in range(2, length):
        shape, used = shapes[shorter], slots[shorter]
        for first in range(length - shorter + 1):
            high, _ = shape.pack([wide[at + first + k] for k in range(shorter)])
            slot = shape.top(high, min(bits, shape.half)).astype(np.int64)
            at = at[used[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 > 0]
    return shapes[length].pack([wide[at + k] for k in range(length)])


def _counter(shared, length: int, width: int, bits: int, base: int):
    def rows(batches):
        shapes = {m: Shape(m, width) for m in range(2, length + 1)}
        slots = [None, None, *(np.frombuffer(x, np.uint8) for x in shared.value)]
        shape, held, size = shapes[length], [], 0

        def done():
            high, low, counts = merge_filters(held, shape)
            segment = shape.top(high, base)
            ends = np.flatnonzero(np.append(segment[1:] != segment[:-1], True)) + 1
            start = 0
            for end in ends.tolist():
                blob = pack_filter(shape, base, high[start:end], low[start:end], counts[start:end])
                yield pa.RecordBatch.from_arrays([pa.array([int(segment[start])], pa.int64()), pa.array([blob], pa.binary())], names=["segment", "filter"])
                start = end

        for batch in batches:
            for ids in batch.column(0):
                found = _grams(np.frombuffer(ids.as_buffer(), "<u4"), shapes, slots, bits, length)
                if found is None or not len(found[0]):
                    continue
                held.append(shape.counted(*found))
                size += len(held[-1][0])
                if size >= _HELD:
                    merged = merge_filters(held, shape)
                    held, size = [merged], len(merged[0])
                    if size >= _HELD:
                        yield from done()
                        held, size = [], 0
        if size:
            yield from done()

    return rows


def _merger(length: int, width: int, bits: int, base: int, least: int):
    """Merge the filters of each segment in order; keep the frequent phrases and the slots they use."""

    def rows(batches):
        shape = Shape(length, width)
        own = min(bits, shape.half) - base
        now, held, size = None, [], 0

        def done():
            high, low, counts = merge_filters(held, shape)
            keep = counts >= least
            high, low, counts = high[keep], low[keep], counts[keep]
            used = np.zeros(1 << own, bool)
            used[(shape.top(high, base + own) & np.uint64((1 << own) - 1)).astype(np.int64)] = True
            blob = pack_filter(shape, base, high, low, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([blob], pa.binary()), pa.array([np.packbits(used).tobytes()], pa.binary())], names=["segment", "filter", "slots"]
            )

        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != now and held:
                    yield done()
                    held, size = [], 0
                now = segment
                held.append(unpack_filter(blob.as_buffer())[1:])
                size += len(held[-1][0])
                if size >= 2 * _HELD:
                    held = [merge_filters(held, shape)]
                    size = 0
        if held:
            yield done()

    return rows


def _listed(batches):
    for batch in batches:
        for blob in batch.column(0):
            shape, high, low, counts = unpack_filter(blob.as_buffer())
            words = np.stack([x.astype(np.int64) for x in shape.unpack(high, low)], axis=1)
            for at in range(0, len(words), 1 << 16):
                some = words[at : at + (1 << 16)]
                offsets = np.arange(len(some) + 1, dtype=np.int32) * shape.length
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offsets), pa.array(some.ravel())), pa.array(counts[at : at + (1 << 16)])], names=["ids", "a"]
                )


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals) of a table with ``text`` and ``lang``.

    ``words`` (lang, word, f, id): every word that occurs ``least`` times or more in a language; ``phrases``
    (ids, a): every phrase of 2 to ``longest`` words that does, with its exact count; ``totals`` (lang, n): words
    of each language. A null text is empty, a null language is ``und``. ``longest`` is 4 at most.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError("phrases have 2 to 4 words")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = stored(texts.mapInArrow(_encode(BLOCK_WORDS), "block long, lang string, words array<binary>, counts array<long>, seq binary"), "phrase-blocks")
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).filter("n > 0")
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    often = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= least)
    words = stored(_dense(often, "phrase-words"), "phrase-vocabulary")
    known = words.count()
    if known >= 1 << 32:
        raise ValueError("numbers of words have 32 bits")
    width = known.bit_length() + known.bit_length() % 2 or 2
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max((all_words >> 3).bit_length(), 8), SLOT_BITS)
    base = max(min(max((all_words >> 22).bit_length(), 2), min(bits, width) - 3), 0)
    placed = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"]).select("block", "at", "id")
    own = placed.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("own")).select("block", F.col("own.at").alias("at"), F.col("own.id").alias("id"))
    numbered = blocks.select("block", "seq", F.size("words").alias("size")).join(own, "block", "left")
    ids = stored(numbered.select("seq", "size", "at", "id").mapInArrow(_number, "ids binary"), "phrase-ids")
    slots, levels = [], []
    for length in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(slots)
        shape = Shape(length, width)
        own_bits = min(bits, shape.half)
        counted = ids.mapInArrow(_counter(shared, length, width, bits, base), "segment long, filter binary")
        ordered = counted.repartition("segment").sortWithinPartitions("segment")
        level = stored(ordered.mapInArrow(_merger(length, width, bits, base, least), "segment long, filter binary, slots binary"), f"phrases-{length}")
        levels.append(level)
        used = np.zeros(max((1 << own_bits) // 8, 1), np.uint8)
        size = max((1 << (own_bits - base)) // 8, 1)
        for row in level.select("segment", "slots").toLocalIterator():
            used[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["slots"], np.uint8)
        slots = [*slots, used.tobytes()]
    phrases = levels[0].select("filter")
    for level in levels[1:]:
        phrases = phrases.union(level.select("filter"))
    return words, phrases.mapInArrow(_listed, "ids array<long>, a long"), totals


# ---------------------------------------------------------------- scores


def _exact(c: Column) -> Column:
    return c.cast("decimal(28,0)")


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by their weakest cut.

    A candidate has 2 to 4 words and occurs ``least`` times or more inside pieces of its language. Cut after k
    words it scores floor(2000000 a / (l + r)), l and r being the counts of its two parts; its lowest cut counts,
    the first of equals. A candidate goes if a longer one that holds it occurs at least 80 % as often. Order:
    score and count from the highest, then the phrase by its bytes. Null texts are empty, a null language is
    ``und``, repeated rows count each time, an empty table gives no rows; other columns are not read.
    """
    words, phrases, totals = phrase_counts(docs, LONGEST, least)
    phrases = stored(phrases, "phrases")
    size = F.size("ids")
    counts = words.select(F.array("id").alias("ids"), F.col("f")).union(phrases.select("ids", F.col("a").alias("f")))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice("ids", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.withColumn("score", F.expr(f"({SCALE} * cast(a AS decimal(28,0))) div cast(l + r AS decimal(28,0))"))
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.score", "cut.l", "cut.r")
    longer = phrases.filter(size > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    longer = longer.select("a", "ids", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inside = longer.groupBy(F.slice("ids", F.col("at"), F.col("m")).alias("ids")).agg(F.max("a").alias("most"))
    absorbed = _exact(F.col("most")) * ABSORBED[0] >= _exact(F.col("a")) * ABSORBED[1]
    kept = scored.join(inside, "ids", "left").filter(F.col("most").isNull() | ~absorbed).drop("most")
    spelt = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    named = kept.join(spelt.select("ids", "lang", F.concat_ws(" ", "w.word").alias("phrase")), "ids")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of every share hold the first of all, so one language is ranked in a bounded number of rows
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    near = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    some = named.withColumn("share", share).withColumn("near", near).filter(F.col("near") <= first)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
