"""Removal of long repeated passages by seeds and their extension.

Seeds are winnowed word n-grams: of the n-grams in every window of LENGTH words the one with the
smallest hash (the last of equals) is its anchor, so equal windows have equal anchors at the same
place. A row stands for an anchor and the run of consecutive windows that it serves. Anchors that
occur once are dropped; the others are joined and extended both ways:

1. An anchor's run is extended to its full reach and hashed. Occurrences with equal full reach repeat
   each other in all their windows at once. This settles whole copies and the inside of passages.
2. Where the reach of an anchor's occurrences differs, each different reach is extended window by
   window, once however often it occurs, and equal windows are found by 128 hash bits.

So no pairs are made within an anchor's occurrences, however many there are. Repeated windows that
touch or overlap add up to maximal repeats, and their words go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.session import stored

LENGTH = 35
GRAM = 8
_CACHE = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POSITION = np.uint64((1 << 24) - 1)


class _Words(dict):
    """Hashes of words seen so far in this worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Powers:
    """Powers of an odd base and its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self, base: int):
        self.steps = [np.uint64(base), np.uint64(pow(base, -1, 1 << 64))]
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int):
        while len(self.tables[0]) < n:
            for k, step in enumerate(self.steps):
                have = self.tables[k]
                self.tables[k] = np.concatenate([have, have * (have[-1:] * step)])
        return self.tables[0][:n], self.tables[1][:n]


_WORDS = _Words()
_POWERS = [_Powers(b) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


class Spans:
    """Hashes of any span of words: polynomial, so that they depend on the words only."""

    def __init__(self, hashes: np.ndarray, which: int):
        n = len(hashes)
        self.power, inverse = _POWERS[which].upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_mix(hashes) if which else hashes) * inverse[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.power[start])


def anchors(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, hash of its full reach, first window, last window) of each run of windows with one anchor."""
    n = len(hashes)
    spans = Spans(hashes, 0)
    at = np.arange(n - gram + 1)
    seeds = spans.of(at, at + gram)
    # smallest hash with the last position first among equals, over length - gram + 1 seeds
    width = length - gram + 1
    low = (seeds & ~_POSITION) | (_POSITION - at.astype(np.uint64) % (_POSITION + np.uint64(1)))
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.concatenate((first[1:], [len(low)])) - 1
    anchor = low[first]
    return anchor & ~_POSITION, spans.of(first, last + length), first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seed_rows(length: int, gram: int):
    def rows(batches):
        for batch in batches:
            ids, marks, texts = batch.columns
            parts, counts = [], []
            for text in texts.cast(pa.binary()).to_pylist():
                hashes = word_hashes(text)
                counts.append(0)
                if len(hashes) >= length:
                    parts.append(anchors(hashes, length, gram))
                    counts[-1] = len(parts[-1][0])
            if not parts:
                continue
            h, f, s, e = (np.concatenate(x) for x in zip(*parts))
            row = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), marks.take(pa.array(row)), _signed(h), _signed(f), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                names=["doc_id", "mark", "h", "f", "s", "e"],
            )

    return rows


def _window_rows(length: int):
    def rows(batches):
        for batch in batches:
            ids, marks, texts, runs = batch.columns
            for k, (text, own) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), runs.to_pylist())):
                hashes = word_hashes(text)
                start = np.concatenate([np.arange(r["s"], r["e"] + 1) for r in own])
                at = pa.array(np.full(len(start), k))
                pair = [_signed(Spans(hashes, w).of(start, start + length)) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), marks.take(at), *pair, pa.array(start.astype(np.int32))],
                    names=["doc_id", "mark", "w0", "w1", "s"],
                )

    return rows


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    kept, total, removed = [], [], []
    for t, own in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
        words = t.split() if t else []
        total.append(len(words))
        if own:
            edge = np.zeros(len(words) + 1, np.int64)
            for r in own:
                edge[r["s"]] += 1
                edge[r["e"]] -= 1
            stays = np.cumsum(edge)[:-1] == 0
            words = [words[i] for i in np.flatnonzero(stays).tolist()]
        kept.append(b" ".join(words))
        removed.append(total[-1] - len(words))
    columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
    return pa.StructArray.from_arrays(columns, ["kept", "n_words", "n_removed"])


_cut_udf = F.arrow_udf(
    _cut,
    T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]),
)


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["its_id"]) & (left["mark"] == right["its_mark"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(its_id, its_mark, spans): repeated spans [s, e) of words of each document that has some; mark is the text's hash."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    schema = "doc_id long, mark long, h long, f long, s int, e int"
    seeds = stored(marked.mapInArrow(_seed_rows(length, gram), schema), "substring-seeds")
    # stored apart from the join, which Spark can then split at hot anchors
    twice = stored(seeds.groupBy("h").count().filter("count > 1").select("h"), "substring-repeated-anchors")
    seeds = stored(seeds.join(twice, "h", "left_semi"), "substring-repeated-seeds")
    one = F.min(F.struct("doc_id", "mark", "s", "e"))
    reaches = stored(seeds.groupBy("h", "f").agg(F.count("*").alias("n"), one.alias("one")), "substring-reaches")
    equal = seeds.join(reaches.filter("n > 1").select("h", "f"), ["h", "f"], "left_semi")
    spans = equal.select("doc_id", "mark", "s", (F.col("e") + length).alias("e"))
    # different reaches of one anchor, window by window
    mixed = stored(reaches.groupBy("h").count().filter("count > 1").select("h"), "substring-mixed-anchors")
    open_ = reaches.join(mixed, "h", "left_semi").select(F.col("one.doc_id").alias("its_id"), F.col("one.mark").alias("its_mark"), "one.s", "one.e")
    runs = open_.groupBy("its_id", "its_mark").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    windows = marked.join(runs, _same(marked, runs)).select("doc_id", "mark", "text", "runs")
    windows = stored(windows.mapInArrow(_window_rows(length), "doc_id long, mark long, w0 long, w1 long, s int"), "substring-windows")
    met = stored(windows.groupBy("w0", "w1").count().filter("count > 1").select("w0", "w1"), "substring-repeated-windows")
    found = windows.join(met, ["w0", "w1"], "left_semi").select("doc_id", "mark", "s", (F.col("s") + length).alias("e"))
    both = spans.union(found).select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "s", "e")
    # no more spans than the document has words
    return both.groupBy("its_id", "its_mark").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) of every row; kept is what stays, words joined by one space.

    A word goes if it lies in a window of ``length`` words that also starts anywhere else, in this
    or another row; all windows are judged on the input. Repeated rows repeat each other. Null and
    empty texts have no words and keep the empty text. Other columns are not read.
    """
    spans = repeats(docs, length, gram)
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    joined = marked.join(spans, _same(marked, spans), "left")
    return joined.select("doc_id", _cut_udf("text", "spans").alias("c")).select("doc_id", "c.*")
