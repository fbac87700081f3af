"""Near duplicates by SimHash fingerprints that differ in few bits.

Two fingerprints of eight bytes with at most four different bits have at least four bytes alike at
the same positions. The inverted index files a fingerprint under every choice of four byte positions
with their bytes: two fingerprints meet in one of its lists exactly if their tally of shared
positional bytes reaches that minimum, so pairs below it are never made (lists of single positional
bytes would hold 1/256 of all fingerprints each). A pair is tallied and verified in the first list
that both share. Fingerprints are indexed once, however many documents have them.

A list with more than ``LIST`` fingerprints is not paired: every member there is filed under all
values of the other four bytes at up to two bits from its own. Two members have a value in common
exactly if they differ in four bits or less, at most 529 members share one, and neighbours under a
value are linked, so the same components come out of work in proportion to the list.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.llm.components import components
from replenish.session import stored

SHINGLE = 4
SEED = 42
BITS = 4
LIST = 512
CHOICES = list(combinations(range(8), 4))
_BLOCK = 1 << 16
# byte -> its bits in eight lanes of one byte each
_LANES = np.packbits(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None]
    * np.array([0, 0, 0, 0, 0, 0, 0, 1], dtype=np.uint8),
    axis=2,
).reshape(256, 8).view(np.uint64).ravel()
# shared-byte mask -> number of the first choice of positions in it, -1 with fewer than four
_FIRST = np.full(256, -1, dtype=np.int64)
for _mask in range(256):
    _on = [p for p in range(8) if _mask >> p & 1]
    if len(_on) >= 4:
        _FIRST[_mask] = CHOICES.index(tuple(_on[:4]))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashed shingles of the lower-cased words; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    count = max(len(words) - shingle + 1, 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:count].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    of = xxhash.xxh64_intdigest
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, count, _BLOCK):
        pairs = zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])
        hashes = np.fromiter((of(line[i:j], SEED) for i, j in pairs), np.uint64, min(_BLOCK, count - at))
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        parts = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        totals += parts.view(np.uint8).reshape(len(parts), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > count, bitorder="little").view(np.int64)[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in text.cast(pa.binary()).to_pylist()], pa.int64())


fingerprints = F.arrow_udf(_fingerprints, T.LongType())


def postings(prints: DataFrame) -> DataFrame:
    """(key, fp): the 70 lists of each fingerprint; a key holds the choice of positions above their four bytes."""

    def key(number: int, choice) -> F.Column:
        out = F.lit(number << 32)
        for k, p in enumerate(choice):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * k))
        return out

    keys = [key(i, c) for i, c in enumerate(CHOICES)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _pairs(key: np.ndarray, fp: np.ndarray, bits: int):
    """Verified links within runs of one key."""
    out = []
    i = np.arange(len(key) - 1)
    shift = 1
    while len(i):
        i = i[i + shift < len(key)]
        i = i[key[i] == key[i + shift]]
        differ = (fp[i] ^ fp[i + shift]).view(np.uint64)
        alike = np.packbits(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()
        keep = (_FIRST[alike] == key[i] >> 32) & (np.bitwise_count(differ) <= bits)
        out.append((fp[i[keep]], fp[i[keep] + shift]))
        shift += 1
    return out


def _linker(bits: int, most: int):
    def link(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(key, fp):
            ends = np.flatnonzero(np.diff(key, append=key[-1:] - 1)) + 1
            sizes = np.diff(ends, prepend=0)
            large = np.repeat(sizes > most, sizes)
            found = _pairs(key[~large], fp[~large], bits) + [(key[ends[sizes > most] - 1], None)]
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["a", "b"]
                    )

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from done(key[:last], fp[:last])
            # the open run; one row over the bound is enough to know that it is large
            key, fp = key[last : last + most + 1], fp[last : last + most + 1]
        if len(key):
            yield from done(key, fp)

    return link


def _spreader(bits: int):
    half = bits // 2
    flips = []
    for choice in CHOICES:
        free = [8 * p + b for p in range(8) if p not in choice for b in range(8)]
        sets = [s for n in range(half + 1) for s in combinations(free, n)]
        flips.append(np.array([sum(1 << b for b in s) for s in sets], dtype=np.uint64).view(np.int64))

    def spread(batches):
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, f in zip(key.tolist(), fp):
                near = flips[k >> 32] ^ f
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), k)), pa.array(near), pa.array(np.full(len(near), f))],
                    names=["key", "near", "fp"],
                )

    return spread


def links(prints: DataFrame, bits: int = BITS, most: int = LIST) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within ``bits`` bits, or for large lists pairs with the same components.

    ``bits`` is 4: the minimum tally of four shared bytes follows from it.
    """
    if bits != 4:
        raise ValueError("the index is made for four bits")
    filed = postings(prints)
    sorted_ = filed.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(sorted_.mapInArrow(_linker(bits, most), "a long, b long"), "simhash-links")
    pairs, large = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("key"))
    if large.isEmpty():
        return pairs
    spread = filed.join(large, "key", "left_semi").mapInArrow(_spreader(bits), "key long, near long, fp long")
    before = F.lag("fp").over(Window.partitionBy("key", "near").orderBy("fp"))
    return pairs.union(spread.select(F.col("fp").alias("a"), before.alias("b")).filter("b is not null").distinct())


def groups(marked: DataFrame, most: int = LIST) -> DataFrame:
    """(fp, root) of the fingerprints of ``marked`` that have a link; root is the smallest of their component."""
    return components(links(marked.select("fp").distinct(), BITS, most)).withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, most: int = LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Rows with one fingerprint are linked, and so are fingerprints within four bits; component_id is
    the smallest doc_id that can be reached. Null and empty texts have fingerprint zero and are linked
    like any others. Repeated rows stay. A component without any doc_id has a null id. Other columns
    are not read; an empty table gives no rows.
    """
    marked = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash-prints")
    roots = groups(marked, most)
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp", "left")
    classes = classes.withColumn("root", F.coalesce("root", "fp"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = LIST) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, nulls last; of repeated rows any one."""
    own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, fingerprints(F.col("text")).alias("_fp"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows, "simhash-rows")
    at = f"_own_{docs.columns.index('doc_id')}"
    roots = groups(rows.select(F.col("_fp").alias("fp")), most)
    rank = F.struct(F.col(at).isNull(), F.col(at), F.col("_row"))
    first = rows.groupBy("_fp").agg(F.min(rank).alias("r")).join(roots, F.col("_fp") == F.col("fp"), "left")
    kept = first.groupBy(F.coalesce("root", "_fp")).agg(F.min("r").alias("r")).select(F.col("r._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])
