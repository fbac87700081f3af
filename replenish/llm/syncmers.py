"""Document fingerprints from closed syncmers.

A run of ``K`` bytes is an anchor if the least of the hashes of its inner runs of ``S`` bytes lies at one
of its two ends. Whether a run is one is seen from its own bytes alone, so equal passages have equal anchors
wherever they stand, and of K - S runs in a row at least one is an anchor. A fingerprint is the text's
anchors in order, six hex digits each; a text without any has one anchor made of the whole text. Two fingerprints are
compared by position: equal anchors are paired occurrence by occurrence, and a pair counts if the pair
before or after it lies at the same distance.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 32, 8
_STEP = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _inner(raw: np.ndarray) -> np.ndarray:
    """Hash of the eight bytes at every place; different runs have different hashes."""
    n = len(raw) - S + 1
    out = np.empty(n, np.uint64)
    for k in range(min(S, n)):
        part = raw[k : k + (n - k + S - 1) // S * S]
        out[k::S] = np.frombuffer(part.tobytes(), "<u8", len(part) // S)
    out *= _ODD
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    span, low = 1, x
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(x) - width + 1], low[width - span :]) if span < width else low


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of 24 bits) of the closed syncmers of a text, in order."""
    places, hashes = [], []
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - K + 1, _STEP):
        inner = _inner(raw[at : at + _STEP + K - 1])
        low = _least(inner, K - S + 1)
        n = len(low)
        found = np.flatnonzero((inner[:n] == low) | (inner[K - S : K - S + n] == low))
        whole = inner[found]
        for k in range(S, K, S):
            whole = (whole ^ (whole >> np.uint64(29))) * _MIX + inner[found + k]
        whole = (whole ^ (whole >> np.uint64(31))) * _ODD
        places.append(found + at)
        hashes.append(whole >> np.uint64(40))
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


def with_fallback(text: bytes, hashes: np.ndarray) -> np.ndarray:
    return hashes if len(hashes) else np.array([xxhash.xxh64_intdigest(text) >> 40], np.uint64)


def spelt(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 5:].tobytes().hex()


def read_back(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 3).astype(np.uint64)
    return raw[:, 0] << np.uint64(16) | raw[:, 1] << np.uint64(8) | raw[:, 2]


def _ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) in key order; a key is a hash with the number of its occurrence."""
    order = hashes.argsort(kind="stable")
    own = hashes[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    first = np.flatnonzero(new)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return own << np.uint64(40) | nth.astype(np.uint64), order


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of two fingerprints that stand in common passages, 0 to 1; 1 for equal ones."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    (ka, pa_), (kb, pb) = _ranked(a), _ranked(b)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    x, y = pa_[ia], pb[ib]
    order = x.argsort()
    gap = (y - x)[order]
    step = gap[1:] == gap[:-1]
    held = np.zeros(len(gap), bool)
    held[1:] |= step
    held[:-1] |= step
    return float(2 * held.sum() / (len(a) + len(b)))


def _cut(text: str) -> int:
    return len(text) - len(text) // 2


class _Text:
    """A text with its anchors, worked out once though it is compared twice."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode()
        self.places, self.own = anchors(self.raw)
        self.hashes = with_fallback(self.raw, self.own)


def _edited(a: _Text, b: _Text) -> tuple[str, np.ndarray]:
    """SHA-256 and anchors of a's first half with b's beginning in place of its rest.

    As anchors don't depend on what stands around them, those of both texts are taken over, and only the
    runs across the seam are looked at.
    """
    n, half = _cut(a.text), len(a.text) // 2
    left, right = a.text[:n].encode(), b.text[:half].encode()
    seam, _k = left[-(K - 1) :], K - 1
    places, hashes = anchors(seam + right[:_k])
    within = places + K > len(seam)
    within &= places < len(seam)
    parts = [a.own[a.places + K <= len(left)], hashes[within], b.own[b.places + K <= len(right)]]
    sha = hashlib.sha256(left)
    sha.update(right)
    found = np.concatenate(parts)
    return sha.hexdigest(), found if len(found) else with_fallback(left + right, found)


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_RESULT = pa.schema(_FIELDS)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

def _row(doc_id, a: _Text, b: _Text) -> dict:
    sha, edited = _edited(a, b)
    return {
        "doc_id": doc_id, "n_chars": len(a.text), "edited_sha256": sha, "fingerprint": spelt(a.hashes), "edited_fingerprint": spelt(edited),
        "near_edited": likeness(a.hashes, edited), "near_next": likeness(a.hashes, b.hashes),
    }


def _key(doc_id: int | None, tie: int) -> tuple[bool, int, int]:
    return doc_id is not None, doc_id or 0, tie


_PACKED = pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])


def _pack(shared):
    """Rows with their part, texts compressed; rows of a batch that agree in id and text become one with a count."""

    def rows(batches):
        bounds, press = shared.value, zstandard.ZstdCompressor(1)
        for batch in batches:
            seen: dict[tuple, list] = {}
            for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                key = _key(doc_id, tie)
                if key in seen:
                    seen[key][4] += 1
                else:
                    seen[key] = [bisect_right(bounds, key) - 1, False, doc_id, tie, 1, press.compress(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*seen.values()), _PACKED)] if seen else [[]] * 6, schema=_PACKED)

    return rows


def _in_order(batches):
    """Every row of a part with the next in order; the part's last row comes from the next part and is only looked at."""
    press, last, out, size = zstandard.ZstdDecompressor(), None, [], 0
    for batch in batches:
        for part, only, doc_id, tie, n, packed in zip(*(batch.column(i) for i in range(6))):
            key = (part.as_py(), *_key(doc_id.as_py(), tie.as_py()))
            if last is not None and last[0][0] == key[0]:
                before, count = last[1], last[2]
                if key == last[0] and not only.as_py():
                    last = (key, before, count + n.as_py(), last[3])
                    continue
                now = _Text(press.decompress(packed.as_buffer()).decode())
                out += [_row(last[3], before, before)] * (count - 1) + [_row(last[3], before, now)]
                size += len(before.raw) * count
            else:
                now = _Text(press.decompress(packed.as_buffer()).decode())
            last = (key, now, n.as_py(), doc_id.as_py())
            if size > _STEP:
                yield pa.RecordBatch.from_pylist(out, schema=_RESULT)
                out, size = [], 0
            if only.as_py():
                last = None
    yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


SAMPLES = 20


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The order is ascending doc_id, null first, then the text's hash; rows that agree in both are alike. The
    edited text has its last half replaced by the beginning of the next text, the last row's next is the
    first. ``near_edited`` and ``near_next`` compare a text with its edited form and with the next. Null texts are empty;
    empty texts are all alike. Repeated rows stay; an empty table gives no rows; other columns are not read.

    Parts of the order begin at rows of the table; about ``SAMPLES`` keys a part are drawn to choose them, which bounds
    what the driver sees and touches no result. The first text of each part also goes to the end of the one before, so every
    row meets its next in its own part. Texts are shuffled once, compressed; rows that agree are counted before.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    keys = rows.select("doc_id", "tie")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    least, count = keys.agg(F.min(order).alias("least"), F.count("*").alias("n")).first()
    if least is None:
        return spark.createDataFrame([], RESULT)
    drawn = keys.sample(min(1.0, SAMPLES * parts / count), 1).select(order.alias("k")).distinct().collect()
    sample = sorted({tuple(r["k"]) for r in drawn} | {tuple(least)})
    bounds = sorted({sample[len(sample) * k // parts] for k in range(parts)} | {tuple(least)})
    shared = spark.sparkContext.broadcast(bounds)
    packed = rows.mapInArrow(_pack(shared), "part int, last boolean, doc_id long, tie long, n long, packed binary")
    # the beginning of part k ends part k - 1
    firsts = [((k - 1) % len(bounds), b[1] if b[0] else None, b[2]) for k, b in enumerate(bounds)]
    firsts = F.broadcast(spark.createDataFrame(firsts, "part int, first_id long, first_tie long"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    heads = rows.join(firsts, same).select("part", "doc_id", "tie", "text").dropDuplicates(["part"])
    heads = heads.mapInArrow(_pack_heads, packed.schema)
    dealt = packed.union(heads).repartitionById(len(bounds), "part")
    ordered = dealt.sortWithinPartitions("part", "last", F.col("doc_id").isNotNull(), "doc_id", "tie")
    return ordered.mapInArrow(_in_order, RESULT)


def _pack_heads(batches):
    press = zstandard.ZstdCompressor(1)
    for batch in batches:
        part, doc_id, tie, text = batch.columns
        n = len(batch)
        packed = pa.array([press.compress(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part, pa.array([True] * n), doc_id, tie, pa.array([1] * n, pa.int64()), packed], schema=_PACKED)
