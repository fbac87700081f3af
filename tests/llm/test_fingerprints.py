"""Closed syncmers against a plain version of their definition."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_operators import rows

from replenish.llm import syncmers

ALL = (1 << 64) - 1


def plain_anchors(raw):
    def mixed(x):
        x = x * 0x9E3779B97F4A7C15 & ALL
        return (x ^ x >> 32) * 0xD6E8FEB86659FD93 & ALL

    inner = [mixed(int.from_bytes(raw[i : i + syncmers.S], "little")) for i in range(len(raw) - syncmers.S + 1)]
    out, width = [], syncmers.K - syncmers.S + 1
    for i in range(len(raw) - syncmers.K + 1):
        if min(inner[i : i + width]) in (inner[i], inner[i + width - 1]):
            v = inner[i]
            for k in range(syncmers.S, syncmers.K, syncmers.S):
                v = ((v ^ v >> 29) * 0xD6E8FEB86659FD93 + inner[i + k]) & ALL
            out.append((i, (v ^ v >> 31) * 0x9E3779B97F4A7C15 % (1 << 64) >> 40))
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    seen, places = {}, {}
    for k, h in enumerate(b):
        places[h, seen.setdefault(h, 0)] = k
        seen[h] += 1
    seen, gaps = {}, []
    for k, h in enumerate(a):
        at = places.get((h, seen.setdefault(h, 0)))
        seen[h] += 1
        if at is not None:
            gaps.append(at - k)
    held = sum((i > 0 and gaps[i - 1] == g) or (i + 1 < len(gaps) and gaps[i + 1] == g) for i, g in enumerate(gaps))
    return 2 * held / (len(a) + len(b))


def plain_print(text):
    raw = text.encode()
    found = [h for _, h in plain_anchors(raw)]
    return "".join(f"{h:06x}" for h in found) if found else syncmers.spelt(syncmers.with_fallback(raw, syncmers.anchors(raw)[1]))


def split(text):
    return [text[i : i + 6] for i in range(0, len(text), 6)]


def plain(pairs):
    order = sorted(((i, t or "") for i, t in pairs), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, changed, other = (plain_print(x) for x in (t, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), sha, own, changed, plain_likeness(split(own), split(changed)), plain_likeness(split(own), split(other))))
    return out


@pytest.mark.parametrize("step", [50, 1 << 20])
def test_anchors(monkeypatch, step):
    monkeypatch.setattr(syncmers, "_STEP", step)
    random.seed(1)
    for n in (0, 5, 31, 32, 33, 81, 82, 400):
        for letters in ("a", "ab", "abcdefghij é😀"):
            raw = "".join(random.choice(letters) for _ in range(n)).encode()
            places, hashes = syncmers.anchors(raw)
            assert list(zip(places.tolist(), hashes.tolist())) == plain_anchors(raw)
            # of K - S runs in a row one is chosen
            gaps = [b - a for a, b in zip([-1, *places.tolist()], [*places.tolist(), len(raw) - syncmers.K + 1])]
            assert len(raw) < syncmers.K or max(gaps) <= syncmers.K - syncmers.S
            assert (syncmers.read_back(syncmers.spelt(hashes)) == hashes).all()


def test_fingerprints_of_edits(spark, docs, cases, empty):
    unique = [(k, t) for k, (_, t, *_) in enumerate(cases)] + [(None, "no id " * 30), (-7, "x" * 5000)]
    df = spark.createDataFrame(unique, "doc_id long, text string").repartition(5).withColumn("part", F.lit("mine")).withColumn("tie", F.lit(1))
    assert rows(syncmers.fingerprint_edits(df)) == sorted(plain(unique), key=repr)
    # ties and repeated rows: as many rows, equal texts with equal fingerprints
    got = syncmers.fingerprint_edits(docs).collect()
    assert len(got) == len(cases)
    assert len({r["fingerprint"] for r in got}) == len({t or "" for _, t, *_ in cases})
    assert syncmers.fingerprint_edits(empty).count() == 0
    one = syncmers.fingerprint_edits(spark.createDataFrame([(1, "just this one text, which is its own next text " * 3)], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and 0 < one["near_edited"] <= 1


def test_likeness_by_position():
    random.seed(2)
    first, second = ("".join(random.choice("abcdefghijkl ") for _ in range(5000)) for _ in range(2))
    prints = [syncmers.anchors(x.encode())[1] for x in (first, second, "moved " * 20 + first, first[:2500] + second[:2500])]
    assert syncmers.likeness(prints[0], prints[1]) < 0.02
    assert syncmers.likeness(prints[0], prints[2]) > 0.9
    assert 0.4 < syncmers.likeness(prints[0], prints[3]) < 0.6
