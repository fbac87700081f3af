"""Quotient filters as exact round trips, and phrases against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import rows

from replenish.llm import collocations


def plain(pairs, least, first=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(x) > len(g) and 100 * b >= 80 * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, b in cand.items())
            if not inside:
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1)]
    return out


@pytest.mark.parametrize("length", [2, 3, 4])
@pytest.mark.parametrize("width", [2, 6, 18, 32])
def test_filters_lose_nothing(length, width):
    rng = np.random.default_rng(length * width)
    shape = collocations.Shape(length, width)
    words = [rng.integers(0, 1 << min(width, 5 if width > 6 else width), 3000).astype(np.uint64) << np.uint64(max(width - 5, 0) if width > 6 else 0) for _ in range(length)]
    packed = shape.pack(words)
    assert all((a == b).all() for a, b in zip(words, shape.unpack(*packed)))
    want = Counter(zip(*(w.tolist() for w in words)))
    for base in (0, 2):
        parts = []
        for some in (slice(0, 1000), slice(1000, None), slice(0, 0)):
            high, low, counts = shape.counted(*(x[some].copy() for x in packed))
            segment = shape.top(high, base) if base else np.zeros(len(high), np.uint64)
            for s in np.unique(segment):
                at = segment == s
                blob = collocations.pack_filter(shape, base, high[at], low[at], counts[at] * 300)
                parts.append(collocations.unpack_filter(blob)[1:])
        high, low, counts = collocations.merge_filters(parts, shape)
        got = dict(zip(zip(*(x.tolist() for x in shape.unpack(high, low))), counts.tolist()))
        assert got == {k: 300 * n for k, n in want.items()}
        order = list(zip(high.tolist(), low.tolist()))
        assert order == sorted(set(order))


def test_phrases(spark, docs, cases, empty, monkeypatch):
    assert rows(collocations.collocations(docs, 2000, 3)) == sorted(plain([(lang, t) for _, t, lang, _ in cases], 3), key=repr)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs).filter("a < 30").count() == 0


def test_phrases_of_few_words(spark, monkeypatch):
    """Small blocks and slices, so that filters of many blocks meet and long texts are cut."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 50)
    random.seed(5)
    pairs = []
    for k in range(60):
        words = random.choices(["New", "york", "city", "of", "the", "São P", "x\x1cy", "a", "b"], [5, 5, 5, 9, 9, 3, 3, 1, 1], k=random.choice([1, 10, 80]))
        pairs.append((random.choice(["en", "fr", None, "und"]), "".join(w + random.choice([" ", " ", " ", "\t", ", ", "\r\n", ".", "  "]) for w in words)))
    pairs += [("en", "new york " * 50), ("en", None), (None, ""), ("xx", " ,. ")]
    df = spark.createDataFrame(pairs, "lang string, text string").repartition(4).withColumn("ids", F.lit("mine")).withColumn("a", F.lit(1))
    for first in (2000, 3):
        assert rows(collocations.collocations(df, first, 4)) == sorted(plain(pairs, 4, first), key=repr)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "_SLICE", 10)
    for text in (b"", b"a" * 100, b"ab cd. " * 20, b"a" * 35 + b" b" * 30):
        parts = list(collocations._slices(text))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
