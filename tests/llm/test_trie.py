"""The prefix trie against a plain one, with components split in every size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import rows

from replenish.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    members, last = defaultdict(list), defaultdict(list)
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        # the remainder has the sign of c, as in SQL
        whole = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + x[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        last[whole].append(c)
    children = defaultdict(list)
    for g in members:
        if g:
            children[g[:-1]].append(g)
    totals = {}
    for g in sorted(members, key=len, reverse=True):
        saved = (len(members[g]) - 1) * len(g[-1][1].encode()) if g else 0
        parts = [totals[x] for x in children[g]]
        totals[g] = (sum(p[0] for p in parts) or 1, saved + sum(p[1] for p in parts))
    return [
        (min(m), len(g), min(members[g[:-1]]) if g else None, len(m), len(children[g]), *totals[g], hashlib.sha256(",".join(map(str, sorted(last[g]))).encode()).hexdigest())
        for g, m in members.items()
    ]


def made(seed, convs, longest):
    random.seed(seed)
    out = []
    for c in range(convs):
        if c % 7 == 3:
            continue
        like = random.choice([0, 0, 1, 2, c])
        for k in range(random.choice([1, 2, 9, longest])):
            out.append((c, None if random.random() < 0.1 else k, random.choice(["user", None]) if k == like else "user", f"turn {k} é" if random.random() < 0.9 else f"own {c}"))
    return out


@pytest.mark.parametrize("local", [1, 3, 1 << 16])
def test_trie(spark, local):
    turns = made(1, 40, 15) + [(None, 1, "user", "of none"), (100, 0, None, None), (100, 0, None, None), (-4, 2, "user", "x"), (2**40, 1, "a", "y" * 20_000)]
    df = spark.createDataFrame(turns, SCHEMA).repartition(3).withColumn("owner", F.lit("mine")).withColumn("depth", F.lit(1)).withColumn("place", F.lit(2))
    assert rows(prefix_trie.prefix_trie(df, local)) == sorted(plain(turns), key=repr)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # without its base and with fewer turns than it leaves out: turnless, a member of the root only
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(alone, 0, "user", "hi")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_long_conversations_are_cut_in_pieces(spark):
    turns = [(0, k, "user", f"t{k % 3}") for k in range(500)] + [(5, k, "user", f"t{k % 3}") for k in range(490)] + [(9, 0, "a", "b")]
    df = spark.createDataFrame(turns, SCHEMA)
    want = plain(turns)
    assert rows(prefix_trie.prefix_trie(df, 64)) == sorted(want, key=repr)
    got = prefix_trie.prefixes(prefix_trie.rebuilt(df)[0], piece=7)
    same = prefix_trie.prefixes(prefix_trie.rebuilt(df)[0], piece=4096)
    assert rows(got.drop("digest")) == rows(same.drop("digest")) and got.select("depth", "x", "y").distinct().count() == len(want) - 1


def test_decomposition_is_balanced(monkeypatch):
    random.seed(3)
    for parent in ([-1, *range(2000)], [-1] + [0] * 2000, [-1, *(random.randrange(k + 1) for k in range(2000))]):
        values = [[1, random.randrange(-(10**20), 10**20)] for _ in parent]
        want = [list(v) for v in values]
        for v in range(len(parent) - 1, 0, -1):
            for k in (0, 1):
                want[parent[v]][k] += want[v][k]
        assert prefix_trie.decompose(parent, values) == want
