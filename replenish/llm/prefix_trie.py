"""The trie of conversations' prefixes, with totals of every subtree by centroid decomposition.

A prefix is known by the xor of two 64-bit hashes of its (place, turn) pairs, which are running values over the
places of a conversation: pieces of 4096 turns are summed up alone and carried on, so a very long
conversation is spread over its pieces. A node is named by its smallest member and its depth; the nodes that a
conversation names are a run at the end of its path.

Totals over subtrees come from the forest of parent edges: a component is split at its centroid, the deepest
node that holds at least half of it. The total of what hangs there, centroid included, is added to
every node on the path from the centroid to the component's top; what hangs below each child and
the rest above become components of at most half the size. So the rounds are logarithmic in the number of
nodes, also for one long chain. Components above ``LOCAL`` nodes are split by joins, all of them in one round;
smaller ones are finished in one task each, the same way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replenish.llm.tables import broadcast_if_small
from replenish.session import stored

# fixed values of the contract
STEP, SHARED = 5, 9

PIECE = 4096
LOCAL = 1 << 16
CENTROIDS = 50_000
_IDS = 16
_NODE = ["owner", "depth"]


# ---------------------------------------------------------------- conversations


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, digest, size) of every turn of a known conversation.

    ``place`` grows by one inside a part of the sort by conversation, turn (null first), role and text.
    """
    turns = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    rows = placed.select(
        "conv_id", F.shiftright("place", 33).alias("part"), "place", F.unhex(digest).alias("digest"), F.octet_length("text").cast("long").alias("size")
    )
    return stored(rows, "trie-turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, size) of the rebuilt conversations, and (conv_id, turns) of them all."""
    rows = ordered_turns(conversations)
    runs = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    runs = runs.withColumn("before", before)
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % STEP
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    heads_of = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plans = sizes.withColumn("base", base).withColumn("h", shared).join(heads_of, "base", "left")
    plans = plans.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("turns", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plans = stored(plans.select("conv_id", "base", "h", "lent", "turns"), "trie-plans")
    runs = runs.join(plans.select("conv_id", "h", "lent"), "conv_id").select("conv_id", "part", "first", "before", "h", "lent")
    at = rows.join(runs, ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("place") - F.col("first"))
    at = stored(at.select("conv_id", "at", "h", "lent", "digest", "size"), "trie-places")
    own = at.filter("at >= h").select("conv_id", (F.col("lent") + F.col("at") - F.col("h")).alias("place"), "digest", "size")
    firsts = at.filter((F.col("at") < SHARED) & (F.col("conv_id") % STEP == 0)).select(F.col("conv_id").alias("base"), "at", "digest", "size")
    lent = plans.select("conv_id", "base", "h").join(firsts, "base").filter("at < h").select("conv_id", F.col("at").alias("place"), "digest", "size")
    return own.union(lent), plans.select("conv_id", "turns")


def prefixes(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, depth, x, y, above_x, above_y, size): every prefix of one turn or more by its hashes and those of the prefix above."""
    hashed = turns.withColumn("piece", F.floor(F.col("place") / piece)).withColumn("gx", F.xxhash64("place", "digest")).withColumn("gy", F.xxhash64("digest", "place"))
    whole = hashed.groupBy("conv_id", "piece").agg(F.bit_xor("gx").alias("wx"), F.bit_xor("gy").alias("wy"))
    past = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.bit_xor(c).over(past), F.lit(0).cast("long")).alias(n) for c, n in (("wx", "cx"), ("wy", "cy"))]
    inside = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = hashed.withColumn("ix", F.bit_xor("gx").over(inside)).withColumn("iy", F.bit_xor("gy").over(inside))
    rows = rows.join(whole.select("conv_id", "piece", *carried), ["conv_id", "piece"])
    x, y = F.col("ix").bitwiseXOR(F.col("cx")), F.col("iy").bitwiseXOR(F.col("cy"))
    return rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("gx")).alias("above_x"), y.bitwiseXOR(F.col("gy")).alias("above_y"), "size"
    )


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of the rebuilt conversations.

    ``nodes``: owner, depth, parent, n_convs, size (bytes of the last text); ``paths`` (conv_id, depth, owner, parent, ends):
    the node of every conversation at every depth from 0 to its number of turns.
    """
    turns, every = rebuilt(conversations)
    rows = stored(prefixes(turns), "trie-prefixes")
    key = ["depth", "x", "y"]
    distinct = rows.groupBy(*key).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("above_x").alias("above_x"), F.first("above_y").alias("above_y"), F.first("size").alias("size")
    )
    distinct = stored(distinct, "trie-prefix-nodes")
    root = every.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = root.first()
    least = F.lit(top["owner"] if top else None).cast("long")
    above = distinct.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("above_x"), F.col("y").alias("above_y"), F.col("owner").alias("_parent"))
    nodes = distinct.join(above, ["depth", "above_x", "above_y"], "left")
    nodes = stored(nodes.select(*key, "owner", F.coalesce("_parent", least).alias("parent"), "n_convs", "size"), "trie-nodes")
    paths = rows.select("conv_id", *key).join(nodes.select(*key, "owner", "parent"), key).join(every, "conv_id")
    paths = paths.select("conv_id", "depth", "owner", "parent", (F.col("depth") == F.col("turns")).alias("ends"))
    start = every.select("conv_id", F.lit(0).cast("long").alias("depth"), least.alias("owner"), F.lit(None).cast("long").alias("parent"), (F.col("turns") == 0).alias("ends"))
    first = root.select("owner", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("size"))
    return nodes.select("owner", "depth", "parent", "n_convs", "size").union(first), stored(paths.union(start), "trie-paths")


# ---------------------------------------------------------------- totals of subtrees


def held(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(owner, depth, held): the nodes of each subtree, which the first split of components starts from.

    A member other than the owner names its nodes below this one, all of them; the owner also those above.
    """
    named = nodes.groupBy("owner").agg(F.count("*").alias("named"), F.min("depth").alias("highest"))
    rows = paths.join(named.select(F.col("owner").alias("conv_id"), "named"), "conv_id")
    sums = rows.groupBy(*_NODE).agg(F.sum("named").alias("all"))
    return sums.join(named.select("owner", "highest"), "owner").select(*_NODE, (F.col("all") - F.col("depth") + F.col("highest")).alias("held"))


def decompose(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Totals over the subtree of each node of one component; ``parent`` is a place in the list, -1 at the top."""
    children: list[list[int]] = [[] for _ in parent]
    for v, p in enumerate(parent):
        if p >= 0:
            children[p].append(v)
    gone, size = [False] * len(parent), [0] * len(parent)
    totals = [[0] * len(v) for v in values]
    tops = [v for v, p in enumerate(parent) if p < 0]
    while tops:
        top = tops.pop()
        order = [top]
        for v in order:
            order += [u for u in children[v] if not gone[u]]
        for v in order:
            size[v] = 1
        for v in reversed(order[1:]):
            size[parent[v]] += size[v]
        half, centre = len(order), top
        while True:
            heavy = next((u for u in children[centre] if not gone[u] and 2 * size[u] >= half), None)
            if heavy is None:
                break
            centre = heavy
        below, part = [centre], []
        for v in below:
            part.append(values[v])
            below += [u for u in children[v] if not gone[u]]
        whole = [[sum(x) for x in zip(*part)]]
        at = centre
        while True:
            for k, x in enumerate(whole[0]):
                totals[at][k] += x
            if at == top:
                break
            at = parent[at]
        gone[centre] = True
        tops += [u for u in children[centre] if not gone[u]]
        if centre != top:
            tops.append(top)
    return totals


def _finish(names: list[str]):
    """Rows (top_owner, top_depth, owner, depth, parent, values) in the order of components and depth."""

    def rows(batches):
        now, nodes, done, size = None, [], [], 0

        def totals():
            place = {(n[0], n[1]): k for k, n in enumerate(nodes)}
            above = [-1 if (n[0], n[1]) == now else place[n[2], n[1] - 1] for n in nodes]
            for n, t in zip(nodes, decompose(above, [n[3:] for n in nodes])):
                done.append((n[0], n[1], *t))

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=["owner", "depth", *names])

        for batch in batches:
            for a, b, *node in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != now:
                    if nodes:
                        totals()
                        if len(done) > 50_000:
                            yield packed()
                            done = []
                    now, nodes = (a, b), []
                nodes.append(node)
        if nodes:
            totals()
        if done:
            yield packed()

    return rows


def rollup(nodes: DataFrame, paths: DataFrame, names: list[str], local: int = LOCAL) -> DataFrame:
    """(owner, depth, names...): sums of the columns ``names`` over the subtree of every node.

    ``nodes`` has owner, depth, parent (the parent's owner) and the columns; ``paths`` as from :func:`build`.
    """
    sized = nodes.join(held(nodes, paths), _NODE).select(*_NODE, "parent", "held", *names)
    top = sized.filter("parent is null").first()
    whole = [F.lit(top[c] if top else None).cast("long").alias(n) for c, n in (("owner", "top_owner"), ("depth", "top_depth"), ("held", "total"))]
    now = stored(sized.select("*", *whole), "trie-components")
    small, added = [], []
    comp = ["top_owner", "top_depth"]
    columns = [*_NODE, "parent", "held", *names, *comp, "total"]
    while True:
        small.append(now.filter(F.col("total") <= local).select(*comp, *_NODE, "parent", *names))
        large = now.filter(F.col("total") > local)
        heavy = large.filter(2 * F.col("held") >= F.col("total")).groupBy(*comp)
        centres = heavy.agg(F.min(F.struct("held", "owner", "depth")).alias("c")).select(*comp, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.held").alias("c_held"))
        centres = stored(centres, "trie-centroids")
        if centres.isEmpty():
            break
        marked = large.join(broadcast_if_small(centres, CENTROIDS), comp)
        deeper, same = F.col("depth") > F.col("c_depth"), F.col("owner") == F.col("c_owner")
        step = paths.select(F.col("conv_id").alias("owner"), (F.col("depth") - 1).alias("c_depth"), F.col("owner").alias("child"), F.col("parent").alias("via"))
        other = marked.filter(deeper & ~same).join(step, ["owner", "c_depth"])
        rest = marked.filter(~deeper | same).withColumn("child", F.col("owner")).withColumn("via", F.when(deeper, F.col("c_owner")))
        split = other.unionByName(rest).withColumn("below", F.coalesce(F.col("via") == F.col("c_owner"), F.lit(False)))
        split = split.withColumn("is_centre", same & (F.col("depth") == F.col("c_depth")))
        split = stored(split, "trie-split")
        hung = split.filter("below or is_centre").groupBy(*comp).agg(*[F.sum(n).alias(n) for n in names])
        line = paths.join(broadcast_if_small(centres, CENTROIDS), F.col("conv_id") == F.col("c_owner"))
        line = line.filter(F.col("depth").between(F.col("top_depth"), F.col("c_depth")))
        line = line.select(*comp, *_NODE, "c_held").join(hung, comp)
        line = stored(line.select(*comp, *_NODE, "c_held", *names), "trie-lines")
        added.append(line.select(*_NODE, *names))
        down = split.filter("below").withColumn("top_owner", F.col("child")).withColumn("top_depth", F.col("c_depth") + 1)
        sizes = down.filter((F.col("owner") == F.col("top_owner")) & (F.col("depth") == F.col("top_depth"))).select(*comp, F.col("held").alias("_total"))
        down = down.join(sizes, comp).withColumn("total", F.col("_total")).select(*columns)
        up = split.filter("not below and not is_centre").join(line.select(*comp, *_NODE, F.col("c_held").alias("less")), [*comp, *_NODE], "left")
        up = up.withColumn("held", F.col("held") - F.coalesce("less", F.lit(0))).withColumn("total", F.col("total") - F.col("c_held")).select(*columns)
        now = stored(down.union(up), "trie-components")
    parts = small[0]
    for more in small[1:]:
        parts = parts.union(more)
    ordered = parts.repartition(*comp).sortWithinPartitions(*comp, "depth")
    schema = ", ".join(f"{c} long" for c in [*_NODE, *names])
    totals = ordered.mapInArrow(_finish(names), schema)
    for more in added:
        totals = totals.union(more)
    return totals.groupBy(*_NODE).agg(*[F.sum(n).alias(n) for n in names])


# ---------------------------------------------------------------- result


def _hashed(batches):
    now, sha = None, None
    for batch in batches:
        out = []
        for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (owner, depth) != now:
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (owner, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield _hash_rows(out)
    if now:
        yield _hash_rows([(*now, sha.hexdigest())])


def _hash_rows(rows) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["owner", "depth", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of the nodes at which conversations end; ids are joined by blocks and hashed in order."""
    block = F.shiftright("conv_id", _IDS).alias("block")
    lists = paths.filter("ends").groupBy(*_NODE, block).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = lists.select(*_NODE, "block", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    ordered = texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ids")
    return ordered.mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. Null roles and
    texts are empty. Rows without conv_id belong to no conversation and are left out; other columns are not read.
    An empty table has no node, not even a root.
    """
    nodes, paths = build(conversations)
    born = nodes.filter("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(born, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    nodes = stored(nodes, "trie-values")
    totals = rollup(nodes, paths, ["n_leaves", "saved_tokens"], local)
    rows = nodes.select(*_NODE, "parent", "n_convs", "n_children").join(totals, _NODE).join(ends(paths), _NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
