"""Sharding by a lookup table that the shards fill in turns.

Every shard has its own preference order over the slots of a table of prime size: a start and a
step, both hashed from its name, so that the order is a permutation. The shards take turns, each
claiming the first slot of its order that is still free, until the table is full. A row's key hashes
to a slot, and the slot names the shard. Shares differ by at most one slot, and adding or removing a
shard moves little more than that shard's share of the keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64
SEED = "corpus"


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def preference(name: str, slots: int, seed: str = SEED) -> tuple[int, int]:
    """Start and step of a shard's order over the slots."""
    raw = hashlib.blake2b(f"{seed}/{name}".encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little") % slots, 1 + int.from_bytes(raw[8:], "little") % (slots - 1)


def fill(names: Sequence[str], slots: int = SLOTS, seed: str = SEED) -> list[int]:
    """Index of the owner of every slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, and at least one")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("the table needs a prime number of slots, at least one for each shard")
    orders = [preference(name, slots, seed) for name in names]
    here = [start for start, _ in orders]
    owner = [-1] * slots
    free = slots
    while free:
        for k, (_, step) in enumerate(orders):
            if not free:
                break
            at = here[k]
            while owner[at] >= 0:
                at = (at + step) % slots
            owner[at], here[k] = k, (at + step) % slots
            free -= 1
    return owner


def lookup(spark: SparkSession, names: Sequence[str], slots: int = SLOTS, seed: str = SEED) -> DataFrame:
    """The filled table as rows (slot, shard, shard_name); its size is ``slots``, whatever the data."""
    owner = fill(names, slots, seed)
    rows = [(slot, k, names[k]) for slot, k in enumerate(owner)]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(
    df: DataFrame,
    names: Sequence[str],
    key: str = "doc_id",
    otherwise: str | None = "text",
    slots: int = SLOTS,
    seed: str = SEED,
) -> DataFrame:
    """Each row with its slot, shard and shard_name.

    Rows with equal keys share a shard. A row without a key is placed by the column ``otherwise``, so
    that missing keys don't pile up in one shard; a row with neither goes to the slot of the null
    hash. Columns of the input named slot, shard or shard_name are replaced. An empty table stays empty.
    """
    hashed = F.xxhash64(F.col(key))
    if otherwise:
        hashed = F.when(F.col(key).isNotNull(), hashed).otherwise(F.xxhash64(F.col(otherwise)))
    table = lookup(df.sparkSession, names, slots, seed)
    rows = df.drop("slot", "shard", "shard_name").withColumn("slot", F.pmod(hashed, F.lit(slots)).cast("int"))
    return rows.join(F.broadcast(table), "slot")


def write(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder of Parquet files per shard.

    Rows stay in the tasks that placed them unless that would leave too many small files; a large
    shard is spread over as many writers as hold its rows, so no task writes a whole shard.
    """
    spread = placed.hint("rebalance", F.col("shard"))
    spread.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
