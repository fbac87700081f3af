"""Ids that are stored once, whatever batch they come in.

Stored ids lie in buckets by hash, a folder per batch and bucket. Every batch leaves a Bloom filter per bucket. A new
batch is held against the filters first; ids that no filter knows are new, and only the buckets of the others
are read for the exact answer. So a batch of new ids reads filters, ten bits an id, and no ids, and nothing
expires by time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.session import ship, stored

BUCKETS = 64
BITS_AN_ID, HASHES = 10, 7
KEYED = "id string, bucket int, h1 bigint, h2 bigint"
_FILTERS = pa.schema([("bucket", pa.int32()), ("filter", pa.binary())])
_PROBED = pa.schema([("id", pa.string()), ("bucket", pa.int32()), ("maybe", pa.bool_())])


def keyed(ids: Column, df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Distinct ids as text with their bucket and two hashes."""
    text = df.select(ids.cast("string").alias("id")).filter("id is not null").distinct()
    h1 = F.xxhash64("id")
    return text.select("id", F.pmod(F.shiftright(h1, 32), F.lit(buckets)).cast("int").alias("bucket"), h1.alias("h1"), F.xxhash64(F.lit("second"), "id").alias("h2"))


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """(ids, HASHES) bit numbers; ``bits`` is a power of two."""
    step = h2.astype(np.uint64) | np.uint64(1)
    return ((h1.astype(np.uint64)[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """Filter of a power of two of bits, at least ``BITS_AN_ID`` an id."""
    used = np.zeros(1 << max((BITS_AN_ID * len(h1) - 1).bit_length(), 6), bool)
    used[_places(h1, h2, len(used)).ravel()] = True
    return np.packbits(used).tobytes()


def may_hold(filter_: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(filter_, np.uint8)
    at = _places(h1, h2, 8 * len(raw))
    return (raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["h1"].to_numpy(), table["h2"].to_numpy()


def _build(table: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([table["bucket"].slice(0, 1), pa.array([bloom(*_hashes(table))], pa.binary())], schema=_FILTERS)


def _probe(ids: pa.Table, filters: pa.Table) -> pa.Table:
    maybe = np.zeros(len(ids), bool)
    for raw in filters["filter"]:
        maybe |= may_hold(raw.as_py(), *_hashes(ids))
    return pa.Table.from_arrays([ids["id"], ids["bucket"], pa.array(maybe)], schema=_PROBED)


def _batches(spark: SparkSession, path: str, but: int) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n.startswith("batch=") and n != f"batch={but}")


def unseen(ids: DataFrame, path: str, batch_id: int) -> tuple[DataFrame, list[int]]:
    """(the rows of :func:`keyed` ids that no other batch has stored, the buckets that were read to know)."""
    spark = ids.sparkSession
    ship(spark)
    others = _batches(spark, f"{path}/filters", batch_id)
    if not others:
        return ids, []
    filters = spark.read.schema("bucket int, filter binary").parquet(*[f"{path}/filters/{n}" for n in others])
    ids = stored(ids, "ids-batch")
    probed = ids.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_probe, "id string, bucket int, maybe boolean")
    probed = stored(probed, "ids-probed")
    # BUCKETS numbers at most
    asked = sorted(r["bucket"] for r in probed.filter("maybe").select("bucket").distinct().collect())
    if not asked:
        return ids, []
    held = spark.read.option("basePath", f"{path}/ids").schema("id string, batch int, bucket int").parquet(*[f"{path}/ids/{n}" for n in others])
    known = held.filter(F.col("bucket").isin(asked)).select("id")
    repeated = probed.filter("maybe").join(known, "id", "left_semi").select("id")
    return ids.join(repeated, "id", "left_anti"), asked


def record(ids: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch's new ids and their filters; a retried batch replaces its own. The filters come last and make it count."""
    ship(ids.sparkSession)
    ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids/batch={batch_id}")
    back = ids.sparkSession.read.option("basePath", f"{path}/ids/batch={batch_id}").schema(KEYED).parquet(f"{path}/ids/batch={batch_id}")
    filters = back.groupBy("bucket").applyInArrow(_build, "bucket int, filter binary")
    filters.write.mode("overwrite").parquet(f"{path}/filters/batch={batch_id}")


def first_of_each(rows: DataFrame, key: str, path: str, batch_id: int, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a batch whose id no other batch has stored, one per id, which are recorded as stored.

    Rows without an id are all kept. Of several rows of one id in the batch any one is kept.
    """
    rows = stored(rows, "ids-rows")
    new = stored(unseen(keyed(F.col(key), rows, buckets), path, batch_id)[0], "ids-new")
    record(new, path, batch_id)
    given = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    mine = new.select(F.col("id").alias("_id"))
    once = given.join(mine, F.col(key).cast("string") == F.col("_id"), "left_semi")
    return once.unionByName(rows.filter(F.col(key).isNull()))
