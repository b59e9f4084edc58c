"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own (offset and step from its name); shards
take turns claiming their next free slot. A key's slot is a hash modulo the table size, so placing is one look-up in
a broadcast table, loads differ by a few slots in a thousand, and adding or removing a shard moves few keys.

Defined results: a null key is placed like the empty text; repeated keys go to the same shard; columns of the input
named slot, shard_id or shard are replaced, the key's own value being read first; an empty table gives no rows. The table has `size` rows whatever the data, so its broadcast is bounded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common

SHARDS = 128
#: A prime well above 100 times the number of shards.
TABLE_SIZE = 65_537


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """slot -> index of the shard."""
    if not shards or len(shards) > size or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime size of at least the number of shards, and a shard")
    offset = [zlib.crc32(f"offset {s}".encode()) % size for s in shards]
    step = [zlib.crc32(f"step {s}".encode()) % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int32)
    at = list(offset)
    left = size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot(key, size: int = TABLE_SIZE):
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(docs: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot, shard_id and shard."""
    spark = docs.sparkSession
    filled = lookup_table(shards, size)
    lookup = spark.createDataFrame(pa.table({"slot": pa.array(range(size), pa.int32()), "shard_id": pa.array(filled), "shard": pa.array([shards[i] for i in filled])}))
    rest = [c for c in docs.columns if c.lower() not in ("slot", "shard_id", "shard")]
    return docs.select(slot(F.col(key), size).alias("slot"), *rest).join(F.broadcast(lookup), "slot")


def write(docs: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE, files: int = 8) -> None:
    """One folder per shard. Rows of a shard are dealt to `files` tasks by their place in the input, so neither a hot shard nor a hot key is a single task."""
    placed = place(docs, key, shards, size)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    dealt = placed.withColumn("_part", part).repartition(common.partitions(docs.sparkSession), "shard", "_part")
    dealt.drop("_part").write.partitionBy("shard").parquet(path)


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)]).select("doc_id", "slot", "shard_id", "shard", "n_bytes")
