"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The table's size bounds what is broadcast: this many rows of 12 bytes.
LARGEST_TABLE = 655_373


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's order of slots; any step below a prime size visits every slot."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int) -> np.ndarray:
    """Index of the shard of each slot: the shards take turns, each claiming the first slot in its own
    order of preference that is still free, until none is."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be some different names")
    if not is_prime(size) or not len(shards) <= size <= LARGEST_TABLE:
        raise ValueError(f"the size must be a prime from the number of shards to {LARGEST_TABLE}")
    at, step = map(list, zip(*(preference(s, size) for s in shards), strict=True))
    table = np.full(size, -1, np.int32)
    filled = 0
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % size
            table[slot] = i
            at[i] = (slot + step[i]) % size
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the size; a null key counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def shard_rows(df: DataFrame, shards: list[str], size: int = 65_537, key: str = "doc_id") -> DataFrame:
    """df with columns slot and shard. The table of slots, whose size is checked, is broadcast; each row
    is placed by one lookup, without a shuffle, and a change of shards moves few other rows.

    A null key has the slot of the empty text; equal keys share a shard; an empty table stays empty.
    Columns named slot or shard that df already has are replaced.
    """
    spark: SparkSession = df.sparkSession
    table = lookup_table(shards, size)
    names = [shards[i] for i in table.tolist()]
    slots = spark.createDataFrame(list(zip(range(size), names, strict=True)), T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("shard", T.StringType())]))
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return keyed.join(F.broadcast(slots), "slot").select(*keyed.columns, "shard")
