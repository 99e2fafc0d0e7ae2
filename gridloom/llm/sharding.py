"""Sharding by a permutation-filled lookup table of prime size.

Every shard has its own preference order of the table's slots (offset and skip from two hashes of its name). The
shards take turns; at its turn a shard claims its first slot that is still free. The table (at most ``MAX_SLOTS``
rows, whatever the data) is broadcast, and a row finds its shard by hash(key) mod size, without a shuffle.

Edge cases: null keys go together to one slot; equal keys share a shard; a weight of 0 claims no
slot; an empty table gives an empty result; an input column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SLOTS = 655_373


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}\x00{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = 65_537, weights: dict[str, int] | None = None) -> list[int]:
    """The index of the shard that holds each slot. ``weights``: turns that a shard takes in each round, 1 if absent."""
    if not is_prime(size) or size > MAX_SLOTS:
        raise ValueError(f"the table size must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    turns = [max(0, (weights or {}).get(s, 1)) for s in shards]
    if not any(turns):
        raise ValueError("every weight is 0")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            for _ in range(turns[k]):
                if not free:
                    break
                while slots[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % size
                slots[at[k]] = k
                free -= 1
    return slots


def slot_of(keys: list[str], size: int) -> Column:
    """The slot of a row: 60 bits of the MD5 of its keys' texts (null apart from all texts), modulo the table's size."""
    named = F.concat_ws("|", *[F.when(F.col(k).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(k).cast("string"))) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long"), F.lit(size))


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], size: int = 65_537, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string)."""
    spark = df.sparkSession
    slots = fill_table(shards, size, weights)
    lookup = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(slots)], "slot long, shard string")
    placed = df.withColumn("__slot", slot_of(keys, size)).drop("slot", "shard").withColumnRenamed("__slot", "slot")
    return placed.join(F.broadcast(lookup), "slot", "left").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def oracle(shards: list[str], size: int = 65_537) -> str:
    """Placement of documents in SQL; the table, which the tests fill by brute force, is given in it."""
    return f"""
WITH t AS (SELECT unnest(range({size})) AS slot, unnest({fill_table(shards, size)}) AS k), s AS (SELECT unnest(range({len(shards)})) AS k, unnest({shards}) AS shard),
d AS (SELECT doc_id, ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN '-' ELSE '=' || doc_id END), 1, 15))::BIGINT % {size} AS slot FROM documents)
SELECT doc_id, slot, shard FROM d JOIN t USING (slot) JOIN s USING (k)
"""
