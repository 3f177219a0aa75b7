"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table.

Every shard has its own order of preference over the slots, from two hashes of its name: a start and a step. In turn, each
claims the first slot of its order that is free, a shard of weight w w times a turn, until all slots are taken. A key's hash
names a slot; the table, bounded by its size, is shared with every task, so placing a row costs no shuffle. Taking a shard
away moves its own keys and few others.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537             # a prime; the table's rows, and so the bound of what is shared
LARGEST = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def fill(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. `shards` gives each shard's weight, 1 or more; turns follow the names."""
    if not is_prime(slots) or slots > LARGEST:
        raise ValueError(f"the number of slots must be a prime up to {LARGEST}")
    if not shards or len(shards) > slots or min(shards.values()) < 1:
        raise ValueError("shards must be at least one, no more than the slots, and of weight 1 or more")
    names = sorted(shards)
    half = lambda name, salt: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt).digest(), "big")
    at = {s: half(s, b"start") % slots for s in names}
    step = {s: half(s, b"step") % (slots - 1) + 1 for s in names}
    table: list[str | None] = [None] * slots
    left = slots
    while left:
        for s in names:
            for _ in range(min(shards[s], left)):
                while table[at[s]] is not None:
                    at[s] = (at[s] + step[s]) % slots
                table[at[s]] = s
                left -= 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(fill(shards, slots))], "slot int, shard string")


def slot_of(*keys: Column | str, slots: int = SLOTS) -> Column:
    """A key's slot. Null keys share the slot of a null; add a second key where they are many."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def placed(df: DataFrame, keys: list[str], shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`; columns of these names are replaced. Every row is placed, equal keys alike, nothing is shuffled.

    Repeated rows stay as many as they are, null keys go together, an empty table gives an empty one.
    """
    table = lookup_table(df.sparkSession, shards, slots)                     # at most LARGEST short rows
    return df.drop("slot", "shard").withColumn("slot", slot_of(*keys, slots=slots)).join(F.broadcast(table), "slot").select(
        *[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, keys: list[str], shards: dict[str, int], path: str, slots: int = SLOTS) -> DataFrame:
    """Write whole rows with their slots, one folder per shard, and return what the files hold. A REBALANCE hint lets Spark deal a large shard to several tasks.

    A shard that no row fell to has no folder; an empty table leaves none and reads as empty.
    """
    done = placed(df, keys, shards, slots)
    done.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(done.schema).parquet(path).select(done.columns)
