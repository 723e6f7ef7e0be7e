"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a permutation of the slots of a prime-sized table, from two hashes of its name.  Shards
take turns, each claiming its most preferred free slot, until the table is full; so slots are shared out
within one of each other, and a shard that leaves frees its own slots and moves few others.  The table
has a fixed number of rows whatever the data, is broadcast, and placing a row is one hash and one lookup.

Defined results: a null key is placed as the empty string; equal keys are placed alike; the order in which
shards are named does not matter; no shards is an error; an empty table gives an empty result; columns
`slot` and `shard` of the input are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime much larger than the number of shards.
SLOTS = 65_537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup(shards: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    names = sorted(set(shards))
    if not names:
        raise ValueError("sharding needs at least one shard")
    if len(names) > slots or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, and no fewer than the shards")
    start = [_hash(n, "offset") % slots for n in names]
    step = [_hash(n, "skip") % (slots - 1) + 1 for n in names]
    tried, table, left = [0] * len(names), [-1] * slots, slots
    while left:
        for k in range(len(names)):
            slot = (start[k] + tried[k] * step[k]) % slots
            while table[slot] >= 0:
                tried[k] += 1
                slot = (start[k] + tried[k] * step[k]) % slots
            table[slot] = k
            tried[k] += 1
            left -= 1
            if not left:
                break
    return [names[k] for k in table]


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) rows, `slots` of them."""
    names = sorted(set(shards))
    codes = {n: str(k) for k, n in enumerate(names)}
    filled = F.split(F.lit(",".join(codes[n] for n in lookup(names, slots))), ",")
    listed = F.array(*[F.lit(n) for n in names])
    rows = spark.range(1).select(F.posexplode(filled).alias("slot", "code"))
    return rows.select("slot", F.get(listed, F.col("code").cast("int")).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(head, 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`df` with `slot` and `shard`."""
    kept = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return kept.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 8, slots: int = SLOTS) -> None:
    """Parquet folders by shard; a shard's rows are dealt over `files_per_shard` tasks by their hash."""
    placed = place(df, key, shards, slots)
    deal = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition(len(set(shards)) * files_per_shard, "shard", deal).write.partitionBy("shard").parquet(path)
