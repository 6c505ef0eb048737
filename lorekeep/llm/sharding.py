"""Placement by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size: it starts at a slot
and steps on by a stride, both drawn from its name's MD5.  The shards take turns; at its turn a shard
claims the next slot of its order that is free, until none is.  A key's MD5 picks its slot, so a
row is placed by one look-up, shares differ by one slot at most, and a change of shards moves few keys.

The table has ``slots`` rows by its parameters, whatever the data; it is made by a loop over these
parameters and broadcast as a small DataFrame.

Cases: a null key is placed as the empty text; repeated keys go to one shard; an empty table gives no
rows; extra columns stay as they are, and a column that has a result's name is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 that a slot is drawn from.
DIGITS = 12


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Start and stride of a shard's order."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:DIGITS], 16) % slots, int(digest[-DIGITS:], 16) % (slots - 1) + 1


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Number of the shard that holds each slot.  slots must be a prime, larger than the number of shards."""
    if next_prime(slots) != slots or slots <= len(shards) or not shards:
        raise ValueError("the table's size must be a prime above the number of shards")
    table = [-1] * slots
    at = [preference(s, slots) for s in shards]
    place = [start for start, _ in at]
    free = slots
    while free:
        for i, (_, stride) in enumerate(at):
            while table[place[i]] >= 0:
                place[i] = (place[i] + stride) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard): one row for each slot, from a literal array."""
    text = ",".join(map(str, fill_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int | None = None) -> DataFrame:
    """rows with their slot (long) and shard (int); slots: the least prime from 100 a shard on."""
    slots = slots or next_prime(100 * len(shards))
    table = table_frame(rows.sparkSession, shards, slots)
    placed = rows.select(*[F.col(c) for c in rows.columns if c not in ("slot", "shard")], slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(table), "slot")  # slots rows
