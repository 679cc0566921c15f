"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by a permutation of its own (offset and step from hashes of its
name; any step below a prime visits all slots).  Shards take turns and claim the first slot in their order that is
free, until none is: a weight of w claims w slots a turn.  So slots are spread evenly, and when a shard leaves, few
slots of the others change hands.  The table has ``size`` rows, whatever the documents: it is broadcast, and a
document's shard is one lookup of its key's hash.

Nulls: a null key is hashed as the empty string.  Equal keys share a shard.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, a hundred times the shards or more, so that loads differ by about one percent.
SIZE = 65537


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:7], "big")


def lookup_table(shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> np.ndarray:
    """The shard (its place in ``shards``) of each slot."""
    if not shards or len(set(shards)) < len(shards) or sum(weights or [1] * len(shards)) > size:
        raise ValueError("shards must be different, one at least, and their weights at most the slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be prime")
    offset = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    place, owner, left = list(offset), [-1] * size, size
    turns = [i for i, w in enumerate(weights or [1] * len(shards)) for _ in range(w)]
    while left:
        for i in turns:
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return np.array(owner, np.int32)


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5, so that any engine can find it again."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: list[str], *, key: str = "doc_id", size: int = SIZE,
          weights: list[int] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row, its slot (long) and its shard's name."""
    spark: SparkSession = docs.sparkSession
    owners = lookup_table(shards, size, weights)
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owners.tolist())], "slot long, shard string")
    placed = docs.select(*keep, slot_of(F.col(key), size).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*keep, "slot", "shard")  # size rows: a fixed bound
