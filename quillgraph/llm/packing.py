"""Filling containers of several permitted capacities with items, leaving as little unused space as possible.

Items are spread over shards of bounded size by a hash; each shard is packed best-fit in decreasing order. When an
item fits nowhere, the capacity is opened whose best completion from the items still to come wastes the smallest
share, the smaller one on a tie; at the end every container shrinks to the least capacity holding its contents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.runtime import ship

#: Items of a shard, on average; a shard leaves at most one badly filled container.
SHARD_ITEMS = 50_000


def _waste(room: int, have: int, count: list[int]) -> int:
    """What stays unused of ``room`` if the largest fitting items still to come are put in, one length after the other."""
    while room > 0:
        n = (have & ((1 << (room + 1)) - 1)).bit_length() - 1
        if n < 1:
            break
        room -= n * min(count[n], room // n)
        have &= (1 << n) - 1
    return room


def pack(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int]]:
    """``(container of each item, capacity of each container)``; every size must be 1 to the largest capacity."""
    caps = sorted(set(capacities))
    top = caps[-1]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    count, have = [0] * (top + 1), 0
    for s in sizes:
        count[s] += 1
        have |= 1 << s
    room_of: list[list[int]] = [[] for _ in range(top + 1)]  # containers by the room they have left
    rooms = 0
    where, capacity, used = [0] * len(sizes), [], []
    for i in order:
        s = sizes[i]
        count[s] -= 1
        if not count[s]:
            have &= ~(1 << s)
        if fit := rooms >> s:
            room = s + (fit & -fit).bit_length() - 1
            box = room_of[room].pop()
            if not room_of[room]:
                rooms &= ~(1 << room)
        else:
            best = min((c for c in caps if c >= s), key=lambda c: (_waste(c - s, have, count) / c, c))
            box, room = len(capacity), best
            capacity.append(best)
            used.append(0)
        where[i] = box
        used[box] += s
        if room > s:
            room_of[room - s].append(box)
            rooms |= 1 << (room - s)
    for box, n in enumerate(used):
        capacity[box] = next(c for c in caps if c >= n)
    return where, capacity


def pack_items(items: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """``key, part, first, n, container, capacity``: which container holds which stretch of each item.

    Only an item above the largest capacity is split, into full stretches of it and a rest. Items of size null, zero
    or below take no space: one row with a null container. Rows repeating a key are packed as often as they stand.
    Container ids are unique and depend on the data alone. An empty table gives an empty result.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("at least one capacity of 1 or more is needed")
    ship(items.sparkSession)
    top = max(capacities)
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    n = F.coalesce(F.col(size), F.lit(0))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / top) - 1))
    each = items.select(F.col(key).alias("key"), n.alias("size"), F.explode(parts).alias("part"))
    each = each.select("key", F.col("part").cast("int").alias("part"), (F.col("part").cast("bigint") * top).alias("first"), F.least(F.lit(top), F.col("size") - F.col("part").cast("bigint") * top).cast("int").alias("n"))
    each = each.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int"))

    def run(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "part"], kind="stable")
        where, capacity = pack(g["n"].tolist(), capacities)
        return g.assign(container=[int(keys[0]) * (1 << 32) + w for w in where], capacity=[capacity[w] for w in where]).drop(columns="shard")

    kind = items.schema[key].dataType.simpleString()
    packed = each.where("n > 0").groupBy("shard").applyInPandas(run, f"key {kind}, part int, first bigint, n int, container bigint, capacity int")
    empty = each.where("n <= 0").select("key", "part", "first", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("capacity"))
    return packed.unionByName(empty).withColumnRenamed("key", key)
