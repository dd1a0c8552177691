"""Best-fit-decreasing sharding of indivisible groups into shards of a fixed capacity.

Groups by falling size each enter the shard with the least remaining capacity that fits, found in a balanced tree over
capacities. Groups of equal size and shards of equal remaining capacity are alike, so both are handled in runs: the plan
is exactly that of one group at a time, and its length follows the number of different sizes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import plans
from .shared import checkpointed, ranked

#: Bytes of a shard, and of a unit in which sizes are rounded up: exact sizes by default. The plan's length follows the different sizes that occur.
CAPACITY = 16 << 20
UNIT = 1


class CapacityTree:
    """A perfectly balanced tree over capacities 0..most: which have shards, and the least of them from a given one on."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def mark(self, capacity: int, there: bool) -> None:
        k = capacity + self.size
        self.any[k] = there
        while k > 1:
            k //= 2
            there = bool(self.any[2 * k] or self.any[2 * k + 1])
            if self.any[k] == there:
                break
            self.any[k] = there

    def least_from(self, capacity: int) -> int | None:
        k = capacity + self.size
        if self.any[k]:
            return capacity
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def plan(counts: dict[int, int] | tuple[np.ndarray, np.ndarray], capacity: int) -> plans.Plan:
    """Best-fit-decreasing over sizes in units, given as a dict or as arrays of sizes and counts. A group beyond the capacity gets a shard of its own; one of size 0 takes no room."""
    out, tree, shards, next_shard = plans.Plan(), CapacityTree(capacity), {}, 0

    def put(remaining: int, first: int, n: int) -> None:
        shards.setdefault(remaining, []).append((first, n))
        tree.mark(remaining, True)

    sizes, many = counts if isinstance(counts, tuple) else (np.array(list(x), np.int64) for x in (counts.keys(), counts.values()))
    for k in np.argsort(sizes)[::-1]:
        size, left, rank = int(sizes[k]), int(many[k]), 0
        if size > capacity:
            out.add(size, 0, next_shard, 1, [])
            next_shard += left
            continue
        while left:
            remaining = tree.least_from(size)
            if remaining is None:
                per = capacity // size if size else left
                n = max(1, left // per)
                first, remaining = next_shard, capacity
                next_shard += n
            else:
                per = remaining // size if size else left
                first, have = shards[remaining].pop(0)
                n = max(1, min(have, left // per))
                if have > n:
                    shards[remaining].insert(0, (first + n, have - n))
                elif not shards[remaining]:
                    del shards[remaining]
                    tree.mark(remaining, False)
            some = min(per * n, left)  # fewer than per only in the last shard that this size reaches
            each = per if some == per * n else some
            out.add(size, rank, first, each, [])
            put(remaining - each * size, first, n)
            rank, left = rank + some, left - some
    return out


def shard(items: DataFrame, group_column: str, size_column: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """(group, size, shard_id) of each group of items; a group's size is the sum of its items'.

    Null sizes count as 0; items without a group are one group, null. A group larger than the capacity is alone in its
    shard. Groups of equal size are taken in the order of a hash of their key. An empty table gives an empty result.
    """
    groups = items.groupBy(F.col(group_column).alias("group")).agg(F.coalesce(F.sum(F.col(size_column).cast("long")), F.lit(0)).alias("size"))
    # all sizes beyond the capacity are one class: each such group has a shard of its own whatever its size
    groups = checkpointed(groups.withColumn("units", F.least(F.ceil(F.col("size") / unit), F.lit(capacity // unit + 1)).cast("long")))
    counts = plans.counts(groups, "units")
    made = plan(counts, capacity // unit)
    return plans.assigned(ranked(groups, "units", ["group"], salts=plans.salts(counts[1])), made, "units", "rank", "shard_id").select("group", "size", "shard_id")


def shard_documents(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, group_id, n_bytes, shard_id): documents in shards such that all copies of a text are in one.

    A group is the documents of equal text, named by its smallest id; null and empty texts are one group. A group of texts
    larger than the capacity is alone in its shard. Rows without an id take part under a null id. Each of repeated rows is kept.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    sized = docs.select(F.col(id_column).alias("doc_id"), F.md5(text).alias("copy"), F.octet_length(text).cast("long").alias("n_bytes"))
    sized = checkpointed(sized)
    groups = shard(sized, "copy", "n_bytes", capacity, unit).join(sized.groupBy(F.col("copy").alias("group")).agg(F.min("doc_id").alias("group_id")), "group")
    return sized.join(groups.select(F.col("group").alias("copy"), "group_id", "shard_id"), "copy").select("doc_id", "group_id", "n_bytes", "shard_id")
