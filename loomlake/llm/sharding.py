"""Minimax contiguous sharding of documents, equal texts kept together.

The ordered atomic groups are `buckets` (65,536) remainders of a hash of the text, so equal texts
always share a group and the list of groups has the same length at every input size. A binary
search over the capacity, each candidate checked by filling shards greedily, finds the smallest
capacity with which the shards hold all groups in order; no shard exceeds it, so no contiguous
split of these groups has a smaller largest shard. Only the 65,536 group sizes reach the driver.
A group that outweighs a fair share of what the others leave gets a shard alone where that keeps
the bound, the shards that remain are dealt to the stretches between such groups by their bytes, and
within a stretch each next shard ends at the smallest capacity for the shards and groups left. No
shard is empty unless there are fewer groups than shards.

Defined cases: of equally small cuts the earliest is taken; a very long text is in one shard; null text counts as empty, has 16 bytes of size and shares the group of empty
texts; repeated rows each get a slot; rows without an id are sharded like others; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_of

OVERHEAD = 16


def fill(ends: np.ndarray, lo: int, hi: int, capacity: int, shards: int) -> int:
    """Shards that greedy filling of groups lo .. hi needs (shards + 1: more)."""
    n = 0
    while lo < hi and n <= shards:
        lo = int(np.searchsorted(ends, ends[lo] + capacity, side="right")) - 1
        n += 1
    return n


def smallest(ends: np.ndarray, lo: int, hi: int, shards: int) -> int:
    """Smallest capacity with which `shards` shards hold groups lo .. hi in order."""
    total = int(ends[hi] - ends[lo])
    low, high = max(int(np.diff(ends[lo : hi + 1]).max()), -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if fill(ends, lo, hi, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def apart(ends: np.ndarray, lo: int, hi: int, shards: int, bound: int) -> list[tuple[int, int, int]]:
    """(lo, hi, shards) of groups above a fair share, each alone, and of the stretches between them; empty without any or beyond `bound`."""
    sizes, total, left = np.diff(ends[lo : hi + 1]), int(ends[hi] - ends[lo]), shards
    heavy = []
    for k in np.argsort(-sizes, kind="stable"):
        if not left or int(sizes[k]) * left <= total:
            break
        heavy.append(lo + int(k))
        total, left = total - int(sizes[k]), left - 1
    heavy.sort()
    if not heavy:
        return []
    between = [(a, b) for a, b in zip([lo, *(k + 1 for k in heavy)], [*heavy, hi], strict=True) if a < b]
    if len(between) > left:
        return []
    share = [1] * len(between)
    for _ in range(left - len(between)):
        can = [(int(ends[b] - ends[a]) / share[k], -k) for k, (a, b) in enumerate(between) if share[k] < b - a]
        if not can:
            break
        share[-max(can)[1]] += 1
    if any(smallest(ends, a, b, n) > bound for (a, b), n in zip(between, share, strict=True)):
        return []
    return sorted([(k, k + 1, 1) for k in heavy] + [(a, b, n) for (a, b), n in zip(between, share, strict=True)])


def cuts_for(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """Smallest feasible capacity and the shard of each group, for ordered group sizes."""
    sizes = np.asarray(sizes, dtype=np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return 0, np.zeros(len(sizes), dtype=np.int64)
    ends = np.append(0, np.cumsum(sizes[some]))
    bound = smallest(ends, 0, len(some), shards)
    starts, todo = [], [(0, len(some), shards)]
    while todo:
        lo, hi, n = todo.pop()
        if n == 1 or hi - lo == 1:
            starts.append(lo)
        elif parts := apart(ends, lo, hi, n, bound):
            todo += reversed(parts)
        else:  # every shard that remains gets a group
            cut = int(np.searchsorted(ends, ends[lo] + smallest(ends, lo, hi, n), side="right")) - 1
            cut = min(cut, max(lo + 1, hi - n + 1))
            starts.append(lo)
            todo.append((cut, hi, n - 1))
    # Groups without rows go with the one before them.
    shard = np.searchsorted(some[starts], np.arange(len(sizes)), side="right") - 1
    return bound, np.maximum(shard, 0)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int").alias("bucket"),
    )
    sizes = np.zeros(buckets, dtype=np.int64)
    # At most `buckets` rows, whatever the input.
    for bucket, size in rows.groupBy("bucket").agg(F.sum("size").alias("size")).collect():
        sizes[bucket] = size
    _, of_bucket = cuts_for(sizes, shards)
    table = spark.createDataFrame([(int(b), int(of_bucket[b])) for b in np.flatnonzero(sizes)], "bucket int, shard int")
    placed = rows.join(F.broadcast(table), "bucket").drop("bucket")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
