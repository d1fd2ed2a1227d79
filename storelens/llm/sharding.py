"""Sharding: contiguous shards whose largest size is as small as it can be.

Equal texts form an atomic group. Groups stand in the order of their smallest doc_id (then digest); a shard
is a run of groups. The smallest feasible capacity comes from a binary search over capacities, each checked
by greedy filling, and the cuts are made within that capacity.

The driver never sees the groups: it holds at most `grid` group ends at a time. Each round looks at the ends
through a grid, finds the capacity if groups inside a grid cell could be split anywhere (a lower bound) and
if a cell could not be split at all (an upper bound), and looks closer at only those cells in which a cut can
fall, until both bounds are equal. So the result is exact.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import keep, ranged

GRID = 1 << 15


class Ends:
    """Known group ends in ascending order; gap i lies between ends i and i+1 and is open if unseen ends are inside."""

    def __init__(self, ends: list[int], is_open: list[bool]):
        self.at = np.array([0, *ends], dtype=np.int64)
        self.open = np.array([*is_open, False])  # open[i]: the gap after at[i]

    def reach(self, start: int, room: int, loose: bool) -> int:
        """The last place at which a shard that starts at start may end; loose: anywhere in an open gap."""
        i = int(np.searchsorted(self.at, start + room, side="right")) - 1
        return start + room if loose and self.open[i] else int(self.at[i])

    def fill(self, room: int, shards: int, loose: bool) -> list[int]:
        """Ends of greedily filled shards, at most `shards` of them."""
        out, at, total = [], 0, int(self.at[-1])
        for _ in range(shards):
            at = min(total, max(at, self.reach(at, room, loose)))
            out.append(at)
        return out

    def capacity(self, shards: int, loose: bool) -> int:
        total = int(self.at[-1])
        return bisect.bisect_left(range(total), True, key=lambda c: self.fill(c, shards, loose)[-1] >= total)

    def cuts(self, room: int, shards: int) -> list[int]:
        """Ends of shards within the capacity, each as near as it can be to an even share of what is left."""
        late, at = [int(self.at[-1])], int(self.at[-1])  # from where on the rest still fits
        for _ in range(shards - 1):
            at = int(self.at[np.searchsorted(self.at, max(0, at - room))])
            late.append(at)
        out, at, total = [], 0, int(self.at[-1])
        for k in range(shards - 1, 0, -1):
            lo, hi = max(at, late[k]), max(at, self.reach(at, room, False))
            want = at + (total - at) / (k + 1)
            i = int(np.searchsorted(self.at, want))
            near = min(self.at[max(0, i - 1) : i + 1], key=lambda x: (abs(x - want), x), default=at)
            at = int(min(max(int(near), lo), hi))
            out.append(at)
        return [*out, total]


def minimax_cuts(groups: DataFrame, shards: int, grid: int = GRID) -> list[int]:
    """Ends of the shards over groups (columns: end, the running total of sizes in group order).

    No groups: an empty list. Fewer groups than shards: the last shards are empty.
    """
    total = groups.agg(F.max("end")).first()[0]
    if total is None:
        return []
    width, level = max(1, -(-total // grid)), groups.select("end")
    cells: dict[int, tuple[int, int, int]] = {}  # by a cell's first end: first end, last end, number of ends
    while True:
        here = level.withColumn("cell", F.floor((F.col("end") - 1) / F.lit(width)).cast("long"))
        seen = here.groupBy("cell").agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n")).collect()
        cells |= {r.lo: (r.lo, r.hi, r.n) for r in seen}
        ends, is_open = [], [False]
        for lo, hi, n in sorted(cells.values()):
            ends += [lo] if lo == hi else [lo, hi]
            is_open += [False] if lo == hi else [n > 2, False]
        known = Ends(ends, is_open[:-1])
        low, high = known.capacity(shards, True), known.capacity(shards, False)
        reach = list(zip(known.fill(low, shards, False), known.fill(high, shards, True)))
        wanted = [(r.cell, r.lo) for r in seen if r.n > 2 and any(a < r.hi and r.lo <= b for a, b in reach)]
        if low >= high or not wanted or width == 1:
            return known.cuts(high, shards)
        for _, lo in wanted:
            del cells[lo]
        near = F.broadcast(groups.sparkSession.createDataFrame([(c,) for c, _ in wanted], "cell long"))  # at most `grid` rows
        level = here.join(near, "cell", "left_semi").select("end")
        width = max(1, min(width // 2, -(-len(wanted) * width // grid)))


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), group_first.

    A null text has no bytes and is grouped with the empty text. Repeated rows keep one row each. Null ids
    come first. An empty table gives no rows. Other columns of docs are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = keep(rows, "rows")
    groups = ranged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes")), "first", "digest")
    sums = groups.groupBy("pid").agg(F.sum("bytes").alias("b")).orderBy("pid").collect()  # one row for each part
    before = list(zip([r.pid for r in sums], accumulate([0, *(r.b for r in sums)])))
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before, "pid int, before long"))
    running = F.sum("bytes").over(W.partitionBy("pid").orderBy("idx"))
    groups = keep(groups.withColumn("run", running).join(offsets, "pid").select("digest", "first", (F.col("before") + F.col("run")).alias("end")), "groups")
    cuts = minimax_cuts(groups, shards)
    ends = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    placed = groups.select("digest", "first", F.size(F.filter(ends, lambda c: c < F.col("end"))).alias("shard"))
    rows = ranged(rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", "first"), "shard", "first", "doc_id")
    held = rows.groupBy("shard", "pid").agg(F.min("idx").alias("low"), F.count("*").alias("n")).orderBy("shard", "pid").collect()
    shift, count = [], {}
    for r in held:  # at most a row for each part and for each shard
        shift.append((r.shard, r.pid, count.get(r.shard, 0) - r.low))
        count[r.shard] = count.get(r.shard, 0) + r.n
    moved = F.broadcast(spark.createDataFrame(shift, "shard int, pid int, shift long"))
    return rows.join(moved, ["shard", "pid"]).select(
        "doc_id", F.col("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("idx") + F.col("shift")).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), F.col("first").alias("group_first"),
    )
