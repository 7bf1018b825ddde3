"""Sharding by the minimax contiguous partition of ordered atomic groups.

All rows with the same text form one atomic group. Groups are ordered by a 60-bit hash of the text, and the
smallest shard capacity for which a greedy left-to-right cut needs at most ``shards`` shards is found by binary
search. The driver never sees the groups: it holds a histogram of hash ranges (4096 at first), brackets the capacity
between an optimistic and a pessimistic greedy pass, and asks Spark to split only the ranges in which a cut can
still fall, until both passes agree. Each round returns at most a few thousand sums, whatever the table's size.

Only DataFrame functions run on the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stash, utf8_text

KEY_BITS = 60
STEP_BITS = 12


class _Ranges:
    """Sums over consecutive key ranges; ``single`` marks ranges that hold one atomic group."""

    def __init__(self, rows, bits):
        self.rows = sorted((p << (KEY_BITS - bits), (p + 1) << (KEY_BITS - bits), s, n == 1, bits) for p, s, n in rows)
        self._index()

    def _index(self):
        self.cum = np.concatenate([[0], np.cumsum([r[2] for r in self.rows], dtype=np.int64)])
        self.single = np.array([r[3] for r in self.rows], dtype=bool)
        self.total = int(self.cum[-1])

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Ends of the shards as running sums, or None. A hopeful pass may cut inside a range that is not split yet."""
        at, ends = 0, []
        for _ in range(shards):
            to = at + capacity
            if to >= self.total:
                return [*ends, self.total]
            j = int(np.searchsorted(self.cum, to, side="right")) - 1
            at = to if hopeful and not self.single[j] else int(self.cum[j])
            ends.append(at)
        return None

    def smallest(self, shards: int, hopeful: bool) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, hopeful) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def undecided(self, low: int, high: int, shards: int) -> list[int]:
        """Ranges in which a cut can fall for some capacity from low to high."""
        early = late = 0
        found: set[int] = set()
        for _ in range(shards - 1):
            a, b = early + low, min(late + high, self.total)
            if a >= self.total:
                break
            i = int(np.searchsorted(self.cum, a, side="right")) - 1
            j = min(int(np.searchsorted(self.cum, b, side="right")) - 1, len(self.rows) - 1)
            found.update(k for k in range(i, j + 1) if not self.single[k])
            early = int(self.cum[i])
            late = b
        return sorted(found)

    def split(self, which: list[int], rows, bits: int) -> None:
        gone = set(which)
        kept = [r for k, r in enumerate(self.rows) if k not in gone]
        self.rows = sorted(kept + [(p << (KEY_BITS - bits), (p + 1) << (KEY_BITS - bits), s, n == 1, bits) for p, s, n in rows])
        self._index()


def minimax_cuts(atoms: DataFrame, shards: int) -> tuple[int, list[int]]:
    """``atoms``: key (below 2^60), size. Returns the smallest capacity and the first key of shards 1, 2, ..."""

    def sums(bits, inside=None):
        df = atoms
        if inside:
            df = df.filter(F.shiftright("key", KEY_BITS - bits + STEP_BITS).isin(inside))
        got = df.groupBy(F.shiftright("key", KEY_BITS - bits).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        return [(r.p, r.s, r.n) for r in got.collect()]

    bits = STEP_BITS
    ranges = _Ranges(sums(bits), bits)
    while True:
        low, high = ranges.smallest(shards, True), ranges.smallest(shards, False)
        which = ranges.undecided(low, high, shards) if low < high else []
        # ranges of this depth only: coarser ones were split in an earlier round or cannot hold a cut any more
        which = [k for k in which if ranges.rows[k][4] == bits]
        if not which or bits == KEY_BITS:
            break
        inside = [ranges.rows[k][0] >> (KEY_BITS - bits) for k in which]
        bits += STEP_BITS
        ranges.split(which, sums(bits, inside), bits)
    ends = ranges.greedy(high, shards, False) or []
    starts = []
    for end in ends[:-1]:
        j = int(np.searchsorted(ranges.cum, end, side="right")) - 1
        starts.append(int(ranges.rows[j][0]))
    return high, starts


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text", cells: int = 1024) -> DataFrame:
    """Give every row a shard and a gapless slot in it; rows of equal text share a shard, and the largest shard is
    as small as an order-preserving cut allows.

    Null texts count as empty (size 1) and share the group of empty texts; repeated rows and null ids keep a slot of
    their own; an empty table gives no rows. Slots are numbered within ``shards * cells`` cells chosen by the id's
    hash, so no task numbers a whole shard. Returns the id, size, text_crc32, shard, slot.
    """
    text = utf8_text(text_column)
    rows = stash(
        docs.select(
            F.col(id_column),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        ),
        "shard-rows",
    )
    atoms = stash(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-atoms")
    _, starts = minimax_cuts(atoms, shards)
    number = F.lit(0)
    for first in starts:
        number = number + (F.col("key") >= F.lit(first)).cast("int")
    placed = rows.withColumn("shard", number.cast("int")).withColumn("cell", F.pmod(F.xxhash64(id_column, "text_crc32"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy(F.col(id_column), "text_crc32", "size")
    return placed.join(F.broadcast(offsets), ["shard", "cell"]).select(  # at most shards * cells rows
        id_column, "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot")
    )
