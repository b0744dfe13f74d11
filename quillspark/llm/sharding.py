"""Minimax contiguous sharding of atomic groups (equal texts).

Groups stand in the order of their smallest id.  The smallest capacity for
which a greedy cut needs no more than the wanted shards is found by binary
search, and the cuts are made there.  The driver never holds all groups: it
sees prefix sums at a bounded number of positions, bounds every cut from both
sides, and asks for finer positions only where a cut may still fall.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salt_count, salt_of, saved


class Prefix:
    """Known group ends: ranks from 1 and the sum of sizes up to there, in order."""

    def __init__(self, total_rank: int, total: int):
        self.known = {0: 0, total_rank: total}
        self.total_rank, self.total = total_rank, total
        self._sort()

    def _sort(self) -> None:
        self.ranks = sorted(self.known)
        self.ends = [self.known[r] for r in self.ranks]

    def add(self, rows: list[tuple[int, int]]) -> None:
        self.known.update(rows)
        self._sort()

    def cuts(self, capacity: int, shards: int, optimistic: bool) -> list[tuple[int, int, bool]]:
        """Greedy cuts as (index of the last known end within reach, position, whether it is exact).

        Optimistic: a cut takes its whole capacity where an unknown group may end there.
        """
        out, at = [], 0
        for _ in range(shards):
            i = bisect_right(self.ends, at + capacity) - 1
            exact = i == len(self.ranks) - 1 or self.ranks[i + 1] == self.ranks[i] + 1 or self.ends[i] == at + capacity
            at = at + capacity if optimistic and not exact else self.ends[i]
            out.append((i, at, exact))
            if at >= self.total:
                break
        return out

    def fits(self, capacity: int, shards: int, optimistic: bool) -> bool:
        return self.cuts(capacity, shards, optimistic)[-1][1] >= self.total


def smallest(low: int, high: int, holds) -> int:
    """Smallest number in (low, high] for which ``holds``; it must hold for ``high``."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def minimax_cuts(n_groups: int, total: int, largest: int, shards: int, fetch, cells: int = 1 << 16) -> tuple[int, list[int]]:
    """Smallest capacity and the ranks of the last group of each shard.

    ``fetch(windows, width)`` returns (rank, prefix sum) of the first rank of
    each window and of every ``width``-th one after it; at most about ``cells``
    are asked for at once.
    """
    p = Prefix(n_groups, total)
    windows, widest = [(1, n_groups)], n_groups
    floor_ = max(largest, -(-total // shards)) - 1
    while True:
        asked = sum(b - a + 1 for a, b in windows)
        if asked:
            # no wider than the widest open gap, so that each call brings something new
            p.add(fetch(windows, max(1, min(-(-asked // cells), widest))))
        sure = smallest(floor_, max(total, floor_ + 1), lambda c: p.fits(c, shards, False))
        maybe = smallest(floor_, sure, lambda c: p.fits(c, shards, True))
        lower, upper = p.cuts(maybe, shards, False), p.cuts(sure, shards, True)
        if maybe == sure and all(exact for *_, exact in lower):
            return sure, [p.ranks[i] for i, *_ in lower]
        windows, widest, done = [], 1, 0
        for k, (i, at, _) in enumerate(upper):
            # a cut lies no earlier than the pessimistic one of the least capacity, no later than this one
            first = max(lower[k][0] if k < len(lower) else i, done)
            last = min(bisect_right(p.ends, at), len(p.ranks) - 1)
            gaps = [(p.ranks[t] + 1, p.ranks[t + 1] - 1) for t in range(first, last) if p.ranks[t + 1] - p.ranks[t] > 1]
            if gaps:
                windows.append((gaps[0][0], gaps[-1][1]))
                widest = max([widest, *(b - a + 1 for a, b in gaps)])
                done = last
        if not windows:
            raise AssertionError("cuts stay open without an unknown group")


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Put every row into one of ``n_shards`` contiguous shards of nearly equal bytes.

    Returns ``id, size, text_crc32, shard, slot, capacity``: size is the
    text's UTF-8 bytes plus ``overhead`` (which must be positive), slot counts
    from 0 without gaps in each shard, capacity is the largest shard allowed.
    Equal texts are one atomic group and stay together; null texts are a group
    of their own (no CRC), apart from empty ones.  A group larger than the mean
    shard sets the capacity.  Repeated rows are members like any other; rows
    with a null id come first.  With fewer groups than shards the last shards
    stay empty; an empty table gives an empty result.

    A hot group's rows are numbered in salted cells, so no task holds it whole.
    """
    if n_shards < 1 or overhead < 1:
        raise ValueError("n_shards and overhead must be positive")
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit("null").cast("binary")).alias("key"),
    )
    base = saved(base)
    salts = salt_count(base.count())
    base = base.withColumn("salt", salt_of(F.col("id"), salts))
    cells = saved(base.groupBy("key", "salt").agg(F.min("id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n")))
    groups = cells.groupBy("key").agg(F.min("first").alias("first"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    ranged = saved(groups.repartitionByRange("first", "key").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count("*").alias("groups"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("largest")).orderBy("part").collect()
    before, g, b, n = [], 0, 0, 0
    for p in parts:  # one row a partition
        before.append((p["part"], g, b, n))
        g, b, n = g + p["groups"], b + p["bytes"], n + p["n"]
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before, "part int, g long, b long, r long"))
    run = Window.partitionBy("part").orderBy(F.asc_nulls_first("first"), "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, "part").select(
        "key", "n", (F.col("g") + F.count("*").over(run)).alias("rank"), (F.col("b") + F.sum("bytes").over(run)).alias("end"), (F.col("r") + F.sum("n").over(run) - F.col("n")).alias("rows_before")
    )
    placed = saved(placed)

    def fetch(windows: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
        some = F.lit(False)
        for lo, hi in windows:
            some = some | (F.col("rank").between(lo, hi) & ((F.col("rank") - lo) % width == 0))
        return [(r["rank"], r["end"]) for r in placed.where(some).select("rank", "end").collect()]

    capacity, last = minimax_cuts(g, b, max(p["largest"] for p in parts), n_shards, fetch) if parts else (0, [])
    cut = F.array(*[F.lit(r).cast("long") for r in last[:-1]]) if len(last) > 1 else F.array().cast("array<long>")
    placed = placed.withColumn("shard", F.size(F.filter(cut, lambda r: r < F.col("rank"))))
    heads = F.broadcast(placed.groupBy("shard").agg(F.min("rows_before").alias("head")))  # n_shards rows at most
    placed = placed.join(heads, "shard").select("key", "shard", (F.col("rows_before") - F.col("head")).alias("row"))
    inside = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    where = cells.select("key", "salt", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("skip")).join(placed, "key")
    where = saved(where.select("key", "salt", "shard", (F.col("row") + F.col("skip")).alias("row")))
    within = Window.partitionBy("key", "salt").orderBy(F.asc_nulls_first("id"), "size")
    rows = base.withColumn("nth", F.row_number().over(within)).join(where, ["key", "salt"])
    return rows.select("id", "size", "text_crc32", "shard", (F.col("row") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(capacity).cast("long").alias("capacity"))
