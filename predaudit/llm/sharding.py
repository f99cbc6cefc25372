"""Shards of near-equal bytes by a minimax contiguous partition of atomic groups of equal texts.

Groups of equal texts are laid out in one order, and cutting that order into ``shards`` runs is a minimax problem: the
smallest capacity for which a greedy filling needs no more than ``shards`` runs, found by binary search. Among the cuts
with that capacity those nearest to an equal share of what is left are taken.

Order: groups that hold more than a small part of one shard come first, largest first, so that they do not tear the
shard they would fall into; all others follow by 60 bits of the digest of their text. Those bits spread evenly, which is
what lets Spark do the counting: the driver holds totals of at most ``2**BIN_BITS`` ranges of the order (a fixed number,
whatever the input), runs the search on them, and asks Spark for finer totals only of the ranges in which a cut falls,
until each of them is a single group. The capacity found is therefore exact over all groups.

Defined results: a null text has no bytes and is in one group with the empty text; rows are numbered within a shard in
hashed blocks, then by ``doc_id`` (nulls first); repeated rows are numbered like any other; texts whose digests share 60 bits share a
group; a very long text is one group like any other; an empty table gives no rows; with fewer groups than shards the rest stay empty; columns named
like the results are replaced, all others kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predaudit.functions.lineage import store
from predaudit.llm.names import aside

KEY_BITS = 60
BIN_BITS = 14
FINER_BITS = 8
HEAVY_PART = 16  # a group of more than this part of a shard is heavy: at most HEAVY_PART * shards of them
ROWS_IN_BLOCK = 20_000
INSIDE = ("_key", "_block", "_rows", "_in_shard", "_in_block", "_offset")


def with_sizes(docs: DataFrame) -> DataFrame:
    """Add ``size``, ``text_crc32`` and the group key ``_key``."""
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    key = F.conv(F.substring(F.md5(body), 1, KEY_BITS // 4), 16, 10).cast("long")
    return docs.withColumns(
        {"size": (F.octet_length(body) + 8).cast("long"), "text_crc32": F.crc32(body), "_key": key}
    )


@dataclass
class ShardPlan:
    """Where the order is cut: shard of each heavy key, and the first key of every later shard of the others."""

    shards: int
    capacity: int = 0
    rows: int = 0
    heavy: dict[int, int] = field(default_factory=dict)
    first: int = 0  # shard in which the keys that are not heavy begin
    cuts: list[tuple[int, int]] = field(default_factory=list)  # (first key, shard), ascending

    def shard(self, key: Column) -> Column:
        at = F.lit(self.first)
        for start, shard in self.cuts:
            at = F.when(key >= start, shard).otherwise(at)
        for shard in sorted(set(self.heavy.values())):
            at = F.when(key.isin([k for k, s in self.heavy.items() if s == shard]), shard).otherwise(at)
        return at.cast("int")


class _Order:
    """Totals of consecutive ranges of the order, refined where asked. A range is atomic if it is one group."""

    def __init__(self, units: DataFrame, shards: int):
        self.units = units
        shift = KEY_BITS - BIN_BITS
        bins = self._totals(units, shift)
        self.rows, self.total = sum(b[3] for b in bins), sum(b[2] for b in bins)
        least = self.total / (shards * HEAVY_PART)
        dense = [b[0] for b in bins if b[2] > least]
        found = (
            units.where(F.shiftright("_key", shift).isin(dense)).groupBy("_key").agg(F.sum("size").alias("bytes"))
            .where(F.col("bytes") > least).collect()
        ) if dense else []  # at most HEAVY_PART * shards rows
        self.heavy = sorted(((r["bytes"], r["_key"]) for r in found), key=lambda x: (-x[0], x[1]))
        if self.heavy:
            self.units = units.where(~F.col("_key").isin([k for _, k in self.heavy]))
            hit = sorted({k >> shift for _, k in self.heavy})
            again = self._totals(self.units.where(F.shiftright("_key", shift).isin(hit)), shift)
            bins = [b for b in bins if b[0] not in set(hit)] + again
        self.bins = sorted((b[1], shift, b[2], b[1] == b[4]) for b in bins)  # (first key, shift, bytes, atomic)
        self._prefix()

    @staticmethod
    def _totals(units: DataFrame, shift: int) -> list[tuple]:
        rows = (
            units.groupBy(F.shiftright("_key", shift).alias("bin"))
            .agg(F.min("_key"), F.sum("size"), F.count(F.lit(1)), F.max("_key")).collect()
        )
        return [tuple(r) for r in rows]

    def _prefix(self) -> None:
        sizes = [b for b, _ in self.heavy] + [b[2] for b in self.bins]
        self.sums = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        self.atomic = np.array([True] * len(self.heavy) + [b[3] for b in self.bins])
        self.touched: set[int] = set()

    def touch(self, i: int) -> None:
        if 0 <= i < len(self.atomic) and not self.atomic[i]:
            self.touched.add(i)

    def refine(self) -> None:
        """Finer totals of the touched ranges and of their neighbours, into which cuts may still move."""
        h = len(self.heavy)
        near = {j - h for i in self.touched for j in range(i - 2, i + 3) if h <= j < len(self.atomic) and not self.atomic[j]}
        kept = [b for i, b in enumerate(self.bins) if i not in near]
        for shift in sorted({self.bins[i][1] for i in near}):
            wanted = sorted({self.bins[i][0] >> shift for i in near if self.bins[i][1] == shift})
            finer = max(0, shift - FINER_BITS)
            found = self._totals(self.units.where(F.shiftright("_key", shift).isin(wanted)), finer)
            kept += [(b[1], finer, b[2], b[1] == b[4]) for b in found]
        self.bins = sorted(kept)
        self._prefix()

    def end_of_run(self, start: int, capacity: int) -> int:
        """Greedy step: the furthest boundary within ``capacity`` bytes of ``start``."""
        end = int(np.searchsorted(self.sums, self.sums[start] + capacity, "right")) - 1
        self.touch(end)
        return end

    def runs(self, capacity: int, most: int) -> int:
        """Number of runs a greedy filling needs, ``most + 1`` if more than ``most``."""
        at, n, last = 0, 0, len(self.sums) - 1
        while at < last and n <= most:
            end = self.end_of_run(at, capacity)
            if end == at:
                return most + 1
            at, n = end, n + 1
        return n

    def capacity(self, shards: int) -> int:
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.runs(mid, shards) <= shards:
                hi = mid
            else:
                lo = mid + 1
        self.touched.clear()
        self.runs(hi, shards)  # both runs must rest on groups, not on ranges
        self.runs(hi - 1, shards)
        return hi

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Boundaries nearest to equal shares of the rest, such that no run exceeds ``capacity``."""
        last = len(self.sums) - 1
        earliest = [last] * (shards + 1)
        for k in range(shards - 1, 0, -1):
            earliest[k] = int(np.searchsorted(self.sums, self.sums[earliest[k + 1]] - capacity, "left"))
            self.touch(earliest[k] - 1)
        at, found = 0, [0]
        for k in range(1, shards):
            share = self.sums[at] + (self.total - self.sums[at]) / (shards - k + 1)
            low = int(np.searchsorted(self.sums, share, "right")) - 1
            self.touch(low)
            near = low + 1 if low < last and self.sums[low + 1] - share < share - self.sums[low] else low
            at = max(at, earliest[k], min(near, self.end_of_run(at, capacity)))
            found.append(at)
        return [*found, last]


def fit(docs: DataFrame, shards: int) -> ShardPlan:
    """Find the smallest feasible capacity over all groups of equal texts and where to cut."""
    return _fit(store(with_sizes(docs).select("_key", "size"), "shard-units"), shards)


def _fit(units: DataFrame, shards: int) -> ShardPlan:
    order = _Order(units, shards)
    if not order.total:
        return ShardPlan(shards)
    while True:
        capacity = order.capacity(shards)
        at = order.cuts(capacity, shards) if not order.touched else []
        if not order.touched:
            break
        order.refine()
    heavy, n = {}, len(order.heavy)
    for shard in range(shards):
        heavy |= {order.heavy[i][1]: shard for i in range(at[shard], min(at[shard + 1], n))}
    first = max([s for s in range(shards) if at[s] <= n], default=0)
    cuts = [(order.bins[at[s] - n][0], s) for s in range(first + 1, shards) if at[s] - n < len(order.bins)]
    return ShardPlan(shards, capacity, order.rows, heavy, first, cuts)


def assign(docs: DataFrame, plan: ShardPlan) -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in every shard).

    Rows are dealt to blocks by a hash of their identifier and text, so one shard, or one group of copies that fills a shard, is numbered by as
    many tasks as it has blocks; the offsets of the blocks come from one count per shard and block.
    """
    docs, back = aside(docs, INSIDE)
    blocks = max(1, -(-plan.rows // (plan.shards * ROWS_IN_BLOCK)))
    placed = with_sizes(docs).withColumns(
        {"shard": plan.shard(F.col("_key")), "_block": F.pmod(F.xxhash64("doc_id", "_key"), F.lit(blocks)).cast("int")}
    )
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col("shard").alias("_in_shard"), F.col("_block").alias("_in_block"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        )
    )
    within = Window.partitionBy("shard", "_block").orderBy(F.col("doc_id").asc_nulls_first(), "_key")
    joined = placed.join(offsets, (F.col("shard") == F.col("_in_shard")) & (F.col("_block") == F.col("_in_block")))
    numbered = joined.withColumn("slot", F.col("_offset") + F.row_number().over(within) - 1)
    return numbered.drop("_key", "_block", "_in_shard", "_in_block", "_offset").withColumnsRenamed(back)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Fit and assign in one call."""
    return assign(docs, fit(docs, shards))
