"""Shards of near equal bytes: a minimax partition of an ordered sequence of atomic groups.

Rows with equal texts form one group that no cut divides.  The groups stand in the order of the SHA-256 of their text, so neighbours come
from all over the corpus; range partitions of (digest, doc_id) with running totals give every row its place, and since a cut is always
the end of a group, a row finds its shard from its own place: no join, and a group of any size spreads over many tasks.

The smallest feasible capacity is found by binary search.  Each check walks the sequence greedily: a shard takes groups up to the capacity.
The walk looks at a summary of bounded size (smallest and largest group end of each bin); where it cannot tell the exact cut, the bins
that cuts may fall into are divided further by one more aggregation, until smallest capacity and cuts are exact.

A group of more than the mean of what is left gets a shard of its own first (there are fewer of these than shards), otherwise its size
would be the capacity of all shards and most would stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, unused

BINS = 1 << 14  # bins of one summary, whatever the input


class Ends:
    """Group ends known so far, as bins (smallest, largest, count) in order; every end lies in one bin."""

    def __init__(self, bins: list[tuple[int, int, int]]):
        self.bins = sorted(bins)
        self.lows = [b[0] for b in self.bins]

    def floor(self, at: int) -> tuple[int, int, int | None]:
        """Bounds of the last end up to at (0 if there is none), and the bin to divide where they differ."""
        i = bisect_right(self.lows, at) - 1
        if i < 0:
            return 0, 0, None
        low, high, n = self.bins[i]
        if at >= high:
            return high, high, None
        return (low, low, None) if n <= 2 else (low, at, i)

    def walk(self, capacity: int, shards: int, total: int, best: bool) -> tuple[bool, list[int]]:
        """Whether the shards suffice, and the cuts; cuts that are not known are taken as late (best) or early as they may be."""
        cuts, at = [], 0
        for _ in range(shards):
            if at + capacity >= total:
                return True, cuts
            at = self.floor(at + capacity)[1 if best else 0]
            cuts.append(at)
        return False, cuts

    def smallest(self, shards: int, total: int, best: bool) -> int:
        low, high = 0, total
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, shards, total, best)[0] else (mid, high)
        return high

    def unclear(self, shards: int, total: int) -> tuple[int, list[tuple[int, int, int]]]:
        """(capacity, ranges of ends to look at more closely, with their bins); capacity and its cuts are exact where no range is left."""
        low, high = self.smallest(shards, total, True), self.smallest(shards, total, False)
        early, late = self.walk(low, shards, total, False)[1], self.walk(high, shards, total, True)[1]
        marked = set()
        for i in range(shards):
            a = (early[i - 1] if i else 0) + low if i <= len(early) else None
            b = (late[i - 1] if i else 0) + high if i <= len(late) else total
            if a is None or a >= total:
                break
            first, last = max(0, bisect_right(self.lows, a) - 1), bisect_right(self.lows, min(b, total))
            marked.update(j for j in range(first, last) if self.bins[j][2] > 2 and self.bins[j][1] > a)
        ranges: list[tuple[int, int, int]] = []
        for j in sorted(marked):
            if ranges and j - 1 in marked:
                ranges[-1] = (ranges[-1][0], self.bins[j][1], ranges[-1][2] + 1)
            else:
                ranges.append((self.bins[j][0], self.bins[j][1], 1))
        return high, ranges


def smallest_capacity(ends: DataFrame, shards: int, total: int) -> tuple[int, list[int]]:
    """ends(end) of the ordered groups -> the smallest capacity for so many shards, and the greedy cuts (group ends) at that capacity."""
    known, ranges = [], [(1, total, 1)]
    while True:
        number, base = F.lit(None).cast("long"), 0
        for a, z, bins in ranges:
            each = max(BINS // len(ranges), 4 * bins)  # finer than before in any case
            width = -(-(z - a + 1) // each)
            number = F.when(F.col("end").between(a, z), F.expr(f"(end - {a}L) div {width}L") + base).otherwise(number)
            base += each
        got = ends.withColumn("_bin", number).where("_bin IS NOT NULL").groupBy("_bin").agg(F.min("end"), F.max("end"), F.count_distinct("end")).collect()
        known = [b for b in known if not any(a <= b[0] and b[1] <= z for a, z, _ in ranges)] + [(r[1], r[2], r[3]) for r in got]
        summary = Ends(known)
        capacity, ranges = summary.unclear(shards, total)
        if not ranges:
            return capacity, summary.walk(capacity, shards, total, True)[1]


def _placed(slim: DataFrame) -> DataFrame:
    """slim(row, id, size, text_crc32, digest) with start (bytes before the row) and rank (rows before it) in the order of digest and id."""
    blocks = cut(slim.repartitionByRange("digest", "id").withColumn("block", F.spark_partition_id()))
    over = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    sums = blocks.groupBy("block").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("block", F.coalesce(F.sum("b").over(over), F.lit(0)).alias("_b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_n"))
    local = Window.partitionBy("block").orderBy("digest", "id")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "rank": F.row_number().over(local).cast("long") - 1})
    return out.join(F.broadcast(sums), "block").withColumns({"start": F.col("start") + F.col("_b"), "rank": F.col("rank") + F.col("_n")}).drop("block", "_b", "_n")


def _own_shards(groups: DataFrame, shards: int, total: int) -> list:
    """Groups that are larger than the mean of what is left, largest first; fewer than shards."""
    out, left = [], total
    for g in groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).collect():
        if g["bytes"] * (shards - len(out)) <= left:
            break
        out.append(g)
        left -= g["bytes"]
    return out


def assign(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(doc_id, text, ...) -> the carried columns, size, text_crc32, shard (from 0) and slot (from 0 without gaps in each shard).

    The size of a row is the bytes of its text plus 1.  A null text is a text of no bytes and belongs to the group of the empty text.
    Rows with equal texts, repeated rows included, share a shard; a null doc_id comes first in its group.  With fewer groups than shards
    some shards are empty; an empty table gives an empty result.  Columns that are not carried are not read; an output column whose name a
    carried column has gets underscores.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(
        F.struct(*carry).alias("row"), F.col("doc_id").alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"),
    )
    placed = _placed(slim)
    groups = cut(placed.groupBy("digest").agg(F.min("start").alias("start"), F.sum("size").alias("bytes"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own = _own_shards(groups, shards, total)

    def without(own_column: str) -> Callable[[Column], Column]:
        """A place in the sequence without the groups that have shards of their own."""
        return lambda at: at - sum((F.when(F.col("start") > g["start"], F.lit(g[own_column])).otherwise(F.lit(0)) for g in own), F.lit(0).cast("long"))

    start, rank = without("bytes")(F.col("start")), without("n")(F.col("rank"))
    single = F.lit(False)
    for g in own:
        single = single | (F.col("start") == g["start"])
    rest = groups.where(~single).select((start + F.col("bytes")).alias("end"), (rank + F.col("n")).alias("rows"))
    left = total - sum(g["bytes"] for g in own)
    cuts = smallest_capacity(rest, shards - len(own), left)[1] if left else []
    rows = {r["end"]: r["rows"] for r in rest.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    shard, slot = F.lit(len(own)), rank
    for i, c in enumerate(cuts):
        shard, slot = F.when(start >= c, len(own) + i + 1).otherwise(shard), F.when(start >= c, rank - rows[c]).otherwise(slot)
    for i, g in enumerate(own):
        inside = F.col("start").between(g["start"], g["start"] + g["bytes"] - 1)
        shard, slot = F.when(inside, i).otherwise(shard), F.when(inside, F.col("rank") - g["rank"]).otherwise(slot)
    kept = docs.select(*carry)
    names = [unused(n, kept) for n in ("size", "text_crc32", "shard", "slot")]
    return placed.select("row.*", F.col("size").alias(names[0]), F.col("text_crc32").alias(names[1]), shard.cast("int").alias(names[2]), slot.cast("long").alias(names[3]))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """All rows of docs, whole, as one folder per shard, in the order of their slots within each file."""
    out = assign(docs, shards, tuple(docs.columns))
    shard, slot = out.columns[-2:]
    spread = F.floor(F.col(slot) / 100_000)  # files of at most so many rows
    out.repartition(F.col(shard), spread).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
