"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group, which stays together (a 64-bit hash of the text names it; two texts that shared a
hash would merely stay together too). Null texts count as empty ones. Every group is an item. Groups of one size are alike to the packing, so it
is told how many there are of each size, in falling order, and answers how many of them each bin takes. A bin is the
tightest that still holds a group for as long as it holds one at all, so equal groups are placed many at a time, with
the outcome of placing them one by one. The driver holds one row for each size: D different sizes take at least
D * (D + 1) / 2 bytes, so that there are at most the root of twice all bytes, and the bins.

Groups are then numbered within their size, in small parts, and take their bins by number; rows find their group's bin,
those of groups with very many rows by a broadcast of bounded size. Repeated rows are rows like any other; sizes of zero,
empty and very long texts are sizes like any other; an empty table gives an empty result, and columns named like the
results are replaced.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Parts in which the groups of one size are numbered, and how many groups take their bins together.
PARTS = 4096
CHUNK = 1 << 16
#: Groups with more than this share of all rows are broadcast: there are fewer than 1 / HOT of them.
HOT = 1 / 10000
#: Rows of an input partition that are numbered together, as a power of two.
ROW_BITS = 17


class FreeSpace:
    """Bins ordered by what is left in them: a search tree that random priorities keep balanced."""

    def __init__(self) -> None:
        self._root: list | None = None  # [(left, bin), priority, smaller, larger]
        self._random = random.Random(1)

    def add(self, left: int, bin_: int) -> None:
        low, high = self._split(self._root, (left, bin_))
        self._root = self._merge(self._merge(low, [(left, bin_), self._random.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes the bin with the least space that holds size."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self._root = self._merge(low, rest)
        return first[0]

    def take_widest(self) -> tuple[int, int]:
        last = self._root
        while last[3] is not None:
            last = last[3]
        self._root, _ = self._split(self._root, last[0])
        return last[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low if high is None else high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


def pack(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """Best fit decreasing into as few bins of a fixed capacity: (size, bin, groups) from (size, groups). Groups larger
    than the capacity get bins of their own."""
    free, out, bins = FreeSpace(), [], 0
    for size, n in sorted(sizes, reverse=True):
        while n:
            left, at = free.take_tightest(size) or (max(size, capacity), bins)
            bins += at == bins
            k = min(n, left // size) if size else n
            out.append((size, at, k))
            free.add(left - k * size, at)
            n -= k
    return out


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best fit decreasing into a given number of bins of near equal content.

    Groups too large for an even share get bins of their own, and the others share what is left evenly. Where a group
    fits nowhere at that capacity, it goes to the bin with most space; there are fewer such groups of a size than bins.
    """
    todo = sorted(([s, n] for s, n in sizes), reverse=True)
    out, own, rest = [], 0, sum(s * n for s, n in todo)
    while own < shards - 1 and todo and todo[0][0] * (shards - own) > rest:
        size = todo[0][0]
        out.append((size, own, 1))
        own, rest = own + 1, rest - size
        todo[0][1] -= 1
        if not todo[0][1]:
            todo.pop(0)
    free, capacity = FreeSpace(), -(-rest // max(1, shards - own))
    for k in range(own, shards):
        free.add(capacity, k)
    for size, n in todo:
        while n:
            found = free.take_tightest(size)
            k = 1 if found is None else min(n, found[0] // size) if size else n
            left, at = found or free.take_widest()
            out.append((size, at, k))
            free.add(left - k * size, at)
            n -= k
    return out


def numbered(groups: DataFrame, group: str, size: str) -> DataFrame:
    """Adds _rank, from 0 within each size: numbers within parts by hash, behind the parts before."""
    dealt = groups.withColumn("_part", F.pmod(F.xxhash64(group), F.lit(PARTS)).cast("int"))
    counts = dealt.groupBy(size, "_part").agg(F.count("*").alias("_n"))
    begins = counts.select(size, "_part", (F.sum("_n").over(Window.partitionBy(size).orderBy("_part")) - F.col("_n")).alias("_begin"))
    within = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(size, "_part").orderBy(group)) - 1)
    return within.join(begins, [size, "_part"]).withColumn("_rank", F.col("_begin") + F.col("_k")).drop("_part", "_k", "_begin")


def shard(df: DataFrame, size: str, group: str, shards: int = 16, capacity: int | None = None) -> DataFrame:
    """Adds shard to df: one of `shards` of near equal content, or, where a capacity is given, one of as few shards of
    that capacity as best fit decreasing finds. group is a 64-bit key without nulls, size the bytes of a row."""
    spark, df = df.sparkSession, df.drop("shard")
    sums = materialise(df.groupBy(F.col(group).alias("_g")).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows")), "groups")
    sizes = [(r._bytes, r.n) for r in sums.groupBy("_bytes").agg(F.count("*").alias("n")).collect()]
    runs, begin = [], {}
    for b, at, n in pack_into(sizes, shards) if capacity is None else pack(sizes, capacity):
        first = begin.get(b, 0)
        runs.append((b, first, first + n, at))
        begin[b] = first + n
    chunk = lambda c: F.expr(f"{c} div {CHUNK}")
    # A run begins at a number, and anew in each chunk of numbers; a group takes the bin of the last run begun.
    runs = spark.createDataFrame(runs, "_bytes bigint, _first bigint, _end bigint, _shard int")
    runs = runs.withColumn("_chunk", F.explode(F.sequence(chunk("_first"), chunk("_end - 1"))))
    marks = runs.select("_bytes", "_chunk", F.greatest("_first", F.col("_chunk") * CHUNK).alias("_rank"), F.lit(None).cast("long").alias("_g"), F.lit(None).cast("long").alias("_rows"), "_shard")
    items = numbered(sums, "_g", "_bytes").select("_bytes", chunk("_rank").alias("_chunk"), "_rank", "_g", "_rows", F.lit(None).cast("int").alias("_shard"))
    order = Window.partitionBy("_bytes", "_chunk").orderBy("_rank", F.col("_g").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = marks.union(items).withColumn("_shard", F.last("_shard", True).over(order)).filter("_g is not null")
    placed = materialise(dealt.select("_g", "_rows", "_shard"), "placed")

    rows = sums.agg(F.sum("_rows")).collect()[0][0] or 0
    hot = F.broadcast(placed.filter(F.col("_rows") > rows * HOT).select("_g", "_shard"))
    cold = placed.filter(F.col("_rows") <= rows * HOT).select("_g", "_shard")
    many = df.join(hot, df[group] == hot["_g"]).drop("_g")
    few = df.join(hot, df[group] == hot["_g"], "left_anti")
    return many.union(few.join(cold, few[group] == cold["_g"]).drop("_g")).withColumnRenamed("_shard", "shard")


def with_slots(df: DataFrame, shard_: str, row: str) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: rows are numbered within parts of bounded size, and a running sum over
    the parts' counts gives where each begins. row: a number for each row, as monotonically_increasing_id gives it."""
    out = df.drop("slot").withColumn("_part", F.shiftright(row, ROW_BITS))
    counts = out.groupBy(shard_, "_part").agg(F.count("*").alias("_n"))
    begins = counts.select(shard_, "_part", (F.sum("_n").over(Window.partitionBy(shard_).orderBy("_part")) - F.col("_n")).alias("_begin"))
    numbered_ = out.withColumn("_k", F.row_number().over(Window.partitionBy(shard_, "_part").orderBy(row)) - 1)
    return numbered_.join(begins, [shard_, "_part"]).withColumn("slot", (F.col("_begin") + F.col("_k")).cast("long")).drop("_part", "_k", "_begin")


def query(spark, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    out = with_slots(shard(materialise(docs, "sizes"), "size", "key"), "shard", "row")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
