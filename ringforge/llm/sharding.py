"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text.  Groups in order of falling size enter the shard of the tightest remaining capacity
that still holds them, found in a balanced tree of remaining capacities.  The capacity is the smallest, found by
bisection, for which the wanted number of shards is enough; a group above its fair part has a shard of its own and the
others share what is left.  So the sizes of shards are near equal as far as groups allow.  Or a capacity is given, and shards are as few as best fit finds.

The packing itself sees a bounded number of items for any input: every group above total / ``items`` is an item
(there are fewer than ``items`` of those), and the smaller ones are first dealt by the hash of their text into
``items`` bundles, each an indivisible item too (a bundle holds whole groups).  Everything else is distributed: group
sizes by an aggregate with map-side combine, and row numbers within shards from counts of (shard, hash bucket) and
numbers within each bucket.

Null text counts as empty: size 1, in the group of empty texts.  An empty table gives an empty result.  Rows
without id or with repeated ids are rows like others.  Reruns agree up to the order of rows without id and of rows with equal id and text."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


class Capacities:
    """Remaining capacities in order: a balanced tree of blocks (a sorted list of sorted lists)."""

    def __init__(self, block: int = 64):
        self.blocks: list[list[tuple[int, int]]] = []
        self.heads: list[tuple[int, int]] = []
        self.block = block

    def add(self, item: tuple[int, int]) -> None:
        if not self.blocks:
            self.blocks, self.heads = [[item]], [item]
            return
        k = max(0, bisect.bisect_right(self.heads, item) - 1)
        b = self.blocks[k]
        bisect.insort(b, item)
        self.heads[k] = b[0]
        if len(b) > 2 * self.block:
            half = b[self.block :]
            del b[self.block :]
            self.blocks.insert(k + 1, half)
            self.heads.insert(k + 1, half[0])

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the smallest item of at least this capacity."""
        k = bisect.bisect_right(self.heads, (least, -1)) - 1
        for j in (k, k + 1):
            if 0 <= j < len(self.blocks):
                b = self.blocks[j]
                i = bisect.bisect_left(b, (least, -1))
                if i < len(b):
                    out = b.pop(i)
                    if b:
                        self.heads[j] = b[0]
                    else:
                        del self.blocks[j], self.heads[j]
                    return out
        return None


def best_fit_decreasing(sizes: list[int], capacity: int, at_most: int | None = None) -> list[int] | None:
    """The bin of each item (sizes in falling order), or None if at_most bins aren't enough."""
    tree, out, n = Capacities(), [], 0
    for s in sizes:
        got = tree.take(s)
        if got is None:
            if s > capacity or n == at_most:
                return None
            got, n = (capacity, n), n + 1
        tree.add((got[0] - s, got[1]))
        out.append(got[1])
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item (sizes in falling order), for the smallest capacity that ``shards`` shards allow."""
    out, first, left = [], 0, sum(sizes)
    while first < min(shards - 1, len(sizes)) and sizes[first] * (shards - first) > left:
        left -= sizes[first]
        out.append(first)
        first += 1
    rest, n = sizes[first:], shards - first
    if not rest:
        return out
    low, high = max(-(-left // n), rest[0]), 2 * max(-(-left // n), rest[0])
    best = None
    while low < high or best is None:
        mid = (low + high) // 2
        got = best_fit_decreasing(rest, mid, n)
        if got is None:
            low = mid + 1
            high = max(high, low)
        else:
            best, high = got, mid
    return out + [first + b for b in best]


def fill(sizes: list[int], capacity: int) -> list[int]:
    """The shard of each item (sizes in falling order) where a shard's capacity is given and as few shards are wanted as best fit finds; an item above
    it has a shard of its own."""
    over = next((k for k, s in enumerate(sizes) if s <= capacity), len(sizes))
    return list(range(over)) + [over + b for b in best_fit_decreasing(sizes[over:], capacity)]


#: The most items that a given capacity may ask for.
MOST_ITEMS = 1 << 20


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, items: int = 1 << 14, keep: list[str] = (), capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in ``keep`` as kept_<name>.

    capacity: bytes that a shard holds; then their number is what the packing needs, and ``shards`` isn't looked at."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"kept_{c}") for c in keep], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("text_key"))
    # rows without id and with one text can't be told apart: as they are written, they are numbered, so that numbering them later is no single task's work
    rows = ws.table(rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).otherwise(0)))
    groups = ws.table(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.min("text_crc32").alias("crc")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if capacity is not None:
        items = max(items, 16 * -(-total // capacity))  # bundles of a sixteenth of a shard at most, on average
        if items > MOST_ITEMS:
            raise ValueError(f"{total} bytes in shards of {capacity}: more than {MOST_ITEMS // 16} shards")
    deal = F.pmod(F.xxhash64("text_key"), F.lit(items)).cast("int")
    item = F.when(F.col("bytes") * items > total, F.struct(F.lit(-1).alias("bundle"), F.col("text_key").alias("key"))).otherwise(F.struct(deal.alias("bundle"), F.lit("").alias("key")))
    # under 2 * items rows come to the driver
    packed = sorted(((r["bytes"], r["item"]["bundle"], r["item"]["key"]) for r in groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()), key=lambda x: (-x[0], x[1], x[2]))
    sizes = [x[0] for x in packed]
    where = pack(sizes, shards) if capacity is None else fill(sizes, capacity)
    plan = spark.createDataFrame([(b, k, s) for (_, b, k), s in zip(packed, where, strict=True)], "bundle int, key string, shard int")
    big = plan.where("bundle < 0").select(F.col("key").alias("text_key"), F.col("shard").alias("own"))
    small = plan.where("bundle >= 0").select("bundle", "shard")
    placed = rows.join(F.broadcast(big), "text_key", "left").withColumn("bundle", deal).join(F.broadcast(small), "bundle", "left").withColumn("shard", F.coalesce("own", "shard"))
    bucket = F.pmod(F.xxhash64("text_key", "doc_id", "salt"), F.lit(16 * common.partitions(spark))).cast("int")
    placed = placed.withColumn("bucket", bucket)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_key"))
    return (
        placed.join(starts, ["shard", "bucket"])
        .withColumn("slot", (F.col("start") + number - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *[f"kept_{c}" for c in keep])
    )
