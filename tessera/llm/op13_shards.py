"""Operator 13: sharding by best-fit decreasing bin packing.

Groups of equal texts are indivisible.  Method: groups in order of size, largest first,
enter the bin with the least room that still holds them, found in a balanced tree of the
open bins' rooms.  With a ``capacity`` the bins are shards of that capacity, as few as
best fit gives; with a number of ``shards`` the least capacity is sought at which best fit
needs no more, so that the bytes of the shards are near equal (law ``bytes``).

Every task packs its own small groups, those under 1/``ITEMS`` of all bytes, into bundles of that
size by the same rule; it reads them sorted, so it holds the open bundles only.  The driver packs the
bundles and the large groups: there are at most ``3 * ITEMS`` of these and one more for
each task, whatever the input is (with a capacity: or a few for each shard).  A group of more than its even share of the bytes gets a
shard of its own, and the others share the rest.

Slots are numbers without gaps: a group's rows are numbered along sorted blocks, so a
group that holds a third of all rows fills many tasks; groups have their offsets in a
bundle, and bundles theirs in a shard.

Defined results: a null text is a text of no bytes (size 1, checksum 0) and equal to the
empty one; texts are known by 128 bits of SHA-256; rows without a doc_id and repeated rows are
rows like any other, each with a slot of its own; a text of any length is one row; ties in size go by the
hash of the text; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import places
from .checkpoints import checkpointed

SHARDS, ITEMS, LEAF = 16, 16_384, 256
#: The least step in capacity that is tried, as a part of an even share.
STEP = 100_000


class OpenBins:
    """Bins by room, in a balanced tree of two levels: sorted leaves, split when full."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.most: list[tuple[int, int]] = [(0, 0)]

    def put(self, room: int, bin_: int) -> None:
        at = min(bisect_left(self.most, (room, bin_)), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, (room, bin_))
        self.most[at] = leaf[-1]
        if len(leaf) > 2 * LEAF:
            self.leaves[at : at + 1] = [leaf[:LEAF], leaf[LEAF:]]
            self.most[at : at + 1] = [leaf[LEAF - 1], leaf[-1]]

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of need or more (ties: the first opened); its room."""
        at = bisect_left(self.most, (need, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        if (place := bisect_left(leaf, (need, -1))) == len(leaf):
            return None
        room, bin_ = leaf.pop(place)
        if leaf:
            self.most[at] = leaf[-1]
        elif len(self.leaves) > 1:
            del self.leaves[at], self.most[at]
        else:
            self.most[at] = (0, 0)
        return bin_, room


def best_fit(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of sizes, which fall; None if they need more than most bins."""
    open_, count, out = OpenBins(), 0, []
    for size in sizes:
        bin_, room = open_.take(size) or (count, capacity)
        count += bin_ == count
        if most is not None and count > most:
            return None
        if room > size:
            open_.put(room - size, bin_)
        out.append(bin_)
    return out


def near_equal(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of sizes, which fall.  Those over their even share stand alone; for
    the others the least capacity is found, by halving, that best fit can do with."""
    alone, rest = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    others, left = sizes[alone:], shards - alone
    low = max([-(-rest // left), *others[:1]]) - 1
    high = low + 1 + max(others[:1], default=0)  # cannot fail: no bin is opened while one is under the even share
    found = best_fit(others, high, left)
    while high - low > max(1, rest // left // STEP):
        middle = (low + high) // 2
        now = best_fit(others, middle, left)
        if now is None:
            low = middle
        else:
            high, found = middle, now
    return [*range(alone), *(alone + b for b in found)]


def of_capacity(sizes: list[int], capacity: int) -> list[int]:
    """The shard of each of sizes, which fall; those over capacity stand alone."""
    alone = sum(s > capacity for s in sizes)
    return [*range(alone), *(alone + b for b in best_fit(sizes[alone:], capacity))]


def _bundles(capacity: int):
    """Rows (g, bytes, n) sorted by falling bytes to (g, item, first): the bundle of each
    group in this task, and how many rows of the bundle stand before the group's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, open_, count, rows = TaskContext.get().partitionId() << 33, OpenBins(), 0, {}
        for batch in batches:
            items, firsts = [], []
            for size, n in zip(batch.column("bytes").to_pylist(), batch.column("n").to_pylist(), strict=True):
                bin_, room = open_.take(size) or (count, capacity)
                count += bin_ == count
                items.append(base + bin_)
                firsts.append(rows.get(bin_, 0))
                if room > size:
                    open_.put(room - size, bin_)
                    rows[bin_] = firsts[-1] + n
                else:
                    rows.pop(bin_, None)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(items, pa.int64()), pa.array(firsts, pa.int64()), batch.column("bytes"), batch.column("n")], ["g", "item", "first", "bytes", "n"])

    return scan


def sharded(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, group (16 bytes), shard, slot of each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("g"))
    rows = checkpointed(places(keyed, ["g"], ["doc_id"]))
    groups = checkpointed(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.col("g").alias("group"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    room = max(1, min(-(-total // ITEMS), capacity or total))
    small = groups.filter(F.col("bytes") < room).repartition(F.xxhash64("g")).sortWithinPartitions(F.desc("bytes"), "g")
    bundled = checkpointed(small.mapInArrow(_bundles(room), "g binary, item bigint, first bigint, bytes bigint, n bigint"))
    large = groups.filter(F.col("bytes") >= room).orderBy(F.desc("bytes"), "g").collect()  # at most ITEMS groups are as large
    bundles = bundled.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    items = [(r.bytes, -1 - i, r.n) for i, r in enumerate(large)] + [(r.bytes, r.item, r.n) for r in bundles]
    items.sort(key=lambda x: (-x[0], x[1]))
    sizes = [x[0] for x in items]
    placed = near_equal(sizes, shards) if capacity is None else of_capacity(sizes, capacity)
    filled: dict[int, int] = {}
    where = []
    for (_, item, n), shard in zip(items, placed, strict=True):
        where.append((item, shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + n
    at = F.broadcast(spark.createDataFrame(where, "item bigint, shard int, start bigint"))
    alone = spark.createDataFrame([(bytes(r.g), -1 - i, 0) for i, r in enumerate(large)], "g binary, item bigint, first bigint")
    of = checkpointed(bundled.select("g", "item", "first").union(alone).join(at, "item").select("g", "shard", (F.col("start") + F.col("first") - 1).alias("before")))
    return rows.join(of.hint("merge"), "g").select("doc_id", "size", "text_crc32", F.col("g").alias("group"), "shard", (F.col("before") + F.col("place")).alias("slot"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
