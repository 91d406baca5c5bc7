"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal text form a group, which stays in one shard. Groups are packed twice by best fit
decreasing. First, on the executors: groups are dealt by hash into `packers` partitions (as many as shuffles have), sorted by
falling size there, and each goes into the fullest open bundle that still has room for it; a bundle
holds 1/`FINE` of a mean shard. A larger group is a bundle of its own. So there are at most
2 * FINE * shards + packers bundles, whatever the input. Then, on the driver, these few are packed
the same way into the shards.

The open bins live in a balanced tree (an AVL tree keyed by remaining capacity), so that a group
finds the tightest bin in logarithmic time.

`fixed_capacity` packs into as few shards of a given capacity as best fit decreasing needs.
`fixed_number` has a number of shards: groups larger than a mean shard of what is left get a shard
for themselves, and the smallest capacity with which the rest fits into the remaining shards is
found by bisection, which makes sizes near equal.

Size of a row: UTF-8 bytes of its text, none for null, plus `ROW_BYTES`. Null and empty texts are
one group. Repeated rows are rows of one group. A null doc_id is a value like any other. An empty
table gives no rows. Other columns are ignored.

Rows reach their shard by a join on the group, which Spark splits where one group is hot; ranks in a
shard are taken in hashed parts of a shard with offsets, so no task sees a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.sources.shared import drop_tables, settle

ROW_BYTES = 16
FINE = 256
PACKERS = 64
PART_ROWS = 100_000


class _Node:
    __slots__ = ("bins", "height", "key", "left", "right")

    def __init__(self, key: int, name: int):
        self.key, self.bins, self.height = key, [name], 1
        self.left: _Node | None = None
        self.right: _Node | None = None


class CapacityTree:
    """AVL tree from remaining capacity to the bins that have it."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: int, name: int) -> None:
        self.root = self._add(self.root, key, name)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the least capacity that is at least `size`."""
        best, node = None, self.root
        while node is not None:
            if node.key >= size:
                best, node = node, node.left
            else:
                node = node.right
        if best is None:
            return None
        key, name = best.key, best.bins[-1]
        if len(best.bins) > 1:
            best.bins.pop()
        else:
            self.root = self._remove(self.root, key)
        return key, name

    def _add(self, node: _Node | None, key: int, name: int) -> _Node:
        if node is None:
            return _Node(key, name)
        if key == node.key:
            node.bins.append(name)
            return node
        if key < node.key:
            node.left = self._add(node.left, key, name)
        else:
            node.right = self._add(node.right, key, name)
        return _balance(node)

    def _remove(self, node: _Node | None, key: int) -> _Node | None:
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left is not None:
                least = least.left
            node.key, node.bins = least.key, least.bins
            node.right = self._remove(node.right, least.key)
        return _balance(node)


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _rotate(node: _Node, to_left: bool) -> _Node:
    if to_left:
        top = node.right
        node.right, top.left = top.left, node
    else:
        top = node.left
        node.left, top.right = top.right, node
    for n in (node, top):
        n.height = 1 + max(_height(n.left), _height(n.right))
    return top


def _balance(node: _Node) -> _Node:
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _rotate(node.left, True)
        return _rotate(node, False)
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _rotate(node.right, False)
        return _rotate(node, True)
    node.height = 1 + max(_height(node.left), _height(node.right))
    return node


def best_fit(sizes: Iterator[int], capacity: int, most: int | None = None) -> Iterator[int]:
    """Bin of each size, sizes falling; a size over the capacity has a bin of its own. Stops beyond `most` bins."""
    tree, bins = CapacityTree(), 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if bins == most:
                return
            found = (max(capacity, size), bins)
            bins += 1
        left, name = found[0] - size, found[1]
        if left > 0:
            tree.add(left, name)
        yield name


def pack_evenly(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size (sizes falling) for a fixed number of shards, as even as best fit makes it."""
    rest, alone = sum(sizes), 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    free = shards - alone
    small = sizes[alone:]
    low = max(math.ceil(rest / free), small[0] if small else 0)
    high = low + (small[0] if small else 0)
    best: list[int] = []
    while True:  # `high` always fits: a bin is only left for another when it holds more than low
        middle = (low + high) // 2
        got = list(best_fit(iter(small), middle, free))
        if len(got) == len(small):
            best, high = got, middle
        else:
            low = middle + 1
        if low >= high and best:
            break
        if low > high:
            high = 2 * low
    return [*range(alone), *(alone + b for b in best)]


def _bundles(batches, capacity: int):
    """Best fit of groups that arrive by falling size; bundle names are unique by their partition."""
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    tree, bundles = CapacityTree(), 0
    for batch in batches:
        names = []
        for size in batch.column(1).to_pylist():
            found = tree.take_tightest(size)
            if found is None:
                found = (max(capacity, size), bundles)
                bundles += 1
            if found[0] > size:
                tree.add(found[0] - size, found[1])
            names.append(base | found[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], names=["group", "bytes", "bundle"])


def _sized(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.xxhash64(content).alias("group"),
    )


def _packed_groups(rows: DataFrame, capacity: int, packers: int | None, paths: list[str]) -> DataFrame:
    """(group, bytes, bundle): the executors' part. Deterministic, and written before it is read twice."""
    packers = packers or max(PACKERS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    dealt = groups.repartition(packers, "group").sortWithinPartitions(F.desc("bytes"), "group")
    packed = dealt.mapInArrow(lambda batches: _bundles(batches, capacity), "group long, bytes long, bundle long")
    return settle(packed, "bundles", paths)


def _bundle_sizes(packed: DataFrame) -> list:
    """At most 2 * FINE * shards + packers rows; largest first."""
    return packed.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "bundle").collect()


def _shards(packed: DataFrame, bundles: list, shards: list[int]) -> DataFrame:
    spark = packed.sparkSession
    named = spark.createDataFrame([(r.bundle, s) for r, s in zip(bundles, shards, strict=True)], "bundle long, shard int")
    return packed.join(F.broadcast(named), "bundle").select("group", "shard")


def fixed_number(docs: DataFrame, shards: int, *, doc_id="doc_id", text="text", packers=None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard; sizes near equal."""
    rows = _sized(docs, doc_id, text)
    total = rows.agg(F.sum("size")).first()[0] or 0
    paths: list[str] = []
    packed = _packed_groups(rows, max(1, total // (shards * FINE)), packers, paths)
    bundles = _bundle_sizes(packed)
    placed = pack_evenly([r.bytes for r in bundles], shards) if bundles else []
    return _placed(rows, _shards(packed, bundles, placed), paths)


def fixed_capacity(docs: DataFrame, capacity: int, *, doc_id="doc_id", text="text", packers=None, most_bundles=1 << 20) -> DataFrame:
    """As `fixed_number`, into as few shards of `capacity` bytes as best fit decreasing needs.

    A group over the capacity has a shard of its own. ValueError if the driver would see more than `most_bundles` bundles.
    """
    rows = _sized(docs, doc_id, text)
    paths: list[str] = []
    packed = _packed_groups(rows, max(1, capacity // FINE), packers, paths)
    if packed.select("bundle").distinct().count() > most_bundles:
        raise ValueError(f"more than {most_bundles} bundles: take a larger capacity")
    bundles = _bundle_sizes(packed)
    return _placed(rows, _shards(packed, bundles, list(best_fit((r.bytes for r in bundles), capacity))), paths)


def _placed(rows: DataFrame, shards: DataFrame, paths: list[str]) -> DataFrame:
    spark = rows.sparkSession
    placed = settle(rows.join(shards, "group").drop("group"), "placed", paths)
    parts = max(1, placed.count() // PART_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int")
    placed = placed.withColumn("part", part)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("rank", rank).join(offsets, ["shard", "part"])
    out = out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    out = settle(out, "shards")
    drop_tables(spark, paths)
    return out
