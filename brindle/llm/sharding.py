"""Shards of near-equal bytes by best-fit-decreasing bin packing of indivisible groups (equal texts).

Packing goes by decreasing size into the bin with the least remaining capacity that still fits. ``Bins`` keeps
the bins in a balanced tree (AA tree) by remaining capacity. One sorted pass over all groups can't be shared out, so it is done twice:

1. The groups are dealt to tasks by hash, as many as keep a task's groups below ``TASK_GROUPS``. Each task packs its own, largest first, into small boxes of a fixed
   capacity, a set fraction of the total. Groups larger than a box become boxes of their own. At most one box
   of a task is half full or less, so there are at most 2 x ``BOXES`` boxes and one for each task, whatever the number of documents
   (with a fixed capacity: about 1024 x the number of shards).
2. The boxes, whose number is bounded so, are packed into shards by one task: for a fixed number of shards with the
   least capacity at which best fit decreasing needs no more of them (found by bisection); for a fixed capacity
   with as few shards as it needs.

A group larger than an even share gets a shard for itself; the others share out the rest.
The slot of a row is its box's start in the shard plus its part's start in the box plus its number in the part; boxes are split by
a hash of doc_id and the row's number into parts of about ``PART_ROWS`` rows, so that a large group isn't numbered by one task. Nor is it joined by one: ``spread_join``
leaves the rows of groups that hold a large share of all where they are.

Defined results: a null text counts as empty (size 1, CRC 0) and forms a group with the empty texts. Rows without an id are
rows like any other. Repeated rows are rows of one group, in any order among themselves. A very long text is a group like any other; over an even share it has a
shard to itself. An empty table gives an empty result. Columns in ``keep`` pass through; an output column replaces a kept one of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut
from brindle.operators.joins import spread_join

BOXES = 4096
#: Groups that a task packs, and rows that a task numbers, at most (about); the tasks' number follows from the table.
TASK_GROUPS, PART_ROWS, SALTS = 1_000_000, 8192, 1 << 40


class Bins:
    """Open bins in an AA tree ordered by (remaining capacity, bin number)."""

    def __init__(self):
        # key, level, left, right by node; node 0 is the empty tree
        self.key: list[tuple[int, int]] = [(0, 0)]
        self.level, self.left, self.right, self.root = [0], [0], [0], 0

    def _skew(self, t: int) -> int:
        left = self.left[t]
        if left and self.level[left] == self.level[t]:
            self.left[t], self.right[left] = self.right[left], t
            return left
        return t

    def _split(self, t: int) -> int:
        right = self.right[t]
        if right and self.level[self.right[right]] == self.level[t]:
            self.right[t], self.left[right] = self.left[right], t
            self.level[right] += 1
            return right
        return t

    def _add(self, t: int, key: tuple[int, int]) -> int:
        if not t:
            self.key.append(key)
            self.level.append(1)
            self.left.append(0)
            self.right.append(0)
            return len(self.key) - 1
        if key < self.key[t]:
            self.left[t] = self._add(self.left[t], key)
        else:
            self.right[t] = self._add(self.right[t], key)
        return self._split(self._skew(t))

    def _remove(self, t: int, key: tuple[int, int]) -> int:
        if not t:
            return 0
        if key < self.key[t]:
            self.left[t] = self._remove(self.left[t], key)
        elif key > self.key[t]:
            self.right[t] = self._remove(self.right[t], key)
        elif not self.left[t] and not self.right[t]:
            return 0
        elif not self.left[t]:
            self.key[t] = self._end(self.right[t], self.left)
            self.right[t] = self._remove(self.right[t], self.key[t])
        else:
            self.key[t] = self._end(self.left[t], self.right)
            self.left[t] = self._remove(self.left[t], self.key[t])
        least = min(self.level[self.left[t]], self.level[self.right[t]]) + 1
        if least < self.level[t]:
            self.level[t] = least
            if self.right[t]:
                self.level[self.right[t]] = min(least, self.level[self.right[t]])
        t = self._skew(t)
        if self.right[t]:
            self.right[t] = self._skew(self.right[t])
            if self.right[self.right[t]]:
                self.right[self.right[t]] = self._skew(self.right[self.right[t]])
        t = self._split(t)
        if self.right[t]:
            self.right[t] = self._split(self.right[t])
        return t

    def _end(self, t: int, way: list[int]) -> tuple[int, int]:
        while way[t]:
            t = way[t]
        return self.key[t]

    def add(self, remaining: int, number: int) -> None:
        self.root = self._add(self.root, (remaining, number))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity of at least ``size``."""
        t, best = self.root, None
        while t:
            if self.key[t][0] >= size:
                best, t = self.key[t], self.left[t]
            else:
                t = self.right[t]
        return best

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)


def best_fit(sizes, capacity: int) -> list[int]:
    """The bin of each size; sizes must fall. A size over the capacity gets a bin for itself."""
    bins, out, n = Bins(), [], 0
    for size in map(int, sizes):
        if size > capacity:
            out.append(n)
            n += 1
            continue
        if found := bins.tightest(size):
            bins.remove(found)
            remaining, number = found
        else:
            remaining, number, n = capacity, n, n + 1
        if remaining > size:
            bins.add(remaining - size, number)
        out.append(number)
    return out


def pack_shards(sizes: list[int], shards: int) -> list[int]:
    """Shards 0 to shards - 1 of boxes in falling order, with loads as near equal as bisection over the capacity finds."""
    out, alone, rest = [0] * len(sizes), 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > rest:
        out[alone], rest, alone = alone, rest - sizes[alone], alone + 1
    free, k = sizes[alone:], shards - alone
    if free:
        low, high = max(free[0], -(-rest // k)), 2 * max(free[0], -(-rest // k))
        best = best_fit(free, high)
        while low < high:
            mid = (low + high) // 2
            now = best_fit(free, mid)
            if max(now) < k:
                best, high = now, mid
            else:
                low = mid + 1
        out[alone:] = [alone + b for b in best]
    return out


def shard(df: DataFrame, shards: int | None = 8, capacity: int | None = None, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text unless given) with size, text_crc32, shard and slot.

    ``shards`` fixes their number and makes their bytes near equal; ``capacity`` instead opens as few as best fit needs.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c not in ("size", "text_crc32", "shard", "slot")]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # The texts are read once. The salt goes by the row's number besides its id, so rows that repeat an id, or have none, are dealt too; it stays as it is written.
    salt = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(SALTS))
    rows = cut(
        df.select(
            *keep,
            F.col(id_col).alias("__id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("__group"),
            salt.cast("long").alias("__salt"),
        )
    )
    groups = cut(rows.groupBy("__group").agg(F.sum("size").alias("bytes"), F.count("*").alias("__n")))
    n_groups, n_rows, total = groups.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    most = -(-total // BOXES) if capacity is None else max(1, capacity // (BOXES // 8))
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, n_groups // 20_000), -(-n_groups // TASK_GROUPS))

    def boxes(batches):
        sets = [(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()) for batch in batches]
        if not sets or not sum(len(b) for _, b, _ in sets):
            return
        keys, sizes, counts = pa.concat_arrays([k for k, _, _ in sets]), *(np.concatenate([x[i] for x in sets]) for i in (1, 2))
        own = sets[0][0][0].as_py().hex()
        box = best_fit(sizes, most)
        for i in range(0, len(box), 10_000):
            j = i + 10_000
            yield pa.RecordBatch.from_arrays([keys[i:j], pa.array(sizes[i:j]), pa.array(counts[i:j]), pa.array([f"{own}-{b}" for b in box[i:j]])], names=["__group", "bytes", "__n", "__box"])

    spread = groups.repartition(tasks, "__group").sortWithinPartitions(F.col("bytes").desc(), "__group")
    boxed = cut(spread.mapInArrow(boxes, "__group binary, bytes long, __n long, __box string"))
    few = boxed.groupBy("__box").agg(F.sum("bytes").alias("bytes"), F.sum("__n").alias("in_box"))

    def final(batches):
        boxes = [(-b, x, n) for batch in batches for x, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        boxes.sort()
        sizes = [-b for b, _, _ in boxes]
        place = pack_shards(sizes, shards) if capacity is None else best_fit(sizes, capacity)
        if boxes:
            parts = [-(-n // PART_ROWS) for _, _, n in boxes]
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x, _ in boxes]), pa.array(place, pa.int32()), pa.array(parts, pa.int64())], names=["__box", "shard", "__parts"])

    placed = cut(few.repartition(1).mapInArrow(final, "__box string, shard int, __parts long"))
    # For a fixed number of shards there are at most 2 x BOXES boxes and one for each task.
    per_group = boxed.join(F.broadcast(placed) if capacity is None else placed, "__box").drop("bytes")
    numbered = cut(spread_join(rows, per_group, ["__group"], "__n", n_rows).withColumn("__part", F.pmod("__salt", "__parts")).drop("__group", "__salt", "__parts", "__n"))
    counts = numbered.groupBy("shard", "__box", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__box", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__box", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__box", "__part").orderBy(F.col("__id").asc_nulls_last(), "text_crc32")
    return (
        numbered.withColumn("slot", F.row_number().over(own) - 1)
        .join(starts, ["__box", "__part"])
        .withColumn("slot", F.col("slot") + F.col("__start"))
        .select(*keep, "size", "text_crc32", "shard", "slot")
    )
